"""Turning texts into vectors: a pluggable embedder, an offline default, and a circuit breaker."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], "list[list[float] | None]"]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Bags of hashed words of unit length: deterministic, needs no model. Empty texts give None."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = 0
                for c in w:
                    h = (h * 31 + ord(c)) & 0xFFFFFFFF
                v[h % dim] += 1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


class Breaker:
    """Stops asking a failing backend: opens after ``threshold`` failures (a timeout counts twice), tries once after ``cooldown`` seconds."""

    def __init__(self, threshold: int = 2, cooldown: float = 60.0, clock: Callable[[], float] = time.monotonic, on_open: Callable[[], None] | None = None):
        self.threshold, self.cooldown, self.clock, self.on_open = threshold, cooldown, clock, on_open
        self.failures, self.opened_at, self.probing = 0, None, False

    def allows(self) -> bool:
        if self.opened_at is None:
            return True
        if self.clock() - self.opened_at < self.cooldown or self.probing:
            return False
        self.probing = True
        return True

    def success(self) -> None:
        self.failures, self.opened_at, self.probing = 0, None, False

    def failure(self, timeout: bool = False) -> None:
        self.failures += 2 if timeout else 1
        self.probing = False
        if self.failures >= self.threshold:
            if self.opened_at is None and self.on_open:
                self.on_open()
            self.opened_at = self.clock()

    def call(self, f: Callable, *args):
        """``f(*args)``, or None while open or when it fails."""
        if not self.allows():
            return None
        try:
            out = f(*args)
        except TimeoutError:
            self.failure(timeout=True)
        except Exception:  # noqa: BLE001 - any failure of the backend counts
            self.failure()
        else:
            self.success()
            return out
        return None


def embed(texts: DataFrame, embedder: Embedder, batch: int = 64, abort_after: int = 3) -> DataFrame:
    """``(id, v, ok)`` of ``texts(id, text)``; a text that fails has a null vector.

    A task stops asking after ``abort_after`` failed batches in a row; its remaining texts are
    null too and stay pending for the next run. Vectors with numbers that are not finite fail.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for pdf in frames:
            vs: list = []
            for s in range(0, len(pdf), batch):
                part = pdf["text"].iloc[s : s + batch].tolist()
                got: list = [None] * len(part)
                if failed < abort_after:
                    try:
                        got = [v if v is not None and np.isfinite(v).all() else None for v in embedder(part)]
                        failed = 0
                    except Exception:  # noqa: BLE001 - the backend is not ours
                        failed += 1
                vs += got
            yield pd.DataFrame({"id": pdf["id"], "v": vs, "ok": [v is not None for v in vs]})

    return texts.select("id", "text").mapInPandas(work, "id long, v array<float>, ok boolean")


def pending(passages: DataFrame, vectors: DataFrame, force: bool = False) -> DataFrame:
    """Passages ``(id, text)`` without a vector ``(id)``, or all of them when forced."""
    return passages if force else passages.join(vectors.select("id").distinct(), "id", "left_anti")


def upsert(vectors: DataFrame, fresh: DataFrame, dim: int) -> DataFrame:
    """Vectors ``(id, v)`` after ``fresh`` replaced those of the same id; another dimension is an error."""
    check = F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.concat(F.lit(f"dimension is not {dim}: "), F.size("v").cast("string"))).cast("array<float>"))
    new = fresh.filter(F.col("v").isNotNull()).select("id", check.alias("v"))
    return vectors.select("id", "v").join(new.select("id"), "id", "left_anti").unionByName(new)


def prune(vectors: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, orphans)``: vectors whose passage is there, and those whose passage is gone."""
    ids = passages.select("id").distinct()
    return vectors.join(ids, "id", "left_semi"), vectors.join(ids, "id", "left_anti")


def backfill(passages: DataFrame, vectors: DataFrame, embedder: Embedder, dim: int, limit: int | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(vectors after, report)``: embeds what is pending (the first ``limit`` by id where one is given).

    ``report`` is one row ``(embedded, failed, remaining)``.
    """
    from loreforge.session import table

    todo = pending(passages, vectors, force)
    few = todo if limit is None else todo.orderBy("id").limit(limit)
    made = table(embed(few, embedder), "embedded")
    after = upsert(vectors, made.filter("ok"), dim)
    left = pending(passages, after).agg(F.count("*").alias("remaining"))
    counts = made.agg(F.count_if("ok").alias("embedded"), F.count_if(~F.col("ok")).alias("failed"))
    return after, counts.crossJoin(left)
