"""Evaluation passages inside training texts, by spaced-seed hashing.

A seed is a mask over consecutive words that reads some positions and ignores others, so a
substituted word need not hide a match. The windows of all passages under all masks form
the index; every text's windows are looked up in it, and pairs of text and passage with a
hit are verified: the longest exact run, the share of the passage's distinct runs of four
words, and on the diagonal with most hits the longest overlap that tolerates single
substitutions.

Why no case is lost: a run of 12 equal words, and half of a passage's runs of four words (or
any share of them), hold a run of four, and every passage is also looked up with the plain
mask of four. The distinct runs are then counted for every pair that has one in common.

The index is sent to every task only in slices of at most ``SLICE`` windows; a larger test
set takes several passes over the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASKS = ("110111", "111011", "101111")
PLAIN = "1111"  # the runs of four that are counted
SLICE = 2_000_000
RUN = 12
SEED_HITS = 5  # windows on one diagonal from which a substitution-tolerant overlap is measured
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKD, removal of combining marks and lower-casing; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        for c in set(text):
            if c > "\u02ff" and unicodedata.combining(c):
                text = text.replace(c, "")
    return _WORD.findall(text.lower())


def _windows(ids: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window of word ids under a mask; 0 where a position read is an unknown word (id 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.full(n, np.uint64(len(mask) * 1_000_003 + int(mask, 2))), np.ones(n, bool)
    for k, bit in enumerate(mask):
        if bit == "1":
            w = ids[k : k + n]
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            known &= w != 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


class Index:
    """The passages' windows: sorted hashes with, for each, the passages and places that hold it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [i for i, _ in items]
        token = [words(p) for _, p in items]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for t in token for w in t}))}
        self.ids = [np.array([self.vocab[w] for w in t], np.uint64) for t in token]
        self.long = np.array([len(x) for x in self.ids], np.int64)
        self.begin = np.cumsum(self.long) - self.long
        self.flat = np.concatenate([*self.ids, np.zeros(0, np.uint64)])
        self.seeds = {m: self._table(m) for m in (*MASKS, PLAIN)}
        self.runs = self._table("1" * RUN)
        self.n_grams = np.array([len(np.unique(_windows(x, PLAIN))) for x in self.ids])

    def _table(self, mask: str):
        hashes, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, x in enumerate(self.ids):
            h = _windows(x, mask)
            hashes.append(h)
            item.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        h, it, pl = (np.concatenate(v) for v in (hashes, item, place))
        order = np.lexsort((pl, it, h))
        h, it, pl = h[order], it[order], pl[order]
        keys, first = np.unique(h, return_index=True)
        return keys, np.append(first, len(h)), it, pl


def _lookup(table, h: np.ndarray):
    """``(window, item, place)`` of every occurrence of the windows ``h`` in a table."""
    keys, first, item, place = table
    if not len(keys) or not len(h):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    win = np.flatnonzero((keys[at] == h) & (h != 0))
    n = first[at[win] + 1] - first[at[win]]
    src = np.repeat(first[at[win]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(win, n), item[src], place[src]


def _tolerant(docs: np.ndarray, doc_at: np.ndarray, doc_n: np.ndarray, items: np.ndarray, item_at: np.ndarray, item_n: np.ndarray, diag: np.ndarray) -> np.ndarray:
    """For each pair, the longest stretch of its diagonal in which mismatches stand alone, at least three matches apart.

    A pair is the words of ``docs`` from ``doc_at`` on, those of ``items`` from ``item_at`` on,
    and the place in the text less that in the passage. All pairs at once: a stretch ends at
    the delimiting mismatches, those that begin it or follow or precede another too closely.
    """
    lo = np.maximum(0, -diag)
    n = np.maximum(np.minimum(item_n, doc_n - diag) - lo, 0)
    pair = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    at = lo[pair] + place
    bad = np.flatnonzero(items[item_at[pair] + at] != docs[doc_at[pair] + diag[pair] + at])
    of, place = pair[bad], place[bad]
    gap = np.where(of[1:] == of[:-1], place[1:] - place[:-1], 1 << 40)
    ends = place == 0
    ends[:-1] |= gap <= 3
    ends[1:] |= gap == 1
    every = np.arange(len(n))
    of, place = np.concatenate([of[ends], every, every]), np.concatenate([place[ends], np.full(len(n), -1), n])
    order = np.lexsort((place, of))
    of, place = of[order], place[order]
    long = np.where(of[1:] == of[:-1], place[1:] - place[:-1] - 1, 0)
    out = np.zeros(len(n), np.int64)
    np.maximum.at(out, of[1:], long)
    return out


def overlaps(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``(id, item_id, seed_hits, run12, shared, tolerant_words)`` of ``texts(id, text)`` and ``items(item_id, passage)``.

    One row per pair with a run of 12 words, or a quarter of the passage's distinct runs of
    four, or a substitution-tolerant overlap of 12 words. ``shared`` is the share of those
    runs (null for a passage of under four words); ``seed_hits`` counts the hits on the best
    diagonal. Null or empty passages and texts match nothing; repeated rows give one row;
    repeated item ids count as one passage, the longest.
    """
    passages = items.filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull())
    passages = passages.groupBy("item_id").agg(F.max_by("passage", F.struct(F.length("passage"), F.col("passage"))).alias("passage"))
    sized = passages.withColumn("w", F.size(F.split("passage", r"\s+")) * (len(MASKS) + 1))
    total = sized.agg(F.sum("w")).first()[0] or 0
    slices = max(1, -(-total // SLICE))
    source = texts.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")
    out = None
    for s in range(slices):
        part = [tuple(r) for r in sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).select("item_id", "passage").collect()]  # at most about SLICE windows
        index = texts.sparkSession.sparkContext.broadcast(Index(part))
        found = source.mapInArrow(_search(index), "id long, item_id long, seed_hits int, run12 boolean, shared double, tolerant_words int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("id", "item_id").agg(*[F.max(c).alias(c) for c in ("seed_hits", "run12", "shared", "tolerant_words")])


def _search(index):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = index.value
        get, n_items = x.vocab.get, len(x.items)
        if not n_items:
            return
        gap = np.zeros(RUN, np.uint64)  # keeps windows from reaching over two texts
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                docs = []
                for t in b.column("text").to_pylist():
                    docs.append(np.array([get(w, 0) for w in words(t)], np.uint64))
                flat = np.concatenate([v for d in docs for v in (d, gap)] or [gap])
                long = np.array([len(d) for d in docs], np.int64)
                begin = np.cumsum(long + RUN) - long - RUN
                pair_of = lambda win, item: (np.searchsorted(begin, win, "right") - 1) * n_items + item
                codes, diags = [], []
                for m, seeds in x.seeds.items():
                    windows = _windows(flat, m)
                    win, item, place = _lookup(seeds, windows)
                    codes.append(pair_of(win, item))
                    diags.append(win - place)
                    if m == PLAIN:
                        common, runs = codes[-1], windows[win]
                code, diag = np.concatenate(codes), np.concatenate(diags)
                if not len(code):
                    continue
                order = np.lexsort((diag, code))
                code, diag = code[order], diag[order]
                edge = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (diag[1:] != diag[:-1])])
                n = np.diff(np.r_[edge, len(code)])
                by = np.lexsort((-n, code[edge]))
                c, dg, n = code[edge][by], diag[edge][by], n[by]
                lead = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                pairs, dg, hits = c[lead], dg[lead], n[lead]
                o = np.lexsort((runs, common))
                common, runs = common[o], runs[o]
                new = np.r_[True, (common[1:] != common[:-1]) | (runs[1:] != runs[:-1])] if len(runs) else np.zeros(0, bool)
                keys, counts = np.unique(common[new], return_counts=True)
                shared_n = np.zeros(len(pairs), np.int64)
                shared_n[np.searchsorted(pairs, keys)] = counts
                win, item, _ = _lookup(x.runs, _windows(flat, "1" * RUN))
                run12 = np.isin(pairs, pair_of(win, item))
                total = x.n_grams[pairs % n_items]
                shared = np.where(total > 0, shared_n / np.maximum(total, 1), np.nan)
                tol = np.zeros(len(pairs), np.int32)
                k = np.flatnonzero(hits >= SEED_HITS)
                d, it = pairs[k] // n_items, pairs[k] % n_items
                tol[k] = _tolerant(flat, begin[d], long[d], x.flat, x.begin[it], x.long[it], dg[k] - begin[d])
                keep = np.flatnonzero(run12 | (shared >= 0.25) | (tol >= RUN))
                if len(keep):
                    ids = b.column("id").take(pa.array(pairs[keep] // n_items))
                    item_ids = pa.array(np.array(x.items, np.int64)[pairs[keep] % n_items])
                    cols = [ids, item_ids, pa.array(hits[keep].astype(np.int32)), pa.array(run12[keep]), pa.array(shared[keep], from_pandas=True), pa.array(tol[keep].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "item_id", "seed_hits", "run12", "shared", "tolerant_words"])

    return work


def leaked(texts: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """``(id, item_id)`` where the text holds 12 consecutive words of the passage or ``share`` of its distinct runs of four."""
    return overlaps(texts, items).filter(F.col("run12") | (F.coalesce("shared", F.lit(0.0)) >= share - 1e-12)).select("id", "item_id")
