"""Most similar vectors for every vector, by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random lines. Two vectors *collide* on a line
when their projections lie within a query-centred window; close vectors collide on nearly
all lines, distant ones on about half. Windows start narrow and are doubled (virtual
rehashing: a wider window over the same sorted array) only for queries that have not yet
found ``k`` vectors inside the radius searched; vectors that collide on enough lines are
verified by their cosine.

One line alone would put a fixed share of all vectors into each window, so the sorted
arrays are cut into cells by the signs of further projections: a cell is the unit of work,
``tables`` independent cuts give the target recall, and cells stay near ``CELL`` rows as
the collection grows. Cells with many rows are split into pairs of blocks (see ``runs``).
Vectors travel as 8-bit numbers; what survives is verified with the full ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm import runs
from loreforge.operators.joins import hot_key_join
from loreforge.session import table

RECALL = 0.98
CELL = 64
PROJECTIONS = 32
LEVELS = 3
SLACK = 0.01  # what 8-bit rounding may cost a cosine


def plan(vectors: int, floor: float, recall: float = RECALL) -> tuple[int, int]:
    """``(bits, tables)``: sign bits per cell and independent cuts for pairs at the floor cosine."""
    bits = max(1, round(math.log2(max(vectors, 2) / CELL)))
    p = (1 - math.acos(floor) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """``(id, v)``: one row per id with ``dim`` finite numbers, not all zero; null vectors and ids are left out.

    Several vectors of one id are one record: the smallest in array order.
    """
    good = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return vectors.select("id", "v").filter(F.col("id").isNotNull() & good & some).groupBy("id").agg(F.min("v").alias("v"))


def _window_test(dim: int, floor: float, lines: np.ndarray, most: int | None):
    """Collision counting inside cells; rows come sorted by their first projection."""
    radius = math.sqrt(2 - 2 * floor)
    widths = [2.2 * radius / 2 ** (LEVELS - 1 - r) for r in range(LEVELS)]  # on a line, a pair at the radius differs by about N(0, radius)
    least = math.ceil(PROJECTIONS * 0.972 - 3.5 * math.sqrt(PROJECTIONS * 0.972 * 0.028))

    def test(b: runs.Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        v = b.matrix(dim).astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        on = v @ lines
        first = on[:, 0]
        enough = np.zeros(len(v), np.int64)
        for level, w in enumerate(widths):
            bound = 1 - (radius / 2 ** (LEVELS - 1 - level)) ** 2 / 2
            done = enough >= most if most is not None else np.zeros(len(v), bool)
            enough[:] = np.where(done, enough, 0)
            for i, j in runs.lags(b, lambda i, j, w=w: np.abs(first[j] - first[i]) <= w + 1e-6):
                open_ = ~(done[i] & done[j])
                i, j = i[open_], j[open_]
                for c in range(0, len(i), 50_000):
                    p, q = i[c : c + 50_000], j[c : c + 50_000]
                    hits = (np.abs(on[p] - on[q]) <= w).sum(1) >= least
                    p, q = p[hits], q[hits]
                    cos = np.einsum("ij,ij->i", v[p], v[q])
                    ok = cos >= max(floor, bound) - SLACK
                    p, q = p[ok], q[ok]
                    np.add.at(enough, p, 1)
                    np.add.at(enough, q, 1)
                    yield p, q

    return test


def _representatives(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members(class_id, id), reps(id, v))``; equal vectors (by a hash of 128 bits) are one class, named by its smallest id."""
    keyed = good.withColumn("_k", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    names = keyed.groupBy("_k").agg(F.min("id").alias("class_id"))
    members = hot_key_join(keyed.select("id", "_k"), names, "_k").select("class_id", "id")
    return members, good.join(members.filter(F.col("id") == F.col("class_id")).select("id"), "id", "left_semi")


def close_pairs(reps: DataFrame, dim: int, floor: float, recall: float = RECALL, enough: int | None = None) -> DataFrame:
    """``(id_a, id_b, cosine)`` of distinct vectors with cosine >= floor.

    With ``enough``, a vector's windows are widened only until they hold so many vectors
    inside the radius searched; without it, up to the floor.
    """
    bits, tables = plan(reps.count(), floor, recall)
    rng = np.random.default_rng(7)
    cuts = rng.standard_normal((dim, bits * tables)).astype(np.float32)
    lines = rng.standard_normal((dim, PROJECTIONS)).astype(np.float32)
    weights = (np.int64(1) << np.arange(bits, dtype=np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("v")
            off = lists.offsets.to_numpy()
            v = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(-1, dim).astype(np.float64)
            v = (v / np.abs(v).max(1, keepdims=True)).astype(np.float32)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            small = np.rint(v * (127 / np.abs(v).max(1, keepdims=True))).astype(np.int8)
            at = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim)
            payload = pa.ListArray.from_arrays(at, pa.array(small.ravel()))
            order = pa.array(v @ lines[:, 0])
            for t in range(tables):
                cell = ((v @ cuts[:, t * bits : (t + 1) * bits]) > 0) @ weights + (np.int64(t) << np.int64(40))
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("id"), payload, order], ["key", "id", "payload", "at"])

    schema = "key long, id long, payload array<tinyint>, at float"
    near = runs.pairs_in_runs(reps, lambda r: r.mapInArrow(place, schema), _window_test(dim, floor, lines, enough), order="at")
    x, y = reps.select(F.col("id").alias("id_a"), F.col("v").alias("x")), reps.select(F.col("id").alias("id_b"), F.col("v").alias("y"))
    return near.join(x, "id_a").join(y, "id_b").select("id_a", "id_b", cosine("x", "y").alias("cosine")).filter(F.col("cosine") >= floor)


def cosine(x: str, y: str):
    """Cosine of two array columns in double precision; vectors must not be all zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.least(F.lit(1.0), dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y)))


def top_close(vectors: DataFrame, dim: int = 64, k: int = 5, floor: float = 0.9, recall: float = RECALL) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: of each vector of ``vectors(id, v)``, those of its k most similar with cosine >= floor.

    Ties go to the smaller id. Copies of one vector are compared once: a member's
    neighbours are the first members of its own class (cosine 1) and of the classes near it.
    """
    good = table(usable(vectors, dim), "vectors")
    members, reps = _representatives(good)
    members, reps = table(members, "members"), table(reps, "reps")
    near = close_pairs(reps, dim, floor, recall, enough=2 * (k + 1))
    ways = near.select(F.col("id_a").alias("class_id"), F.col("id_b").alias("other"), "cosine").unionByName(
        near.select(F.col("id_b").alias("class_id"), F.col("id_a").alias("other"), "cosine")
    )
    best = _top(ways, "class_id", "other", k)
    firsts = members.select(F.col("class_id").alias("other"), F.col("id").alias("neighbour"))
    firsts = _rank(firsts, "other", [F.col("neighbour")], k + 1).drop("rank")
    copied = members.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select("class_id", F.col("class_id").alias("other"), F.lit(1.0).alias("cosine"))
    offers = best.drop("rank").unionByName(copied).join(firsts, "other")
    offers = _rank(offers.select("class_id", "neighbour", "cosine"), "class_id", [F.desc("cosine"), F.col("neighbour")], k + 1)
    lists = offers.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))).alias("near"))
    own = hot_key_join(members, lists, "class_id").withColumn("near", F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("id")), 1, k))
    out = own.select("id", F.posexplode("near").alias("rank", "s"))
    return out.select("id", F.col("s.neighbour").alias("neighbour"), (-F.col("s.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def _rank(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def _top(df: DataFrame, by: str, other: str, k: int) -> DataFrame:
    return _rank(df, by, [F.desc("cosine"), F.col(other)], k)


def nearest(queries: DataFrame, vectors: DataFrame, dim: int = 64, k: int = 5, sure: float = 0.997, block: int = 1_024) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: the k most similar of ``vectors(id, v)`` for each of a stated set ``queries(id, v)``, at any cosine.

    Queries are numbered into blocks; each task holds a slice of the vectors, its sorted
    projection arrays, and takes block after block: windows around each query are doubled
    until every query has k vectors inside the radius searched, vectors that collide on
    enough lines are verified, and k rows per query leave the task. A vector is never its
    own neighbour. Ties go to the smaller id.
    """
    good = table(usable(vectors, dim), "vectors")
    asked = good.join(queries.select("id").distinct(), "id", "left_semi")
    n = asked.count()
    parts = max(1, math.ceil(n / block))
    lines = np.random.default_rng(7).standard_normal((dim, PROJECTIONS)).astype(np.float32)
    q = asked.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("b"))
    slices = max(1, math.ceil(good.count() / 30_000))
    left = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = good.withColumn("s", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(slices)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def ask(key, ql, vl):
        import pandas as pd

        if not len(ql) or not len(vl):
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []})
        unit = lambda s: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.stack(s.to_numpy()).astype(np.float64))
        qs, vs = unit(ql["qv"]), unit(vl["v"])
        qi, vi = ql["qid"].to_numpy(), vl["id"].to_numpy()
        qp, vp = (qs @ lines).astype(np.float32), (vs @ lines).astype(np.float32)
        order = np.argsort(vp, axis=0)
        arrays = np.take_along_axis(vp, order, 0)
        out = []
        for a in range(len(qs)):
            radius = 0.25
            while True:
                w = 1.8 * radius
                lo = [np.searchsorted(arrays[:, c], qp[a, c] - w, "left") for c in range(PROJECTIONS)]
                hi = [np.searchsorted(arrays[:, c], qp[a, c] + w, "right") for c in range(PROJECTIONS)]
                hits = np.bincount(np.concatenate([order[x:y, c] for c, (x, y) in enumerate(zip(lo, hi))]), minlength=len(vs))
                p = math.erf(w / radius / math.sqrt(2))
                cand = np.flatnonzero((hits >= PROJECTIONS * p - 3 * math.sqrt(PROJECTIONS * p * (1 - p))) & (vi != qi[a]))
                cos = vs[cand] @ qs[a]
                if (cos >= 1 - radius**2 / 2).sum() >= k or radius >= 2:
                    top = np.lexsort((vi[cand], -np.round(cos, 12)))[:k]
                    out.append((np.full(len(top), qi[a]), vi[cand[top]], np.minimum(cos[top], 1.0)))
                    break
                radius *= math.sqrt(2)
        cols = [np.concatenate(x) for x in zip(*out)]
        return pd.DataFrame({"id": cols[0], "neighbour": cols[1], "cosine": cols[2]})

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(ask, "id long, neighbour long, cosine double")
    return _top(found, "id", "neighbour", k)
