"""Exact nearest neighbours of a stated set of query vectors.

The vectors stay where they are: each task multiplies its batches with the queries and
keeps k rows per query, so what is shuffled does not depend on the number of vectors per
task. Queries are sent to the tasks in slices of at most ``SLICE``; more of them take more
passes. A task multiplies ``BLOCK`` queries with ``ROWS`` vectors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 20_000
BLOCK, ROWS = 2_000, 1_000


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, t: s + t)


def unit(v: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def similarity_from_distance(d: Column) -> Column:
    return 1 - d * d / 2


def nearest(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, same: bool = True) -> DataFrame:
    """``(qid, id, distance, similarity, rank)``: the k nearest of ``vectors(id, v)`` by distance of unit vectors.

    ``queries(qid, v)``; where they are the ``same`` records as the vectors, none is its own
    neighbour, else ids on both sides have nothing to do with each other. With a column ``grp`` on both sides, vectors of the query's own group
    are skipped. Null vectors take no part, a vector of another dimension than the query is
    never its neighbour, zero vectors are at distance 1 of all others. Ties go to the smaller
    id. ``floor`` drops neighbours below a similarity after the cut to k.
    """
    named = "grp" in queries.columns and "grp" in vectors.columns
    grouped = named or not same  # without names no two are of one group
    asked = queries.filter(F.col("v").isNotNull()).select("qid", "v", (F.col("grp") if named else F.lit(None)).cast("long").alias("grp"))
    slices = max(1, -(-asked.count() // SLICE))
    source = vectors.filter(F.col("v").isNotNull()).select("id", "v", (F.col("grp") if named else F.lit(None)).cast("long").alias("grp"))
    out = None
    for s in range(slices):
        part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(slices)) == s).collect()  # one slice of a stated query set
        by_dim: dict[int, tuple] = {}
        for r in part:
            by_dim.setdefault(len(r["v"]), ([], [], []))
            ids, vs, gs = by_dim[len(r["v"])]
            ids.append(r["qid"])
            vs.append(r["v"])
            gs.append(-1 if r["grp"] is None else r["grp"])
        blocks = [(d, np.array(i[b : b + BLOCK]), _unit(np.array(v[b : b + BLOCK], float)), np.array(g[b : b + BLOCK])) for d, (i, v, g) in by_dim.items() for b in range(0, len(i), BLOCK)]
        sent = vectors.sparkSession.sparkContext.broadcast(blocks)
        found = source.mapInPandas(_scan(sent, k, grouped), "qid long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("qid").orderBy("distance", "id")
    top = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    top = top.withColumn("similarity", F.round(similarity_from_distance(F.col("distance")), 9))
    return top if floor is None else top.filter(F.col("similarity") >= floor)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _better(held: tuple | None, k: int, qid: np.ndarray, q: np.ndarray, grp: np.ndarray, ids: np.ndarray, v: np.ndarray, group: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a block of queries, ``(distances, ids)``, after more vectors; ``held`` are those so far."""
    # zero vectors: the squared lengths are not both one
    d2 = (v**2).sum(1)[None] + (q**2).sum(1)[:, None] - 2 * q @ v.T
    dist = np.round(np.sqrt(np.maximum(d2, 0)), 9)
    dist[(qid[:, None] == ids[None]) if group is None else (grp[:, None] == group[None])] = np.inf
    every = np.broadcast_to(ids, dist.shape)
    if held is not None:
        dist, every = np.hstack([held[0], dist]), np.hstack([held[1], every])
    if dist.shape[1] > k:
        pick = np.lexsort((every, dist), axis=1)[:, :k]
        dist, every = np.take_along_axis(dist, pick, 1), np.take_along_axis(every, pick, 1)
    return dist, np.array(every)


def _scan(sent, k: int, grouped: bool):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for pdf in frames:
            dims = pdf["v"].map(len).to_numpy()
            for dim in {d for d, *_ in sent.value}:
                rows = np.flatnonzero(dims == dim)
                for s in range(0, len(rows), ROWS):
                    at = rows[s : s + ROWS]
                    v, ids = _unit(np.stack(pdf["v"].to_numpy()[at]).astype(float)), pdf["id"].to_numpy()[at]
                    group = pdf["grp"].to_numpy()[at] if grouped else None
                    for b, (d, qid, q, grp) in enumerate(sent.value):
                        if d == dim:
                            best[b] = _better(best.get(b), k, qid, q, grp, ids, v, group)
        for b, (dist, allid) in best.items():
            qid = sent.value[b][1]
            ok = np.isfinite(dist)
            yield pd.DataFrame({"qid": np.broadcast_to(qid[:, None], dist.shape)[ok], "id": allid[ok], "distance": dist[ok]})

    return work
