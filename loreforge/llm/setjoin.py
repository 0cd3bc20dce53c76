"""All similar pairs between set-valued records, by forests of sorted minhash sketches.

Each of many independent trees orders the records lexicographically by its own minhash
signature, so that records with a long common prefix are neighbours. Two sets of similarity
``s`` share a prefix of ``d`` slots in one tree with probability ``s**d``, and in one of
``t`` trees with ``1 - (1 - s**d)**t``. ``plan`` takes the depth from the number of records
and plants as many trees as the target recall needs at that depth and at the threshold.

A neighbourhood starts at a shorter prefix (``BASE`` slots less) and is deepened slot by
slot while it is large, but never beyond the planned depth, where the target recall still
holds: small neighbourhoods are compared at the short prefix, which finds more. Neighbours
are verified exactly inside their neighbourhood, and only pairs that pass leave it. Equal
sets are one record until the end.

Layout: a tree's rows are hashed by their short prefix and sorted by the rest of the
signature within a task, which keeps every neighbourhood in one place as one sorted stretch.
A prefix with very many rows is deepened before the shuffle already, and what is large even
then is split into pairs of blocks (see ``runs``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm import minhash, runs
from loreforge.session import table

RECALL = 0.998
BASE = 2  # slots below the planned depth at which a neighbourhood starts
SMALL = 32  # a neighbourhood with at most so many rows is not deepened
SLOT = 20  # bits of a slot in the sort key; slots equal in these only are compared in vain
WIDE = 48  # sets with more members are compared one pair at a time


def plan(records: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """``(depth, trees)`` for so many distinct sets."""
    depth = max(2, round(math.log2(max(records, 2)) / 5))
    trees = math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)) if threshold < 1 else 1
    return depth, trees


def neighbourhoods(key: np.ndarray, rest: np.ndarray, levels: int, small: int = SMALL) -> np.ndarray:
    """The neighbourhood of each row of a sorted stretch, by number.

    Rows with one ``key`` are one neighbourhood; where it has more than ``small`` rows it is
    deepened by the next slot of ``rest``, and so on, at most ``levels`` times.
    """
    n = len(key)
    edge = np.ones(n, bool)
    edge[1:] = key[1:] != key[:-1]
    for level in range(1, levels + 1):
        group = np.cumsum(edge) - 1
        large = np.bincount(group)[group] > small
        if not large.any():
            break
        slot = rest >> np.int64(SLOT * (levels - level))
        edge[1:] |= large[1:] & (slot[1:] != slot[:-1])
    return np.cumsum(edge) - 1


def _verify(threshold: float, levels: int):
    def test(b: runs.Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = np.diff(b.offsets)
        width = int(min(WIDE, n.max(initial=1)))
        cols = np.arange(width)[None, :]
        inside = cols < n[:, None]
        padded = np.where(inside, b.values[np.minimum(b.offsets[:-1, None] + cols, max(len(b.values) - 1, 0))], 0).astype(np.int64)
        left, right = np.where(inside, padded, 1 << 40), np.where(inside, padded, 1 << 41)
        sets: dict[int, frozenset] = {}

        def whole(r: int) -> frozenset:
            if r not in sets:
                sets[r] = frozenset(b.values[b.offsets[r] : b.offsets[r + 1]].tolist())
            return sets[r]

        of = b.column("tables")
        for i, j in runs.lags(b, group=neighbourhoods(b.key, b.column("rest"), levels)):
            apart = (of[i] | of[j]) == 3  # one of them in either table
            i, j = i[apart], j[apart]
            for c in range(0, len(i), 50_000):
                p, q = i[c : c + 50_000], j[c : c + 50_000]
                some = np.minimum(n[p], n[q]) >= threshold * np.maximum(n[p], n[q]) - 1e-9
                p, q = p[some], q[some]
                wide = np.maximum(n[p], n[q]) > WIDE
                same = np.zeros(len(p), np.int64)
                for k in range(width):
                    same += (left[p, k][:, None] == right[q]).any(1)
                for k in np.flatnonzero(wide):
                    same[k] = len(whole(p[k]) & whole(q[k]))
                ok = same >= threshold * (n[p] + n[q] - same) - 1e-9
                yield p[ok], q[ok]

    return test


def classes(sets: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(members(class_id, id), reps(id, items))`` of ``sets(id, items)``; equal sets are one class, named by its smallest id.

    Null sets, null items and sets with fewer than ``least`` distinct items take no part.
    """
    clean = sets.filter(F.col("id").isNotNull()).select("id", F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items"))
    clean = clean.filter(F.size("items") >= least)
    keyed = clean.withColumn("_k", F.to_json("items"))
    reps = keyed.groupBy("_k").agg(F.min("id").alias("class_id"))
    from loreforge.operators.joins import hot_key_join

    members = hot_key_join(keyed, reps, "_k").select("class_id", "id", "items").dropDuplicates(["id"])
    return members.select("class_id", "id"), members.filter(F.col("id") == F.col("class_id")).select("id", "items")


def similar_pairs(reps: DataFrame, threshold: float, recall: float = RECALL, across: bool = False) -> DataFrame:
    """``(id_a, id_b, similarity)`` of distinct sets ``reps(id, items array<string>)`` with Jaccard similarity >= threshold.

    With ``across`` and a column ``tables`` of bits, only sets that share no table alone are compared.
    """
    depth, trees = plan(reps.count(), threshold, recall)
    base = max(1, depth - BASE)
    levels = depth - base
    a, b = minhash.seeds(depth * trees)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2_000):
                part = batch.slice(s, 2_000)
                lists = part.column("h")
                off = lists.offsets.to_numpy()
                vals = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
                off = off - off[0]
                sig = minhash.signatures(vals, off, a, b)
                payload = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array((vals >> 13).astype(np.int32)))
                for t in range(trees):
                    own = sig[:, t * depth : (t + 1) * depth]
                    rest = np.zeros(len(own), np.int64)
                    for k in range(base, depth):
                        rest = (rest << np.int64(SLOT)) | (own[:, k] >> np.uint32(32 - SLOT)).astype(np.int64)
                    cols = [pa.array(minhash.mix(own[:, :base], t)), pa.array(rest), part.column("id"), payload, part.column("tables")]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "rest", "id", "payload", "tables"])

    def place(records: DataFrame) -> DataFrame:
        tables = F.col("tables").cast("byte") if across else F.lit(3).cast("byte").alias("tables")
        hashed = records.select("id", F.transform("items", lambda t: F.xxhash64(t)).alias("h"), tables)
        return hashed.mapInArrow(plant, "key long, rest long, id long, payload array<int>, tables byte")

    near = runs.pairs_in_runs(reps, place, _verify(threshold, levels), order="rest", deeper=F.col("rest") if levels else None)
    x, y = reps.select(F.col("id").alias("id_a"), F.col("items").alias("x")), reps.select(F.col("id").alias("id_b"), F.col("items").alias("y"))
    both = near.join(x, "id_a").join(y, "id_b").withColumn("n", F.size(F.array_intersect("x", "y")))
    sim = F.col("n") / (F.size("x") + F.size("y") - F.col("n"))
    return both.withColumn("similarity", sim).filter(F.col("similarity") >= threshold - 1e-9).select("id_a", "id_b", "similarity")


def similar_between(left: DataFrame, right: DataFrame, threshold: float, least: int = 1, recall: float = RECALL) -> DataFrame:
    """``(id_left, id_right, similarity)`` between two tables ``(id, items)``; ids need not differ between them.

    One forest holds the distinct sets of both, each with the tables it is in, and only pairs
    that reach from one table into the other are compared.
    """
    of = lambda df, bit: df.filter(F.col("id").isNotNull()).select(F.struct(F.lit(bit).alias("of"), F.col("id").cast("long").alias("id")).alias("id"), "items")
    members, reps = classes(of(left, 1).unionByName(of(right, 2)), least)
    tables = members.groupBy("class_id").agg(F.bit_or(F.col("id.of")).alias("tables"))
    # one number per distinct set: a hash of its name, which holds table and id
    number = F.xxhash64(F.col("class_id.of"), F.col("class_id.id")).alias("n")
    members = members.select(number, "id", "class_id")
    sets = reps.withColumnRenamed("id", "class_id").join(tables, "class_id").select(number.alias("id"), "items", "tables")
    sets = table(sets, "sets")
    near = similar_pairs(sets, threshold, recall, across=True)
    near = near.unionByName(sets.filter(F.col("tables") == 3).select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity")))
    own = members.filter(F.col("id.of") == 1).select(F.col("n").alias("l"), F.col("id.id").alias("id_left"))
    other = members.filter(F.col("id.of") == 2).select(F.col("n").alias("r"), F.col("id.id").alias("id_right"))
    ways = near.select(F.col("id_a").alias("l"), F.col("id_b").alias("r"), "similarity").unionByName(
        near.filter("id_a <> id_b").select(F.col("id_b").alias("l"), F.col("id_a").alias("r"), "similarity")
    )
    return ways.join(own, "l").join(other, "r").select("id_left", "id_right", "similarity")
