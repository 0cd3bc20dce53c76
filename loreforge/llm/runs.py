"""Candidate pairs among rows that share a key, without ever emitting a group's pairs.

Rows are hashed by key, sorted within their task and streamed through Arrow; the pairs
of one run of equal keys are formed inside the task, lag by lag, tested at once, and
only those that pass leave it. Keys that hold ``HOT_ROWS`` rows or more are split into
blocks: each pair of blocks is a task of its own (so no task holds more than two
blocks of a group), and every pair of rows meets in exactly one of them. Where rows have
a longer prefix to go by, hot keys are first deepened by it.

Which keys are hot is only a matter of how work is laid out, so it is estimated from the
rows of one id in ``PROBE``; a key taken wrongly for hot, or not, changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.session import counted_table

HOT_ROWS = 20_000
BLOCK = 5_000
PROBE = 16
LISTED = 100_000  # hot keys are broadcast up to so many; beyond that they are joined with a salt
SALT = 64
CHUNK = 20_000


class Batch:
    """Consecutive rows in key order: ``key``, ``id``, ``side`` and the payload as ``values``/``offsets``."""

    def __init__(self, t: pa.Table):
        self.table = t
        self.key = t["key"].to_numpy()
        self.id = t["id"].to_numpy()
        self.side = t["side"].to_numpy()
        if "payload" in t.column_names:
            lists = t["payload"].combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
            self.offsets = lists.offsets.to_numpy()
            self.values = lists.values.to_numpy(zero_copy_only=False)

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()

    def matrix(self, width: int) -> np.ndarray:
        """The payload as rows of ``width`` numbers."""
        return self.values[self.offsets[0] : self.offsets[-1]].reshape(-1, width)


def hot_sizes(probe: DataFrame, hot_rows: int, share: int) -> tuple[DataFrame, int]:
    """``(key, _n)`` of the keys that hold about ``hot_rows`` rows or more by a probe of one row in ``share``, and how many there are."""
    least = max(2, 0.7 * hot_rows / share)  # 20,000 rows give 1,250 +- 35 in the probe
    sizes = probe.groupBy("key").agg((F.count("*") * share).alias("_n")).filter(F.col("_n") >= least * share)
    return counted_table(sizes, F.lit(True), "hot")


def _marked(rows: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``_n``, null for keys that are not hot."""
    if n <= LISTED:
        return rows.join(F.broadcast(sizes), "key", "left")
    salted = sizes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["key", "_s"], "left").drop("_s")


def split_hot(rows: DataFrame, probe: DataFrame, hot_rows: int = HOT_ROWS, block: int = BLOCK, deeper: Column | None = None, share: int = PROBE) -> DataFrame:
    """Adds ``side``; rows of hot keys are repeated once per pair of blocks that holds them.

    ``probe`` are the rows of one id in ``share``. With ``deeper`` a hot key is first
    narrowed by that column, and split only if it is still hot.
    """
    cols = rows.columns
    sizes, n = hot_sizes(probe, hot_rows, share)
    if n and deeper is not None:
        narrow = F.when(F.col("_n").isNotNull(), F.xxhash64("key", deeper)).otherwise(F.col("key"))
        rows, probe = (_marked(x, sizes, n).withColumn("key", narrow).select(*cols) for x in (rows, probe))
        sizes, n = hot_sizes(probe, hot_rows, share)
    if not n:
        return rows.withColumn("side", F.lit(2).cast("int"))
    all_ = _marked(rows, sizes, n).withColumn("_g", F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int"))
    all_ = all_.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int"))
    all_ = all_.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    key = F.when(F.col("_n").isNull(), F.col("key")).otherwise(F.xxhash64("key", low, high))
    return all_.withColumn("side", side.cast("int")).withColumn("key", key).select(*cols, "side")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal keys."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))  # start of the last run
        if cut:
            yield pa.Table.from_batches([*kept, b.slice(0, cut)])
            kept = [b.slice(cut)]
        elif kept and kept[-1].column("key")[0].as_py() != key[0]:
            yield pa.Table.from_batches(kept)
            kept = [b]
        else:
            kept.append(b)
    if kept:
        yield pa.Table.from_batches(kept)


def lags(b: Batch, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``(i, j)`` of one run, or of one ``group`` within a run, by growing distance in the sorted order.

    ``near(i, j)`` ends the walk of a row: once false for ``j`` it must be false for all later.
    Pairs of several distances come together, about ``CHUNK`` at a time.
    """
    key = b.key if group is None else group
    n, k, held = len(key), 1, 0
    i = np.arange(n - 1)
    first, second = [], []
    while len(i):
        i = i[i + k < n]
        i = i[key[i + k] == key[i]]
        if near is not None and len(i):
            i = i[near(i, i + k)]
        both = i[(b.side[i] == 2) | (b.side[i] != b.side[i + k])]
        if len(both):
            first.append(both)
            second.append(both + k)
            held += len(both)
        if held >= CHUNK or (held and not len(i)):
            yield np.concatenate(first), np.concatenate(second)
            first, second, held = [], [], 0
        k += 1
    if held:
        yield np.concatenate(first), np.concatenate(second)


def pairs_in_runs(
    records: DataFrame,
    place: Callable[[DataFrame], DataFrame],
    test: Callable[[Batch], Iterator[tuple[np.ndarray, np.ndarray]]],
    order: str | None = None,
    deeper: Column | None = None,
    hot_rows: int = HOT_ROWS,
    share: int = PROBE,
) -> DataFrame:
    """Distinct ``(id_a, id_b)``, smaller first, of rows with one ``key`` that pass ``test``.

    ``place(records)`` gives rows ``(key long, id long, ...)``, any number for each record;
    ``test`` gets a batch of whole runs, sorted by ``order``, and yields arrays of passing indexes.
    """
    probe = place(records.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(share)) == 0))
    spread = split_hot(place(records), probe, hot_rows, deeper=deeper, share=share)
    spread = spread.repartition("key").sortWithinPartitions("key", *([order] if order else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            b = Batch(t)
            found = [np.empty((0, 2), np.int64)]
            for i, j in test(b):
                if len(i):
                    ids = np.stack([b.id[i], b.id[j]], 1)
                    found.append(np.sort(ids[ids[:, 0] != ids[:, 1]], 1))
            out = np.unique(np.concatenate(found), axis=0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["id_a", "id_b"])

    return spread.mapInArrow(work, "id_a long, id_b long").distinct()


def expand_pairs(pairs: DataFrame, members: DataFrame, block: int = 2_000) -> DataFrame:
    """Pairs of classes ``(id_a, id_b)`` to all pairs of their members, and the pairs inside each class.

    ``members(class_id, id)``. A large class is salted: its rows on one side are spread over
    tasks of at most ``block`` rows, its rows on the other side repeated for each.
    """
    sizes = members.groupBy("class_id").agg(F.count("*").alias("_n")).withColumn("_g", F.ceil(F.col("_n") / block).cast("int"))
    both = pairs.select("id_a", "id_b").unionByName(sizes.filter(F.col("_n") > 1).select(F.col("class_id").alias("id_a"), F.col("class_id").alias("id_b")))
    left = both.join(sizes.select(F.col("class_id").alias("id_a"), "_g"), "id_a").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    salted = members.join(sizes, "class_id").select(F.col("class_id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("_g")).cast("int").alias("_s"), F.col("id").alias("a"))
    left = left.join(salted, ["id_a", "_s"]).select("id_a", "id_b", "a")
    right = members.select(F.col("class_id").alias("id_b"), F.col("id").alias("b"))
    out = left.join(right, "id_b").filter((F.col("id_a") != F.col("id_b")) | (F.col("a") < F.col("b")))
    return out.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def links_per_id(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, class_id, copies, links)``: one row per member, without expanding pairs.

    ``copies`` counts the members of the own class, ``links`` the other members within it and
    all members of similar classes.
    """
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    ways = pairs.select("id_a", "id_b").unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    near = ways.join(sizes.withColumnRenamed("class_id", "id_b"), "id_b").groupBy(F.col("id_a").alias("class_id")).agg(F.sum("copies").alias("near"))
    facts = sizes.join(near, "class_id", "left").select("class_id", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    from loreforge.operators.joins import hot_key_join

    return hot_key_join(members, facts, "class_id").select("id", "class_id", "copies", "links")
