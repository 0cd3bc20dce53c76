"""Near-duplicate texts by pigeonhole blocks of minhash fingerprints.

A text's fingerprint is one minhash slot per hash function over its set of word shingles;
the share of equal slots of two texts estimates their similarity. The fingerprint is split
into ``blocks`` blocks of ``slots`` slots each. Pigeonhole: two fingerprints that differ in
fewer than ``blocks`` slots must agree on a whole block; further apart, they still do with
probability ``1 - (1 - s**slots)**blocks``. Texts meet when a block is equal, are verified
by the Hamming distance of fingerprints packed to two bits a slot, and then exactly. Texts
with equal shingle sets (by a hash of 128 bits) are one record until the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm import minhash, runs
from loreforge.llm.words import Hashes
from loreforge.operators.joins import hot_key_join
from loreforge.session import table

RECALL = 0.998
FLUSH = 200_000  # shingles that leave a task at once
_WORD = re.compile(r"[^\W_]+")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits after lower-casing; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plan(records: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """``(blocks, slots)``: more slots for more records, as many blocks as the recall needs at the threshold."""
    slots = max(2, round(math.log2(max(records, 2)) / 6))
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**slots)) if threshold < 1 else 1, slots


def shingles(texts: DataFrame, size: int, least_words: int) -> DataFrame:
    """``(id, k1, k2, shingles array<long>)``: distinct sorted hashes of ``size`` consecutive words of ``texts(id, text)``.

    ``k1`` and ``k2`` are two hashes of the whole set. Texts with fewer than ``least_words``
    words (null and empty ones too) take no part. Output leaves in slices of bounded size,
    however long the texts are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mult = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(size)]
        of = Hashes().__getitem__
        ids, sets, held = [], [], 0

        def rows() -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum([len(p) for p in sets])]).astype(np.int32)
            keys = [pa.array([xxhash.xxh64_intdigest(p.tobytes(), seed) for p in sets], pa.uint64()).view(pa.int64()) for seed in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *keys, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], ["id", "k1", "k2", "shingles"])

        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                found = _WORD.findall(text.as_py().lower())
                if len(found) < max(least_words, size):
                    continue
                w = np.fromiter(map(of, found), np.uint64, len(found))
                n = len(w) - size + 1
                h = np.zeros(n, np.uint64)
                for k in range(size):
                    h = (h ^ (h >> np.uint64(29))) + w[k : k + n] * mult[k]
                ids.append(i)
                sets.append(np.unique(h ^ (h >> np.uint64(32))).view(np.int64))
                held += n
                if held >= FLUSH:
                    yield rows()
                    ids, sets, held = [], [], 0
        if ids:
            yield rows()

    some = texts.filter(F.col("id").isNotNull() & (F.length("text") > 0)).select("id", "text")
    return some.mapInArrow(work, "id long, k1 long, k2 long, shingles array<long>")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members(class_id, id), reps(id, shingles))``; texts with equal shingle sets are one class, named by its smallest id.

    Only ids and hashes are shuffled for it. ``reps`` is picked from ``sets`` when read.
    """
    slim = sets.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("id", "k.k1", "k.k2")
    named = slim.groupBy("k1", "k2").agg(F.min("id").alias("class_id"))
    members = table(hot_key_join(slim.withColumn("k", F.struct("k1", "k2")), named.select(F.struct("k1", "k2").alias("k"), "class_id"), "k").select("class_id", "id", "k1", "k2"), "members")
    firsts = members.filter(F.col("id") == F.col("class_id")).select("id", "k1", "k2")
    return members.select("class_id", "id"), sets.join(firsts, ["id", "k1", "k2"], "left_semi").select("id", "shingles")


def _width(threshold: float) -> int:
    """64-bit words of a packed fingerprint, 32 slots each."""
    return 4 if threshold < 0.7 else 2


def _hamming(threshold: float):
    width = _width(threshold)
    n, p = 32 * width, threshold + (1 - threshold) / 4  # unequal slots agree in two bits by chance
    least = math.floor(n * p - 4.5 * math.sqrt(n * p * (1 - p)))  # equal slots; farther pairs are below the threshold
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)

    def test(b: runs.Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        f = [b.column(f"f{k}").view(np.uint64) for k in range(width)]
        for i, j in runs.lags(b):
            for c in range(0, len(i), 100_000):
                p, q = i[c : c + 100_000], j[c : c + 100_000]
                differ = np.zeros(len(p), np.int64)
                for x in f:
                    d = x[p] ^ x[q]
                    differ += np.bitwise_count((d | (d >> one)) & odd)
                ok = n - differ >= least
                yield p[ok], q[ok]

    return test


def near_pairs(reps: DataFrame, threshold: float, recall: float = RECALL, records: int | None = None) -> DataFrame:
    """``(id_a, id_b, similarity)`` of distinct shingle sets ``reps(id, shingles)`` with Jaccard similarity >= threshold.

    Keys, ids and packed fingerprints are shuffled; shingles only of the pairs that pass the Hamming test.
    """
    blocks, slots = plan(reps.count() if records is None else records, threshold, recall)
    width = _width(threshold)
    a, b = minhash.seeds(max(blocks * slots, 32 * width), seed=4)
    shift = (2 * np.arange(32)).astype(np.uint64)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1_000):
                part = batch.slice(s, 1_000)
                lists = part.column("shingles")
                off = lists.offsets.to_numpy()
                vals = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
                sig = minhash.signatures(vals, off - off[0], a, b, 50_000)
                low = (sig[:, : 32 * width] & np.uint32(3)).astype(np.uint64).reshape(len(sig), width, 32)
                packed = np.bitwise_or.reduce(low << shift, axis=2).view(np.int64)
                prints = [pa.array(packed[:, k]) for k in range(width)]
                for k in range(blocks):
                    key = minhash.mix(sig[:, k * slots : (k + 1) * slots], k)
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column("id"), *prints], ["key", "id", *(f"f{x}" for x in range(width))])

    schema = "key long, id long, " + ", ".join(f"f{k} long" for k in range(width))
    near = table(runs.pairs_in_runs(reps, lambda r: r.mapInArrow(fingerprint, schema), _hamming(threshold)), "near")
    sides = near.select("id_a", "id_b", F.lit(0).alias("s"), F.col("id_a").alias("id")).unionByName(near.select("id_a", "id_b", F.lit(1).alias("s"), F.col("id_b").alias("id")))
    own = reps.join(sides, "id").groupBy("id_a", "id_b")
    both = own.agg(*[F.first(F.when(F.col("s") == k, F.col("shingles")), ignorenulls=True).alias(c) for k, c in ((0, "x"), (1, "y"))])
    n = F.size(F.array_intersect("x", "y"))
    sim = F.col("n") / (F.size("x") + F.size("y") - F.col("n"))
    return both.withColumn("n", n).withColumn("similarity", sim).filter(F.col("similarity") >= threshold - 1e-9).select("id_a", "id_b", "similarity")


def near_duplicates(texts: DataFrame, size: int = 5, threshold: float = 0.8, least_words: int = 10, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """``(members(class_id, id), pairs(id_a, id_b, similarity))`` of ``texts(id, text)``.

    ``pairs`` are pairs of class representatives, smaller id first. Extra columns are
    ignored; repeated rows of one id count once; an empty table gives empty results.
    """
    sets = table(shingles(texts.select("id", "text"), size, least_words), "shingles")
    members, reps = classes(sets)
    return members, near_pairs(reps, threshold, recall, members.filter(F.col("id") == F.col("class_id")).count())


def with_short(texts: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``members(class_id, id)`` and beside them every id of ``texts(id, text)`` that has no shingles of ``size`` words.

    Such texts are in one class when their words are the same in the same order, or, without
    any word, when the texts are the same; a null text is a class of its own.
    """
    w = words(F.col("text"))
    key = F.when(F.size(w) > 0, F.to_json(w)).otherwise(F.to_json(F.struct("text")))
    key = F.coalesce(F.when(F.col("text").isNotNull(), key), F.concat(F.lit("null "), F.col("id").cast("string")))
    short = texts.filter(F.col("id").isNotNull() & (F.size(w) < size)).select("id", key.alias("_k")).groupBy("id").agg(F.min("_k").alias("_k"))
    short = table(short.join(members.select("id"), "id", "left_anti"), "short")
    firsts = short.groupBy("_k").agg(F.min("id").alias("class_id"))
    return members.select("class_id", "id").unionByName(hot_key_join(short, firsts, "_k").select("class_id", "id"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, group_id)``: connected groups of near-duplicates, named by their smallest id.

    Large-star/small-star label propagation on class representatives; each round is a
    join and an aggregation, and no component is ever held in one place.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = table(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).distinct(), "edges")
    while True:
        sym = both(edges)
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = hot_key_join(sym, low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter(F.col("u") != F.col("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = hot_key_join(down, low2, "u")
        nxt = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        nxt = table(nxt, "edges")
        changed = nxt.exceptAll(edges).limit(1).count() + edges.exceptAll(nxt).limit(1).count()
        edges = nxt
        if not changed:
            break
    tops = edges.select(F.col("u").alias("class_id"), F.col("v").alias("top"))
    return hot_key_join(members, tops, "class_id", "left").select("id", F.coalesce("top", "class_id").alias("group_id"))
