"""References to records that do not exist: signed counts per key, kept from change deltas.

A *delta* is one row ``(target, key, at, refs, alive, archived)``: ``refs``, ``alive`` and
``archived`` are +1/-1 for a reference, a record or an archived record that came or went,
``at`` is when the record was loaded (null for references and archived records). Summing
deltas per ``(target, key, at)`` gives the state, from which rows with nothing but zeros are
dropped. Everything can be taken back: a record that goes with -1 at its own load leaves no
trace, and the first load of a key is the earliest that still counts.

Deltas add up in any order, so the state can be kept from day to day (``apply_deltas``)
without reading the tables again, and a key that a third of all rows refer to is one
pre-aggregated row per task. Keys with positive references and no existence are the orphans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.operators.joins import hot_key_join

COUNTS = ("refs", "alive", "archived")


def _delta(rows: DataFrame, target, key: str, what: str, sign: int, at) -> DataFrame:
    counts = [F.lit(sign if c == what else 0).cast("long").alias(c) for c in COUNTS]
    return rows.filter(F.col(key).isNotNull()).select(target.alias("target"), F.col(key).cast("long").alias("key"), at.cast("timestamp").alias("at"), *counts)


def reference_deltas(children: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of ``children(target, ref_id, ...)``; null references count for nothing."""
    return _delta(children, F.col("target"), "ref_id", "refs", sign, F.lit(None))


def existence_deltas(records: DataFrame, target: str, key: str, sign: int = 1, loaded: str | None = None, archived: bool = False) -> DataFrame:
    """Deltas of the records of ``target``; a record that went has ``sign`` -1 at the load it came with, an archived one counts apart."""
    return _delta(records, F.lit(target), key, "archived" if archived else "alive", sign, F.col(loaded) if loaded else F.lit(None))


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The state after ``deltas``; rows whose counts are all zero leave it. ``state`` may be None."""
    parts = [d for d in (state, *deltas) if d is not None]
    rows = parts[0]
    for d in parts[1:]:
        rows = rows.unionByName(d)
    some = F.lit(False)
    for c in COUNTS:
        some = some | (F.col(c) != 0)
    return rows.groupBy("target", "key", "at").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter(some)


def key_facts(state: DataFrame) -> DataFrame:
    """``(target, key, refs, alive, archived, first_load)``: what the state says of each key."""
    first = F.min(F.when(F.col("alive") > 0, F.col("at")))
    return state.groupBy("target", "key").agg(*[F.sum(c).alias(c) for c in COUNTS], first.alias("first_load"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence, ``archived`` or ``missing``."""
    return key_facts(state).filter((F.col("refs") > 0) & (F.col("alive") <= 0)).select(
        "target", "key", "refs", F.when(F.col("archived") > 0, "archived").otherwise("missing").alias("reason")
    )


def broken_references(children: DataFrame, state: DataFrame) -> DataFrame:
    """``children(child_table, child_id, target, ref_id, first_load)`` whose target is missing, archived or late.

    One row per child; ``period`` is the month of the child's first load, null where
    that is unknown (such a child is never ``late``). Equal load times are not late.
    A target with an unknown first load is not late.
    """
    key = F.concat_ws(":", "target", F.col("key").cast("string"))
    have = key_facts(state).select(key.alias("_k"), F.col("alive"), F.col("archived"), F.col("first_load").alias("_since"))
    refs = children.filter(F.col("ref_id").isNotNull()).withColumn("_k", F.concat_ws(":", "target", F.col("ref_id").cast("string")))
    reason = (
        F.when(F.coalesce(F.col("alive"), F.lit(0)) > 0, F.when(F.col("_since") > F.col("first_load"), "late"))
        .when(F.coalesce(F.col("archived"), F.lit(0)) > 0, "archived")
        .otherwise("missing")
    )
    return (
        hot_key_join(refs, have, "_k", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("child_table", "child_id", "ref_id", "reason", F.date_format("first_load", "yyyy-MM").alias("period"))
    )


def reference_changes(rows: DataFrame, period, now, key: str, value: str, target: str, order=None) -> list[DataFrame]:
    """Deltas of one reference per key for the rows of ``rows`` whose ``period`` is ``now``.

    The reference of a key is that of its greatest row by ``order``, or of its first row
    (``loaded_at``) without one. Only keys with a row in this period are looked at: what they
    referred to before is taken back, what they refer to now is added. Periods are in order, a
    null period comes first.
    """
    least = F.struct(F.col("loaded_at").isNotNull() if order is not None else F.col("loaded_at").isNull(), F.col("loaded_at"))
    pick = F.max_by(F.struct(F.col(value).alias("v")), order) if order is not None else F.min_by(F.struct(F.col(value).alias("v")), least)
    here = rows.filter(period.eqNullSafe(F.lit(now)))
    upto = rows.filter(period.isNull() if now is None else period.isNull() | (period <= F.lit(now)))
    before = rows.filter(F.lit(False) if now is None else period.isNull() | (period < F.lit(now)))
    keys = here.select(key).distinct()
    ref = lambda df: df.join(keys, key, "left_semi").groupBy(key).agg(pick.alias("p")).select(F.lit(target).alias("target"), F.col("p.v").alias("ref_id"))
    return [reference_deltas(ref(before), -1), reference_deltas(ref(upto))]


def knowledge_store_references(lessons: DataFrame, archive: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(children, state)`` of the three references of the store; each input may hold versions and repeats."""
    first = F.min("loaded_at").alias("first_load")
    les = lessons.groupBy("id").agg(F.max_by("repeats", F.struct("updated_at", "loaded_at")).alias("ref_id"), first)
    chu = chunks.groupBy("id").agg(F.min_by("lesson_id", F.struct(F.col("loaded_at").isNull(), F.col("loaded_at"))).alias("ref_id"), first)
    emb = embeddings.groupBy(F.col("chunk_id").alias("id")).agg(first).withColumn("ref_id", F.col("id"))

    def child(df: DataFrame, name: str, target: str) -> DataFrame:
        cols = [F.lit(name).alias("child_table"), F.col("id").alias("child_id"), F.lit(target).alias("target"), "ref_id", "first_load"]
        return df.filter(F.col("id").isNotNull()).select(*cols)

    children = child(chu, "lesson_chunks", "lessons").unionByName(child(emb, "chunk_embeddings", "lesson_chunks")).unionByName(child(les, "lessons", "lessons"))
    state = apply_deltas(
        None,
        reference_deltas(children),
        existence_deltas(les, "lessons", "id", loaded="first_load"),
        existence_deltas(archive, "lessons", "id", archived=True),
        existence_deltas(chu, "lesson_chunks", "id", loaded="first_load"),
    )
    return children, state
