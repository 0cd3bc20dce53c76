from datetime import datetime as dt

from pyspark.sql import functions as F

from loreforge.operators import references as ref
from loreforge.operators.joins import hot_key_join, hot_keys


def tables(spark):
    t = dt(2024, 3, 1)
    les = [(1, t, t, None), (2, t, t, 1), (3, t, t, 77), (4, t, t, 88), (None, t, t, 1), (2, t, dt(2024, 5, 1), 1)]
    chu = [(10, 1, dt(2024, 2, 1)), (11, 1, dt(2024, 4, 1)), (12, 88, dt(2024, 4, 1)), (13, None, t), (14, 5, None), (10, 1, dt(2024, 6, 1))]
    emb = [(10, dt(2024, 2, 1)), (11, dt(2024, 3, 1)), (50, t)]
    return (
        spark.createDataFrame(les, "id long, updated_at timestamp, loaded_at timestamp, repeats long"),
        spark.createDataFrame([(88,), (None,)], "id long"),
        spark.createDataFrame(chu, "id long, lesson_id long, loaded_at timestamp"),
        spark.createDataFrame(emb, "chunk_id long, loaded_at timestamp"),
    )


def test_reasons(spark):
    found = ref.broken_references(*ref.knowledge_store_references(*tables(spark)))
    assert {tuple(r) for r in found.collect()} == {
        ("lesson_chunks", 10, 1, "late", "2024-02"),
        ("lesson_chunks", 12, 88, "archived", "2024-04"),
        ("lesson_chunks", 14, 5, "missing", None),
        ("chunk_embeddings", 11, 11, "late", "2024-03"),
        ("chunk_embeddings", 50, 50, "missing", "2024-03"),
        ("lessons", 3, 77, "missing", "2024-03"),
        ("lessons", 4, 88, "archived", "2024-03"),
    }


def test_deltas_add_up_in_any_order(spark):
    kids = spark.createDataFrame([("t", 1), ("t", 1), ("t", 2), ("t", None)], "target string, ref_id long")
    recs = spark.createDataFrame([(1,), (3,)], "id long")
    plus = [ref.reference_deltas(kids), ref.existence_deltas(recs, "t", "id")]
    state = ref.apply_deltas(None, *plus)
    assert {(r["key"], r["refs"], r["reason"]) for r in ref.orphan_keys(state).collect()} == {(2, 1, "missing")}
    gone = ref.existence_deltas(recs.filter("id = 1"), "t", "id", sign=-1)
    later = ref.apply_deltas(state, gone)
    assert {(r["key"], r["refs"]) for r in ref.orphan_keys(later).collect()} == {(1, 2), (2, 1)}
    assert ref.apply_deltas(later, ref.existence_deltas(recs.filter("id = 3"), "t", "id", sign=-1)).filter("key = 3").count() == 0


def test_a_load_can_be_taken_back(spark):
    loads = spark.createDataFrame([(1, dt(2024, 1, 1)), (1, dt(2024, 3, 1)), (2, None)], "id long, loaded_at timestamp")
    state = ref.apply_deltas(None, ref.existence_deltas(loads, "t", "id", loaded="loaded_at"))
    first = lambda s: {r["key"]: r["first_load"] for r in ref.key_facts(s).collect()}
    assert first(state) == {1: dt(2024, 1, 1), 2: None}
    state = ref.apply_deltas(state, ref.existence_deltas(loads.filter("loaded_at < timestamp'2024-02-01'"), "t", "id", sign=-1, loaded="loaded_at"))
    assert first(state) == {1: dt(2024, 3, 1), 2: None}
    kids = spark.createDataFrame([("c", 9, "t", 1, dt(2024, 2, 1))], "child_table string, child_id long, target string, ref_id long, first_load timestamp")
    assert [r["reason"] for r in ref.broken_references(kids, state).collect()] == ["late"]


def test_empty_tables(spark):
    empty = [df.limit(0) for df in tables(spark)]
    assert ref.broken_references(*ref.knowledge_store_references(*empty)).count() == 0


def test_hot_keys_are_joined_apart_with_the_same_rows(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 50).cast("long").alias("k"), F.col("id").alias("v"))
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    assert hot_keys(many, "k", least=500) == [7]
    for how in ("inner", "left"):
        a, b = hot_key_join(many, one, "k", how, hot=[7]), many.join(one, "k", how)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
