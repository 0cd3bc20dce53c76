"""Readers of judged sets and stores, and what is made of answers."""

import json
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from loreforge.operators import digest, events, retrieve
from loreforge.sources import files
from loreforge.tables import STORE, create_store, open_store


def test_judged_set(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"lessons": [{"key": "a", "content": "x", "category": "git"}, {"key": "b", "content": "y", "category": "git", "scope": "global"}]}))
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query": "one", "relevant": ["b", "a", "b"]}, {"query": "none", "relevant": [], "requiresSemantic": True}]}))
    docs, judged = files.read_judged(spark, str(tmp_path / "c.json"), str(tmp_path / "q.json"))
    assert [(r["id"], r["key"], r["scope"]) for r in docs.orderBy("id").collect()] == [(1, "a", None), (2, "b", "global")]
    assert [(r["query"], r["semantic"], r["relevant"]) for r in judged.orderBy("query_id").collect()] == [("one", False, [1, 2]), ("none", True, [])]
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query": "one", "relevant": ["zzz"]}]}))
    with pytest.raises(Exception, match="no document with the key zzz"):
        files.read_judged(spark, str(tmp_path / "c.json"), str(tmp_path / "q.json"))[1].collect()


def test_exports_are_confined_and_bounded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text(json.dumps({"export_version": 1, "lessons": [{"id": 1, "content": "x", "tags": ["a"]}], "patterns": []}))
    (tmp_path / "out.json").write_text("{}")
    (tmp_path / "in" / "half.json").write_text('{"export_version": 1, "lessons": [{"content": "half a les')
    assert files.read_export(spark, "e.json", str(tmp_path / "in"))[0].count() == 1
    assert files.read_export(spark, "half.json", str(tmp_path / "in"))[0].count() == 0
    with pytest.raises(ValueError, match="inside"):
        files.read_export(spark, "../out.json", str(tmp_path / "in"))
    with pytest.raises(ValueError, match="lines"):
        files.read_export(spark, "e.json", str(tmp_path / "in"), most=10)


def test_a_store_is_created_once(spark, tmp_path):
    at = str(tmp_path / "s")
    assert {n: df.count() for n, df in open_store(spark, at).items()} == dict.fromkeys(STORE, 0)
    spark.createDataFrame([(1, "x")], "id long, text string").write.parquet(f"{at}/passages")
    made = create_store(spark, at)
    assert made["passages"].count() == 1 and made["lessons"].columns == [c.split()[0] for c in STORE["lessons"].split(", ")]
    assert create_store(spark, at)["vectors"].count() == 0


def test_prompt_text_and_fail_open(spark):
    rows = [(1, 2, 20, "b" * 2_000), (1, 1, 10, "a" * 1_200), (2, 1, 30, None)]
    got = {r["query_id"]: r["text"] for r in retrieve.prompt_text(spark.createDataFrame(rows, "query_id long, rank int, id long, shown string")).collect()}
    assert len(got[1]) == 3_000 and got[1].startswith("### #10\naaa") and "### #20\nbb" in got[1] and got[2] == "### #30\n"
    empty = spark.range(0)
    assert retrieve.fail_open(lambda: spark.range(2), empty).count() == 2
    assert retrieve.fail_open(lambda: spark.range(2).select(F.raise_error(F.lit("broken"))), empty) is empty


def test_addresses(spark):
    names = spark.createDataFrame([("a b+c/ż",), ("plain",)], "name string")
    back = digest.project_listing(names).select("name", digest.named_by(F.col("uri")).alias("n")).collect()
    assert [r["name"] for r in back] == [r["n"] for r in back]
    odd = spark.createDataFrame([("lesson://7",), ("other://x",), ("lesson://",), (None,)], "u string")
    assert [r[0] for r in odd.select(digest.named_by(F.col("u"))).collect()] == ["7", None, None, None]


def test_session_baselines(spark):
    les = spark.createDataFrame([(1, dt(2024, 1, 1, 9)), (2, dt(2024, 1, 1, 12)), (3, dt(2024, 1, 3)), (4, None)], "id long, created_at timestamp")
    s = spark.createDataFrame([("a", dt(2023, 12, 31)), ("b", dt(2024, 1, 1, 12)), ("c", dt(2024, 1, 2)), ("d", dt(2024, 1, 1, 10)), ("e", None)], "session_id string, started timestamp")
    assert {r["session_id"]: r["lessons_before"] for r in events.session_baselines(s, les).collect()} == {"a": 0, "b": 2, "c": 2, "d": 1, "e": None}
