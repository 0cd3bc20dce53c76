import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from loreforge.operators import embed, index, knn, metrics, retrieve

DOCS = [
    (1, "The cache of the node_module is stale", "git"), (2, "Restart the cache; the cache again", "sqlite cache"), (3, "node module order is wrong", None),
    (4, "", "git"), (5, "A stale mail relay keeps the module node", "deploy"), (6, "nothing of note", "git"), (7, "cached pages", "docker"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, content string, tags string")


def fts(query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content, tags)")
    con.executemany("insert into t(rowid, content, tags) values (?, ?, ?)", DOCS)
    return {i: round(s, 6) for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (query,))}


@pytest.mark.parametrize("terms, match", [(["cache"], '"cache"'), (["stale", "module"], '"stale" OR "module"'), (["node_module"], '"node module"'), (["git", "note"], '"git" OR "note"')])
def test_bm25_is_that_of_an_independent_engine(spark, docs, terms, match):
    ix = index.build(docs, ["content", "tags"])
    plan = spark.createDataFrame([(1, terms)], "query_id long, terms array<string>")
    got = {r["id"]: round(r["score"], 6) for r in index.bm25(ix, index.phrases(plan, "terms")).collect()}
    assert got == fts(match)


def test_prefix_counts_as_one_phrase(spark, docs):
    ix = index.build(docs, ["content", "tags"])
    plan = spark.createDataFrame([(1, ["cache"])], "query_id long, terms array<string>")
    got = {r["id"]: round(r["score"], 6) for r in index.bm25(ix, index.phrases(plan, "terms"), prefix=True).collect()}
    assert got == fts('"cache" *')


def test_update_equals_rebuild(spark, docs):
    changed = spark.createDataFrame([(2, "all new words", "x"), (9, "cache", None)], docs.schema)
    after = docs.filter("id not in (2, 3)").unionByName(changed)
    a = index.update(index.build(docs, ["content"]), changed, ["content"], docs.filter("id = 3"))
    b = index.build(after, ["content"])
    rows = lambda ix: sorted(map(str, ix.postings.collect())) + sorted(map(str, ix.lengths.collect()))
    assert rows(a) == rows(b)


def test_fusion(spark):
    lists = {n: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id long, id long, rank int") for n, ids in (("a", [1, 2, 3]), ("b", [3, 1]))}
    got = {r["id"]: r["score"] for r in retrieve.rrf(lists, {"a": 1.0, "b": 1.0}).collect()}
    assert sorted(got, key=lambda i: -got[i]) == [1, 3, 2] and math.isclose(got[1], 1 / 61 + 1 / 62)
    dup = {"a": spark.createDataFrame([(1, 7, 1), (1, 7, 2)], "query_id long, id long, rank int")}
    assert [(r["id"], r["score"]) for r in retrieve.rrf(dup, {"a": 1.0}, k=1).collect()] == [(7, 0.5)]


def test_boosts(spark):
    b = lambda n: spark.range(1).select(retrieve.recurrence_boost(F.lit(n)).alias("b")).first()["b"]
    assert (b(0), b(1), b(50)) == (1.0, 1.0, 1.3)
    mix = spark.createDataFrame([("critical",)] * 5 + [("info",)] * 95, "severity string")
    assert {r["severity"]: r["boost"] > 1.2 for r in retrieve.severity_boosts(mix).collect()} == {"critical": True}
    assert retrieve.severity_boosts(mix.limit(0)).count() == 0


def test_nearest_is_exact(spark):
    vs = [(i, [math.cos(i), math.sin(i), 0.1 * (i % 3)]) for i in range(40)] + [(90, [0.0, 0.0, 0.0]), (91, [1.0, 0.0]), (92, None)]
    v = spark.createDataFrame(vs, "id long, v array<double>")
    got = knn.nearest(v.filter("id in (3, 7)").withColumnRenamed("id", "qid"), v, 4).collect()
    full = {i: x for i, x in vs if x and len(x) == 3}
    unit = {i: [a / (math.sqrt(sum(b * b for b in x)) or 1) for a in x] for i, x in full.items()}
    for q in (3, 7):
        want = sorted((round(math.dist(unit[q], u), 9), i) for i, u in unit.items() if i != q)[:4]
        mine = sorted((r["distance"], r["id"]) for r in got if r["qid"] == q)
        assert [i for _, i in mine] == [i for _, i in want] and [d for d, _ in mine] == pytest.approx([d for d, _ in want], abs=1e-8)
    assert knn.nearest(v.limit(0).withColumnRenamed("id", "qid"), v, 4).count() == 0


def test_metrics(spark):
    rows = [(1, [1, 2, 3], [3, 9]), (2, [], [4]), (3, [5], []), (4, [], [])]
    judged = spark.createDataFrame(rows, "query_id long, returned array<long>, relevant array<long>")
    m = metrics.evaluate(judged).first()
    assert (m["recall_5"], m["precision_1"], m["mrr"], m["zero_result_rate"], m["true_negative_rate"]) == (0.25, 0.0, round(1 / 6, 9), 0.5, 0.5)
    assert {r["query_id"] for r in metrics.failures(judged).collect()} == {1, 2, 3}


def test_breaker():
    now, opened = [0.0], []
    b = embed.Breaker(clock=lambda: now[0], on_open=lambda: opened.append(1))
    bad = lambda: 1 / 0
    assert b.call(bad) is None and b.allows()
    b.call(bad)
    assert not b.allows() and opened == [1]
    now[0] = 61
    assert b.call(lambda: 5) == 5 and b.allows()

    def slow():
        raise TimeoutError

    b.call(slow)
    assert not b.allows()


def test_backfill(spark):
    texts = spark.createDataFrame([(1, "some words"), (2, ""), (3, "more words")], "id long, text string")
    have = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<float>")
    after, report = embed.backfill(texts, have, embed.hashing_embedder(2), 2)
    assert tuple(report.first()) == (1, 1, 1) and {r["id"] for r in after.collect()} == {1, 3}

    def down(_):
        raise OSError

    assert tuple(embed.backfill(texts, have, down, 2)[1].first()) == (0, 2, 2)
    with pytest.raises(Exception, match="dimension"):
        embed.upsert(have, spark.createDataFrame([(9, [1.0])], have.schema), 2).collect()


def test_queries_from_elsewhere_may_have_the_ids_of_vectors(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id long, v array<float>")
    q = v.filter("id < 5").withColumnRenamed("id", "qid")
    first = lambda df: {r["qid"]: r["id"] for r in df.filter("rank = 1").collect()}
    assert first(knn.nearest(q, v, 3, same=False)) == {i: i for i in range(5)}
    assert first(knn.nearest(q, v, 3)) == {i: i + 7 for i in range(5)}
    named = lambda df: df.withColumn("grp", F.col(df.columns[0]) % 7)
    assert all(r["id"] % 7 != r["qid"] % 7 for r in knn.nearest(named(q), named(v), 3).collect())
    whole = sorted(map(str, knn.nearest(q, v, 3).collect()))
    monkeypatch.setattr(knn, "BLOCK", 2)
    monkeypatch.setattr(knn, "ROWS", 3)
    monkeypatch.setattr(knn, "SLICE", 3)
    assert sorted(map(str, knn.nearest(q, v, 3).collect())) == whole
