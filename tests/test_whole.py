"""The store as a whole, durable indexes, and what the session keeps."""

import pytest
from pyspark.sql import functions as F

from loreforge import session
from loreforge.operators import embed, index, knowledge, metrics, retrieve, store

LESSON = "id long, category string, tags string, content string, source string, project string, severity string, created_at timestamp, updated_at timestamp, shown_count long, last_shown_at timestamp, scope string, repeats long"
NEW = "category string, tags array<string>, content string, source string, project string, severity string, scope string, repeats long"


@pytest.fixture
def known(spark):
    rows = [(5, "bug-fix", '["git"]', "the cache was stale", None, "app", "tip", None, None, 0, None, "project", None), (9, "design", None, "buttons are round", None, None, None, None, None, 0, None, "global", None)]
    les = spark.createDataFrame(rows, LESSON)
    pas = spark.createDataFrame([(50, 5, 0, "the cache was stale"), (90, 9, 0, "buttons are round"), (77, 70, 0, "of nobody")], "id long, lesson_id long, ord int, text string")
    vec = spark.createDataFrame([(50, [1.0, 0.0], "m"), (90, [0.0, 1.0], "m"), (8, [1.0, 1.0], "m")], "id long, v array<float>, model string")
    arch = les.limit(0).withColumn("archived_at", F.current_timestamp()).withColumn("reason", F.lit("x"))
    return knowledge.Knowledge(les, arch, pas, vec, index.build(les, retrieve.FIELDS).stored(), index.build(pas, ["text"]).stored())


def words(ix):
    return {(r["term"], r["id"], r["tf"], r["dl"]) for r in ix.postings.collect()}


def test_learned_lessons_are_found(spark, known):
    long = "\n\n".join("A paragraph about zebras number %d, long enough to count. " % k * 6 for k in range(6))
    new = spark.createDataFrame([("design", ["ui"], "zebra stripes", None, "app", "info", None, None), ("design", None, long, None, "app", None, "global", 5)], NEW)
    k = known.learn(new)
    added = {r["content"]: r for r in k.lessons.filter("id > 9").collect()}
    assert {r["id"] for r in added.values()} == {10, 11} and added[long]["severity"] == "info" and added["zebra stripes"]["scope"] == "project"
    assert k.passages.filter(F.col("lesson_id") == added[long]["id"]).count() > 1 and k.passages.filter("lesson_id in (5, 9, 70)").count() == 3
    plan = spark.createDataFrame([(1, ["zebra"])], "query_id long, terms array<string>")
    assert [r["id"] for r in index.bm25(k.lesson_index, index.phrases(plan, "terms")).collect()] == [added["zebra stripes"]["id"]]
    assert words(k.lesson_index) == words(index.build(k.lessons, retrieve.FIELDS)) and words(k.passage_index) == words(index.build(k.passages, ["text"]))
    assert known.learn(new.limit(0)).lessons.count() == 2


def test_forget_and_restore_follow_all_tables(spark, known):
    ids = spark.createDataFrame([(5,)], "id long")
    assert known.forget(ids) is known and known.restore(ids) is known
    k = known.forget(ids, "old", confirm=True)
    assert [r["id"] for r in k.lessons.collect()] == [9] and [r["id"] for r in k.archive.collect()] == [5]
    assert {r["id"] for r in k.passages.collect()} == {90, 77} and {r["id"] for r in k.vectors.collect()} == {90, 8}
    assert words(k.lesson_index) == words(index.build(k.lessons, retrieve.FIELDS)) and words(k.passage_index) == words(index.build(k.passages, ["text"]))
    back = k.restore(ids, confirm=True)
    assert {r["id"] for r in back.lessons.collect()} == {5, 9} and back.archive.count() == 0
    assert {r["lesson_id"] for r in back.passages.collect()} == {5, 9, 70} and words(back.lesson_index) == words(known.lesson_index)
    counts = {r["place"]: r["n"] for r in back.counts().collect()}
    assert counts["pending passages"] == 2 and counts["stranded passages"] == 1 and counts["stranded vectors"] == 1


def test_reindex_and_vectors(spark, known):
    assert {r["id"] for r in known.without_vectors(spark.createDataFrame([(5,), (None,)], "lesson_id long")).vectors.collect()} == {90, 8}
    assert known.without_vectors().vectors.count() == 0
    k, report = known.reindex(embed.hashing_embedder(2), 2, "m")
    assert tuple(report.first()) == (2, 0, 0) and k.passages.count() == 2  # passages have new ids, so both were pending
    again, report = k.reindex(embed.hashing_embedder(2), 2, "m")
    assert tuple(report.first()) == (0, 0, 0) and again.vectors.count() == 2
    assert tuple(k.reindex(embed.hashing_embedder(2), 2, "other")[1].first()) == (2, 0, 0)
    assert tuple(k.reindex(embed.hashing_embedder(2), 2, "m", force=True)[1].first()) == (2, 0, 0)

    def broken(texts):
        raise OSError

    assert tuple(k.reindex(broken, 2, "other")[1].first()) == (0, 2, 2)


def test_dense_numbers(spark):
    new = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = {r["v"]: r["id"] for r in store.numbered(new, spark.createDataFrame([(41,), (None,)], "id long"), [F.col("v")]).collect()}
    assert got == {v: 42 + v for v in range(1000)}
    assert store.numbered(new.limit(0), new.select(F.col("v").alias("id")), [F.col("v")]).count() == 0


def test_patterns_and_contexts(spark, known):
    none = spark.createDataFrame([], knowledge.PATTERN)
    new = spark.createDataFrame([("b", "t", "x", None, ["app"]), ("a", "t", None, None, None)], "name string, pattern_type string, description string, example string, projects array<string>")
    pats = knowledge.store_patterns(knowledge.store_patterns(none, new), new)
    assert sorted((r["id"], r["name"]) for r in pats.collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    projects = spark.createDataFrame([("app", "live", None), (None, "x", "y")], "name string, status string, description string")
    asked = spark.createDataFrame([("app",), ("nowhere",), (None,), ("app",)], "project string")
    got = sorted((r["kind"], r["key"], r["text"]) for r in knowledge.project_context(known.lessons, projects, pats, asked).collect())
    assert got == [("lesson", "5", "the cache was stale"), ("pattern", "b", "x"), ("pattern", "b", "x"), ("project", "app", "live")]
    text = [r["markdown"] for r in store.export_markdown(known.lessons, pats).orderBy("section", F.col("id").asc_nulls_first()).collect()]
    assert text[0] == "## bug-fix (1)" and "Tags: git" in text[1] and text[4] == "## ~patterns (4)" and len(text) == 9


def test_projects_of_folders(spark):
    folders = spark.createDataFrame([("-home-me-web-shop",), ("-home-me-my-app",), ("-home-shop-x",), ("-",), ("",), ("shop",), (None,)], "folder string")
    names = spark.createDataFrame([("shop",), ("web_shop",), ("my_app",), ("app",), (None,)], "name string")
    got = {r["folder"]: r["project"] for r in knowledge.derive_project(folders, names).collect()}
    assert got == {"-home-me-web-shop": "web_shop", "-home-me-my-app": "my_app", "-home-shop-x": "x", "-": "unknown", "": "unknown", "shop": "shop", None: "unknown"}


def test_an_index_outlives_its_session(spark, known, tmp_path):
    known.lesson_index.write(str(tmp_path / "ix"))
    back = index.opened(spark, str(tmp_path / "ix"))
    assert words(back) == words(known.lesson_index) and back.stats.first()["n_docs"] == 2
    plan = spark.createDataFrame([(1, ["cache_was", "round"])], "query_id long, terms array<string>")
    assert {r["id"] for r in index.bm25(back, index.phrases(plan, "terms")).collect()} == {5, 9}
    big = [(k, f"w{j}") for k in range(3) for j in range(4)]
    queries = spark.createDataFrame([(k, [w]) for k, w in big] + [(9, ["cache", "stale"])], "query_id long, terms array<string>")
    one = sorted(map(str, index.bm25(back, index.phrases(queries, "terms")).collect()))
    sent, index.SENT = index.SENT, 0
    try:
        assert sorted(map(str, index.bm25(back, index.phrases(queries, "terms")).collect())) == one and one
    finally:
        index.SENT = sent


def test_tables_are_kept_by_version(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    f = tmp_path / "x.parquet"
    f.write_bytes(b"1")
    first = session.version(spark, [str(f)])
    for _ in range(2):
        assert session.kept_table(spark, "kept", first, make).count() == 3
    f.write_bytes(b"22")
    assert session.version(spark, [str(f)]) != first and len(made) == 1


def test_no_local_scratch_on_a_cluster():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.scratch(Fake)


def test_thin_answers_count_as_none_where_nothing_is_relevant(spark):
    rows = [(1, [7], [], True), (2, [7], [], False), (3, [7], [7], True)]
    m = metrics.evaluate(spark.createDataFrame(rows, "query_id long, returned array<long>, relevant array<long>, thin boolean")).first()
    assert (m["true_negative_rate"], m["zero_result_rate"], m["recall_1"]) == (0.5, 0.0, 1.0)


def test_documents_that_hold_passages(spark):
    w = [f"w{k}" for k in range(40)]
    docs = [(1, " ".join(w)), (2, " ".join(w[5:17])), (3, " ".join(w[5:16])), (4, " x ".join(" ".join(w[k : k + 5]) for k in range(0, 40, 5))), (5, None), (6, "w1 w2 w3")]
    items = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, "w1 w2")], "query_id long, passage string")
    got = {tuple(r) for r in metrics.holding(spark.createDataFrame(docs, "id long, text string"), items).collect()}
    assert got == {(1, 1), (1, 2)}
    assert {tuple(r) for r in metrics.holding(spark.createDataFrame(docs, "id long, text string"), items, 0.4).collect()} == {(1, 1), (1, 2), (1, 4)}
