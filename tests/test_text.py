import pytest
from pyspark.sql import functions as F

from loreforge.functions import text as tx
from loreforge.operators.chunking import chunk, split_passages
from loreforge.tables import tag_array


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("how can I", ["can", "how"]), ("", []), (None, []), ("wp", ["wp"]), ("The cache of the Cache_2", ["cache", "cache_2"]), ("zamówień kosztach", ["zamówień", "kosztach"])],
)
def test_query_terms(spark, text, want):
    got = one(spark, tx.query_terms(F.col("t")), t=text)
    assert sorted(got) == sorted(want) if text == "how can I" else got == want


def test_terms_are_capped(spark):
    assert len(one(spark, tx.query_terms(F.col("t")), t=" ".join(f"word{i}" for i in range(60)))) == 24


@pytest.mark.parametrize("term, want", [("zamówień", "zamów"), ("kosztach", "koszt"), ("eval", "eval"), ("backfill", "backf")])
def test_stem(spark, term, want):
    assert one(spark, tx.stem(F.col("t")), t=term) == want


def test_index_tokens_fold_accents_and_split_underscores(spark):
    assert one(spark, tx.index_tokens(F.col("t")), t="Zamówień node_module łódź") == ["zamowien", "node", "module", "łodz"]


@pytest.mark.parametrize("path, want", [("/code/myapp-session-payments", "myapp"), ("/code/my-app", "my-app"), ("/code/x-hotfix-1/", "x")])
def test_project_name(spark, path, want):
    assert one(spark, tx.project_name(F.col("p")), p=path) == want


def test_clip_and_first_line(spark):
    assert one(spark, tx.clip(F.col("t"), 20), t="some words, and then more words") == "some words, and …"
    assert one(spark, tx.clip(F.col("t"), 20), t="short") == "short"
    assert one(spark, tx.first_line(F.col("t")), t="\n  \n head \nbody") == "head"
    assert one(spark, tx.first_line(F.col("t")), t="x" * 200) == "x" * 110 + "…"


def test_tags_in_every_spelling(spark):
    for text in ('["Git", " git ", "", "SQL"]', "sql, GIT,,git ", '["git","sql"'):
        assert one(spark, tag_array(F.col("t")), t=text) == ["git", "sql"]
    assert one(spark, tag_array(F.col("t")), t=None) == []
    assert one(spark, tag_array(F.col("t")), t="[]") == []


def test_classify(spark):
    c = tx.category(F.col("k"), F.col("n"), F.lit(""), F.col("b"), F.lit(False))
    assert one(spark, c, k="feedback", n="", b="") == "workflow"
    assert one(spark, c, k="project", n="Invoice rounding", b="slow deploy") == "financial"
    assert one(spark, c, k="project", n="odd", b="nothing here") == "business"
    assert one(spark, tx.severity(F.col("n"), F.col("b")), n="x", b="Never do this") == "critical"
    assert one(spark, tx.import_tags(F.col("n"), F.lit("note"), F.lit("App")), n="a long-Name_of it") == ["imported-md", "note", "app", "long", "name"]


def test_passages():
    assert split_passages(None) == [] and split_passages("  ") == [] and split_passages("short") == ["short"]
    doc = "\n\n".join(f"{h}\n" + "A sentence that goes on for a while. " * 18 for h in ("PROBLEM", "CAUSE", "FIX"))
    assert [p.split("\n")[0] for p in split_passages(doc)] == ["PROBLEM", "CAUSE", "FIX"]
    assert all(len(p) <= 1000 for p in split_passages("One sentence of a wall. " * 300))
    assert [len(p) for p in split_passages("x" * 2500)] == [1000, 1000, 500]
    assert split_passages("head\n\n" + "y" * 990 + "\n\n" + "z" * 300) == ["head\n" + "y" * 990, "z" * 300]


def test_chunk_ids_are_stable(spark):
    df = spark.createDataFrame([(3, "x" * 2500), (4, None), (5, " a ")], "id long, content string")
    rows = {(r["lesson_id"], r["ord"], len(r["text"])) for r in chunk(df).collect()}
    assert rows == {(3, 0, 1000), (3, 1, 1000), (3, 2, 500), (5, 0, 1)}
    assert chunk(df).select("id").distinct().count() == 4
