"""Retrieval quality: recall, precision, reciprocal rank, and rates over a judged set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import index_tokens
from loreforge.session import table

RUN, PART = 12, 4  # words in a row that tell a passage, and runs of which half do

def recall_at(returned: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; 1 where nothing is relevant."""
    hit = F.size(F.array_intersect(F.slice(returned, 1, k), relevant))
    return F.when(F.size(relevant) == 0, 1.0).otherwise(hit / F.size(relevant))


def precision_at(returned: Column, relevant: Column, k: int) -> Column:
    """Share of relevant ids among the first k that were returned; 0 for an empty answer."""
    top = F.slice(returned, 1, k)
    return F.when(F.size(top) == 0, 0.0).otherwise(F.size(F.filter(top, lambda x: F.array_contains(relevant, x))) / F.size(top))


def reciprocal_rank(returned: Column, relevant: Column) -> Column:
    """1 / position of the first relevant id, 0 without one."""
    places = F.transform(returned, lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def _run_from(n: int):
    return lambda i: F.xxhash64(F.slice("h", i, n))


def _runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n, run)``: hashes of the distinct runs of 4 and of 12 index words of each text."""
    hashed = df.filter(F.col(key).isNotNull()).select(key, F.transform(index_tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("h"))
    out = None
    for n in (PART, RUN):
        runs = F.transform(F.sequence(F.lit(1), F.size("h") - n + 1), _run_from(n))
        part = hashed.filter(F.size("h") >= n).select(key, F.lit(n).alias("n"), F.explode(F.array_distinct(runs)).alias("run"))
        out = part if out is None else out.unionByName(part)
    return out


def holding(docs: DataFrame, passages: DataFrame, share: float = 0.5) -> DataFrame:
    """``(query_id, id)``: which of ``docs(id, text)`` hold the passages of ``passages(query_id, passage)``.

    A document holds a passage with 12 of its words in a row, or with ``share`` of its distinct
    runs of four words. The passages' runs are a table whose size decides how they are joined.
    """
    wanted = table(_runs(passages, "query_id", "passage"), "runs")
    sizes = wanted.filter(F.col("n") == PART).groupBy("query_id").agg(F.count("*").alias("total"))
    found = _runs(docs, "id", "text").join(wanted, ["n", "run"]).groupBy("query_id", "id").agg(F.count_if(F.col("n") == PART).alias("parts"), F.max("n").alias("most"))
    return found.join(sizes, "query_id", "left").filter((F.col("most") == RUN) | (F.col("parts") >= share * F.col("total") - 1e-9)).select("query_id", "id")


def judge(answers: DataFrame, judgements: DataFrame) -> DataFrame:
    """``(query_id, returned, relevant)``: ``answers(query_id, rank, id)`` beside ``judgements(query_id, relevant array)``; every judged query has a row."""
    got = answers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_r")).select("query_id", F.col("_r.id").alias("returned"))
    empty = F.array().cast("array<long>")
    return judgements.select("query_id", "relevant").join(got, "query_id", "left").select("query_id", F.coalesce("returned", empty).alias("returned"), F.coalesce("relevant", empty).alias("relevant"))


def scores(judged: DataFrame, *keep: str) -> DataFrame:
    r, g = F.col("returned"), F.col("relevant")
    return judged.select(
        "query_id", "returned", "relevant", *keep,
        recall_at(r, g, 1).alias("recall_1"), recall_at(r, g, 3).alias("recall_3"), recall_at(r, g, 5).alias("recall_5"),
        precision_at(r, g, 1).alias("precision_1"), reciprocal_rank(r, g).alias("rr"),
    )


def evaluate(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of ``by``) of means over the queries with relevant ids, and the share of the others that got no answer (1 if there are none).

    With a column ``thin`` (every answer of the query has too little evidence) such an answer
    counts as none where nothing is relevant: it was given with a warning.
    """
    silent = F.size("returned") == 0
    if "thin" in judged.columns:
        silent = silent | (F.coalesce("thin", F.lit(False)) & (F.size("relevant") == 0))
    s = scores(judged.withColumn("_none", F.when(silent, 1.0).otherwise(0.0)), "_none", *by).withColumn("pos", F.size("relevant") > 0)
    of = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("pos"), c)), F.lit(0.0)), 9)
    return s.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        of(F.col("recall_1")).alias("recall_1"), of(F.col("recall_3")).alias("recall_3"), of(F.col("recall_5")).alias("recall_5"),
        of(F.col("precision_1")).alias("precision_1"), of(F.col("rr")).alias("mrr"), of(F.col("_none")).alias("zero_result_rate"),
        F.round(F.coalesce(F.avg(F.when(~F.col("pos"), F.col("_none"))), F.lit(1.0)), 9).alias("true_negative_rate"),
    )


def failures(judged: DataFrame, k: int = 5) -> DataFrame:
    """Queries that miss a relevant id in the first k, and negatives that were answered."""
    s = judged.withColumn("recall", recall_at(F.col("returned"), F.col("relevant"), k))
    negative = F.size("relevant") == 0
    return s.filter((~negative & (F.col("recall") < 1)) | (negative & (F.size("returned") > 0))).select("query_id", "recall", negative.alias("negative"))


def sweep(answers: DataFrame, judgements: DataFrame, thresholds: list[float], score: str = "score") -> DataFrame:
    """``evaluate`` for every threshold on the answers' score: one list per query, cut at each threshold, in one aggregation."""
    listed = answers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col(score).alias("s")))).alias("_r"))
    rows = judgements.select("query_id", "relevant").join(listed, "query_id", "left")
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    none = F.array().cast("array<long>")
    kept = F.transform(F.filter("_r", lambda x: x["s"] >= F.col("threshold")), lambda x: x["id"])
    return evaluate(rows.select("query_id", "threshold", F.coalesce(kept, none).alias("returned"), F.coalesce("relevant", none).alias("relevant")), ("threshold",))


def report(metrics: DataFrame) -> DataFrame:
    """One line of text per metric row: percentages with one decimal, mean reciprocal rank with three."""
    return metrics.select(
        F.format_string(
            "recall@5 %.1f%%  precision@1 %.1f%%  MRR %.3f  empty %.1f%%  true negatives %.1f%%",
            F.col("recall_5") * 100, F.col("precision_1") * 100, F.col("mrr"), F.col("zero_result_rate") * 100, F.col("true_negative_rate") * 100,
        ).alias("report")
    )
