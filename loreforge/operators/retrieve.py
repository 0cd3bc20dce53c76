"""Retrievers over batches of queries, rank fusion, boosts and evidence."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.text import covered, coverage_floor, strict_terms
from loreforge.operators.index import Index, bm25, build, phrases, plan_queries
from loreforge.session import table
from loreforge.tables import tag_array

FIELDS = ["content", "category", "tags", "source", "project"]
RRF_K = 60
# Weights of the retrievers, in the order in which they are added up.
WEIGHTS = {"all": 3.0, "any": 1.5, "prefix": 0.6, "chunk_all": 3.0, "chunk_any": 1.2, "vector": 1.5}
GLOBAL_BOOST, TOOL_COVERAGE, HOOK_COVERAGE = 1.05, 0.6, 0.4


class Store:
    """Current lessons and their passages, with an index of each that is built and stored when first needed.

    ``lessons(id, content, ...)`` one row per id; ``passages(id, lesson_id, text)``, of which
    those without a lesson are left out. ``keep(name, make)`` says where index tables are
    stored: with ``session.kept_table`` they outlive the query and serve all later ones on the
    same version of the data. Indexes opened from a folder can be handed over as they are.
    """

    def __init__(self, lessons: DataFrame, passages: DataFrame, keep=None, lesson_index: Index | None = None, passage_index: Index | None = None):
        self.lessons = lessons
        self.passages = passages.join(lessons.select(F.col("id").alias("lesson_id")), "lesson_id", "left_semi")
        self.keep, self._lesson_index, self._passage_index = keep, lesson_index, passage_index

    def _stored(self, index: Index, grain: str) -> Index:
        return index.stored(self.keep and (lambda name, make: self.keep(f"{grain}-{name}", make)))

    @cached_property
    def lesson_index(self) -> Index:
        return self._lesson_index or self._stored(build(self.lessons, FIELDS), "lessons")

    @cached_property
    def passage_index(self) -> Index:
        return self._passage_index or self._stored(build(self.passages, ["text"]), "passages")


def depth(limit: int = 10) -> int:
    return min(100, (limit or 10) * 5)


def project_filter(project: Column) -> Column:
    """Whether a lesson belongs to a project: by its own, a tag, or because it is global."""
    return (F.col("project") == project) | F.array_contains(tag_array(F.col("tags")), project) | (F.coalesce("scope", F.lit("project")) == "global")


def _ranked(df: DataFrame, name: str, k: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col(score), F.col("id"))
    top = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumn("retriever", F.lit(name))


def _allowed(store: Store, plan: DataFrame) -> DataFrame | None:
    """``(query_id, id)`` that the category and project filters of the queries let through; None without filters."""
    named = [c for c in ("want_category", "want_project") if c in plan.columns]
    if not named:
        return None
    cond = F.lit(True)
    if "want_category" in named:
        cond = cond & (F.col("want_category").isNull() | (F.col("category") == F.col("want_category")))
    if "want_project" in named:
        cond = cond & (F.col("want_project").isNull() | project_filter(F.col("want_project")))
    return cond


def _filtered(hits: DataFrame, store: Store, plan: DataFrame, key: str = "id") -> DataFrame:
    cond = _allowed(store, plan)
    if cond is None:
        return hits
    wants = plan.select("query_id", *[c for c in ("want_category", "want_project") if c in plan.columns])
    facts = store.lessons.select(F.col("id").alias(key), "category", "project", "tags", "scope")
    return hits.join(wants, "query_id").join(facts, key).filter(cond).select(*hits.columns)


def _heads(hits: DataFrame, sizes: DataFrame, k: int, name: str) -> DataFrame:
    """The k best hits that hold every term of their query and the k best of the others, with ``every``; written, as several lists read it."""
    every = F.col("has_all") & (F.col("n_matched") == F.col("n_terms"))
    rows = hits.join(sizes, "query_id").withColumn("every", every).drop("has_all", "n_terms")
    w = Window.partitionBy("query_id", "every").orderBy("score", "id")
    return table(rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n"), name)


def _sizes(plan: DataFrame) -> DataFrame:
    return plan.select("query_id", F.size("terms").alias("n_terms"), "has_all")


def lexical(store: Store, plan: DataFrame, k: int) -> dict[str, DataFrame]:
    """The three lesson retrievers: every term, any term, any stem. Filters apply before the cut."""
    hits = _heads(_filtered(bm25(store.lesson_index, phrases(plan, "terms")), store, plan), _sizes(plan), k, "lexical")
    stemmed = _filtered(bm25(store.lesson_index, phrases(plan.filter("has_prefix"), "stems"), prefix=True), store, plan)
    return {"all": _ranked(hits.filter("every"), "all", k), "any": _ranked(hits, "any", k), "prefix": _ranked(stemmed, "prefix", k)}


def by_passage(store: Store, plan: DataFrame, k: int) -> dict[str, DataFrame]:
    """Passage retrievers: the best passages, then the best of each lesson, ranked among lessons."""
    owner = store.passages.select("id", "lesson_id")
    hits = _filtered(bm25(store.passage_index, phrases(plan, "terms")).join(owner, "id"), store, plan, "lesson_id")
    hits = _heads(hits, _sizes(plan), k * 3, "passages")

    def lessons_of(rows: DataFrame, name: str) -> DataFrame:
        top = _ranked(rows, name, k * 3).drop("rank")
        first = Window.partitionBy("query_id", "lesson_id").orderBy("score", "id")
        best = top.withColumn("f", F.row_number().over(first)).filter("f = 1").withColumnRenamed("id", "chunk_id")
        return _ranked(best.withColumnRenamed("lesson_id", "id").drop("f"), name, k)

    return {"chunk_all": lessons_of(hits.filter("every"), "chunk_all"), "chunk_any": lessons_of(hits, "chunk_any")}


def by_vector(store: Store, plan: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """``near(query_id, chunk_id, similarity)`` (already above the floor) to ranked lessons; filters apply after the k nearest."""
    hits = near.join(store.passages.select(F.col("id").alias("chunk_id"), "lesson_id"), "chunk_id")
    hits = _filtered(hits, store, plan, "lesson_id")
    first = Window.partitionBy("query_id", "lesson_id").orderBy(F.desc("similarity"), "chunk_id")
    best = hits.withColumn("f", F.row_number().over(first)).filter("f = 1").withColumn("score", -F.col("similarity"))
    return _ranked(best.select("query_id", F.col("lesson_id").alias("id"), "chunk_id", "score"), "vector", k)


def rrf(lists: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ``(query_id, id, rank[, chunk_id])`` lists.

    Ranks are pivoted and added in the order of ``weights``, so equal scores tie exactly.
    A repeated id in a list counts once, at its best rank. ``(query_id, id, score, retrievers, chunk_id)``.
    """
    names = [n for n in weights if n in lists]
    rows = None
    for n in names:
        df = lists[n]
        chunk = F.col("chunk_id") if "chunk_id" in df.columns else F.lit(None).cast("long")
        part = df.select("query_id", "id", "rank", F.lit(n).alias("r"), chunk.cast("long").alias("chunk_id"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.min(F.when(F.col("r") == n, F.col("rank"))).alias(f"_{n}") for n in names]
    chunks = [F.min_by(F.when(F.col("r") == n, F.col("chunk_id")), F.when(F.col("r") == n, F.col("rank"))).alias(f"_c_{n}") for n in names]
    wide = rows.groupBy("query_id", "id").agg(*ranks, *chunks)
    score = F.lit(0.0)
    for n in names:
        score = score + F.coalesce(F.lit(weights[n]) / (k + F.col(f"_{n}")), F.lit(0.0))
    who = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names]))
    return wide.select("query_id", "id", score.alias("score"), who.alias("retrievers"), F.coalesce(*[F.col(f"_c_{n}") for n in names]).alias("chunk_id"))


def severity_boosts(lessons: DataFrame) -> DataFrame:
    """``(severity, boost)``: critical and important lessons weigh more the rarer they are; no rows for an empty store."""
    counts = lessons.groupBy("severity").agg(F.count("*").alias("n"))
    total = lessons.agg(F.count("*").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).filter(F.col("severity").isin("critical", "important")).select("severity", (1 + 0.3 * (1 - share)).alias("boost"))


def recurrence_boost(n: Column) -> Column:
    return F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.3), 1 + 0.1 * (n - 1)))


def recall(store: Store, queries: DataFrame, chain: DataFrame, limit: int = 10, near: DataFrame | None = None) -> DataFrame:
    """The whole ranking for every query at once.

    ``queries(query_id, query[, want_category, want_project])``, ``chain(id, recurrence)`` from
    ``recurrence``; ``near`` adds the vector retriever. One row per answer: rank, score,
    matched_by, best passage, coverage (null where the vector retriever carried it), floor, thin.
    """
    plan = plan_queries(queries)
    k = depth(limit)
    lists = lexical(store, plan, k) | by_passage(store, plan, k)
    if near is not None:
        lists["vector"] = by_vector(store, plan, near, k)
    fused = rrf(lists)
    facts = store.lessons.select("id", "content", "severity", "scope")
    boosts = severity_boosts(store.lessons)
    hits = fused.join(facts, "id").join(F.broadcast(boosts), "severity", "left").join(chain, "id", "left")  # at most two boosts
    score = F.col("score") * F.coalesce("boost", F.lit(1.0))
    score = score * F.when(F.coalesce("scope", F.lit("project")) == "global", GLOBAL_BOOST).otherwise(1.0)
    score = score * recurrence_boost(F.coalesce("recurrence", F.lit(1)))
    hits = hits.withColumn("score", F.round(score, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("retrievers")), "id")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    top = top.join(plan.select("query_id", "stems"), "query_id")
    carried = F.array_contains("retrievers", "vector")
    top = top.withColumn("coverage", F.when(~carried, covered(F.col("stems"), F.col("content"))))
    top = top.withColumn("coverage_floor", coverage_floor(F.size("stems"), TOOL_COVERAGE))
    return top.select(
        "query_id", "rank", "id", "score", F.array_join("retrievers", ",").alias("matched_by"), "chunk_id", "coverage", "coverage_floor",
        (F.col("coverage") < F.col("coverage_floor")).alias("thin"),
    )


def browse(lessons: DataFrame, limit: int = 10) -> DataFrame:
    """The answer to an empty query: the newest lessons."""
    return lessons.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


# --- the prompt's own ranking: additive boosts and an enforced floor of evidence ---

HOOK_DEPTH, HOOK_HEAD, HOOK_SHOWN, PREFIX_PENALTY = 60, 8, 3, 2.0
RENDERED = 3_000
HOOK_WEIGHTS = {"lexical": 1.5, "vector": 2.0}


def prompt_scores(store: Store, prompts: DataFrame, chain: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score, covered, floor)`` for ``prompts(query_id, query, project)`` with two terms or more.

    Lessons found only by stems carry a penalty; ``shown(query_id, id)`` are left out; lessons
    under the floor of evidence are dropped.
    """
    plan = prompts.withColumn("terms", strict_terms(F.col("query"))).filter(F.size("terms") >= 2)
    plan = plan.withColumn("stems", F.transform("terms", lambda t: F.when(F.length(t) >= 6, F.substring(t, 1, 5)).otherwise(t)))
    exact = _ranked(bm25(store.lesson_index, phrases(plan, "terms")), "lexical", HOOK_DEPTH)
    stemmed = plan.filter(F.exists(F.zip_with("terms", "stems", lambda a, b: a != b), lambda x: x))
    extra = _ranked(bm25(store.lesson_index, phrases(stemmed, "stems"), prefix=True), "lexical", HOOK_DEPTH)
    extra = extra.join(exact.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.col("score") + PREFIX_PENALTY)
    hits = exact.unionByName(extra).select("query_id", "id", "score")
    if shown is not None:
        hits = hits.join(shown.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    facts = store.lessons.select("id", "content", "severity", F.col("project").alias("of_project"), F.coalesce("scope", F.lit("project")).alias("scope"))
    hits = hits.join(facts, "id").join(plan.select("query_id", "project", "stems"), "query_id").join(chain, "id", "left")
    hits = hits.withColumn("covered", covered(F.col("stems"), F.col("content"))).withColumn("floor", coverage_floor(F.size("stems"), HOOK_COVERAGE))
    again = F.greatest(F.lit(0.0), (F.coalesce("recurrence", F.lit(1)) - 1) * 0.6)
    score = (
        F.col("score")
        - F.when(F.col("of_project") == F.col("project"), 2.0).otherwise(0.0)
        - F.when(F.col("scope") == "global", 1.0).otherwise(0.0)
        - F.when(F.col("severity") == "critical", 1.5).when(F.col("severity").isin("important", "high"), 0.75).otherwise(0.0)
        - F.least(F.lit(1.8), again)
    )
    return hits.filter(F.col("covered") >= F.col("floor")).select("query_id", "id", F.round(score, 9).alias("score"), "covered", "floor")


def prompt_recall(store: Store, prompts: DataFrame, chain: DataFrame, shown: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """The three lessons to show for each prompt, with the best passage of each by BM25.

    ``near(query_id, id, similarity)`` are the nearest passage's lessons; they need no evidence.
    """
    scored = prompt_scores(store, prompts, chain, shown)
    lists = {"lexical": _ranked(scored, "lexical", HOOK_HEAD)}
    if near is not None:
        if shown is not None:
            near = near.join(shown.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
        lists["vector"] = _ranked(near.withColumn("score", -F.col("similarity")), "vector", HOOK_HEAD)
    fused = rrf(lists, HOOK_WEIGHTS).join(scored.select("query_id", "id", F.col("score").alias("lexical")), ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("lexical", F.lit(0.0)), "id")
    top = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HOOK_SHOWN).select("query_id", "rank", "id", F.round("score", 9).alias("score"))
    plan = prompts.withColumn("terms", strict_terms(F.col("query")))
    best = bm25(store.passage_index, phrases(plan, "terms")).join(store.passages.select("id", "lesson_id"), "id")
    best = best.groupBy("query_id", F.col("lesson_id").alias("lid")).agg(F.min_by("id", F.struct("score", "id")).alias("chunk_id")).withColumnRenamed("lid", "id")
    return top.join(best, ["query_id", "id"], "left")


def rendered(top: DataFrame, store: Store, cap: int = 1_200) -> DataFrame:
    """What is shown of each answer: a long lesson's best passage, else its first ``cap`` characters."""
    texts = store.passages.select(F.col("id").alias("chunk_id"), F.col("text").alias("passage"))
    rows = top.join(store.lessons.select("id", "content"), "id").join(texts, "chunk_id", "left")
    shown = F.when((F.length("content") > cap) & F.col("passage").isNotNull(), F.col("passage")).otherwise(F.substring("content", 1, cap))
    return rows.withColumn("shown", shown).drop("content", "passage")


def prompt_text(shown: DataFrame, most: int = RENDERED) -> DataFrame:
    """``(query_id, text)``: what is shown of ``rendered`` answers, by rank under a heading each, ``most`` characters in all."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("### #"), F.col("id").cast("string"), F.lit("\n"), F.coalesce("shown", F.lit(""))).alias("t"))))
    return shown.groupBy("query_id").agg(parts.alias("p")).select("query_id", F.substring(F.array_join("p.t", "\n\n"), 1, most).alias("text"))


def fail_open(make, empty: DataFrame) -> DataFrame:
    """What ``make()`` gives, written out; the ``empty`` frame where anything fails, as an answer to a prompt may be missing but must not be in the way."""
    try:
        return table(make(), "answer")
    except Exception:  # noqa: BLE001 - whatever it is, the prompt goes on
        return empty
