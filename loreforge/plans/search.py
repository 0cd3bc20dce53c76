"""Queries on analysis, retrieval, ranking and evaluation. The judged set is ``eval_items``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreforge.functions import text as tx
from loreforge.operators import chunking, embed, index, knn, metrics, recurrence, retrieve
from loreforge.session import kept_table, table, version
from loreforge.tables import current, one_per_key, read

LESSON = ["category", "tags", "content", "source", "project", "severity", "created_at", "updated_at", "shown_count", "last_shown_at", "scope", "repeats"]
SWEEP = [1.0, 2.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0]


def lessons(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lessons")
    return current(df, *[c for c in LESSON]).select("id", *LESSON)


def passages(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(read(spark, d, "lesson_chunks"), "id", "lesson_id", "ord", "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")


def _keeper(spark: SparkSession, d: str, *names: str):
    """``keep(name, make)`` for tables made of the files ``names``: made once for each version of them."""
    of = version(spark, [f"{d}/{n}.parquet" for n in names])
    return lambda name, make: kept_table(spark, name, of, make)


def store(spark: SparkSession, d: str) -> retrieve.Store:
    keep = _keeper(spark, d, "lessons", "lesson_chunks")
    return retrieve.Store(keep("store-lessons", lambda: lessons(spark, d)), keep("store-passages", lambda: passages(spark, d)), keep)


#: Short queries of our own beside the judged ones, which are whole sentences that few lessons hold word for word.
STATED = (
    "shared cache", "empty header", "batch retry", "proxy version", "restart requests", "wrong build", "remote scheduler", "which lines",
    "before touching", "outdated migration", "without warning", "partial index lines", "first seconds after restart", "cache_header", "wierszy",
)


def stated(spark: SparkSession, d: str) -> DataFrame:
    """The judged queries and the stated short ones (ids from -1 down)."""
    own = spark.createDataFrame([(-k, q) for k, q in enumerate(STATED, 1)], "query_id long, query string")
    return asked(spark, d).unionByName(own)


def t1_query_plan(spark: SparkSession, d: str) -> DataFrame:
    """Terms, stems and retrievers of every judged query."""
    p = index.plan_queries(asked(spark, d))
    return p.select("query_id", F.array_join("terms", " ").alias("terms"), F.array_join("stems", " ").alias("stems"), "has_all", "has_prefix")


def t5_quoted(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("query_id", tx.quoted(F.col("query")).alias("quoted"))


def t8_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages made of every lesson."""
    return chunking.chunk(lessons(spark, d))


def t9_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return lessons(spark, d).select("id", F.size(tx.paragraphs(F.col("content"))).cast("long").alias("paragraphs"), F.element_at(tx.paragraphs(F.col("content")), 1).alias("first")).filter("paragraphs > 0")


def t10_previews(spark: SparkSession, d: str) -> DataFrame:
    """First line, clipped text and one-line text of every lesson."""
    c = F.coalesce("content", F.lit(""))
    return lessons(spark, d).select("id", tx.first_line(c).alias("preview"), tx.clip(tx.collapse(c), 120).alias("clipped"))


def t13_project_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "project_index").select("name", tx.project_name(F.concat("path", F.lit("-hotfix-1"))).alias("folder"))


def t15_classify(spark: SparkSession, d: str) -> DataFrame:
    """Category, severity and tags that an import would give each document."""
    docs = read(spark, d, "documents").select("doc_id", "kind", "project", F.coalesce("text", F.lit("")).alias("body"))
    none = F.lit("")
    cat = tx.category(F.col("kind"), none, none, F.col("body"), F.lit(False))
    return docs.select("doc_id", cat.alias("category"), tx.severity(none, F.col("body")).alias("severity"), F.array_join(tx.import_tags(F.col("kind"), F.lit("note"), F.col("project")), ",").alias("tags"))


def t17_hashes(spark: SparkSession, d: str) -> DataFrame:
    return lessons(spark, d).filter(F.col("content").isNotNull()).select("id", tx.content_hash(F.col("content")).alias("hash"))


def k2_index_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many lessons hold each index word, and how often."""
    ix = store(spark, d).lesson_index
    return ix.postings.groupBy("term").agg(F.count("*").alias("lessons"), F.sum("tf").alias("occurrences"))


def k2_update(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index of the archive that was brought up to date: archived lessons out, all current ones in."""
    arch = read(spark, d, "lessons_archive").groupBy("id").agg(F.max_by(F.struct(*retrieve.FIELDS), F.struct("archived_at", "updated_at")).alias("r")).select("id", "r.*")
    old = index.build(arch, retrieve.FIELDS).stored()
    ix = index.update(old, lessons(spark, d), retrieve.FIELDS, arch)
    return ix.postings.groupBy("term").agg(F.count("*").alias("lessons"), F.sum("tf").alias("occurrences"))


def _list(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", "score")


def _lexical(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = stated(spark, d) if name == "all" else asked(spark, d)
        return _list(retrieve.lexical(store(spark, d), index.plan_queries(q), retrieve.depth())[name])

    return run


def _passage(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = stated(spark, d) if name == "chunk_all" else asked(spark, d)
        df = retrieve.by_passage(store(spark, d), index.plan_queries(q), retrieve.depth())[name]
        return df.select("query_id", "rank", "id", "chunk_id", "score")

    return run


def r8_browse(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.browse(lessons(spark, d)).select("id", "created_at")


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """How often each lesson has come back, counted once for each version of the lessons."""
    return _keeper(spark, d, "lessons")("chains", lambda: recurrence.chain_lengths(lessons(spark, d).select("id", "repeats")))


def f1_recall(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking of every judged query: five retrievers, fusion, boosts, evidence."""
    return retrieve.recall(store(spark, d), asked(spark, d), _chains(spark, d))


def f1_recall_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same with each query's category as a filter."""
    q = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query", F.col("category").alias("want_category"))
    return retrieve.recall(store(spark, d), q, _chains(spark, d)).select("query_id", "rank", "id")


def f1_recall_project(spark: SparkSession, d: str) -> DataFrame:
    """The same within one project: its own lessons, those tagged with it, and global ones."""
    q = asked(spark, d).withColumn("want_project", F.lit("northquay"))
    return retrieve.recall(store(spark, d), q, _chains(spark, d)).select("query_id", "rank", "id")


def r6_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The ranking with the vector retriever, texts embedded by the offline default."""
    st = store(spark, d)
    e = embed.hashing_embedder()
    vs = embed.embed(st.passages.select("id", "text"), e).filter("ok").select("id", "v")
    qs = embed.embed(asked(spark, d).select(F.col("query_id").alias("id"), F.col("query").alias("text")), e).filter("ok").select(F.col("id").alias("qid"), "v")
    near = knn.nearest(qs, vs, retrieve.depth() * 3, 0.5, same=False).select(F.col("qid").alias("query_id"), F.col("id").alias("chunk_id"), "similarity")
    return retrieve.recall(st, asked(spark, d), _chains(spark, d), near=table(near, "near"))


def f4_severity_boosts(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.severity_boosts(lessons(spark, d)).select("severity", F.round("boost", 9).alias("boost"))


def g5_recurrence(spark: SparkSession, d: str) -> DataFrame:
    r = recurrence.chain_lengths(lessons(spark, d).select("id", "repeats"))
    return r.withColumn("boost", F.round(retrieve.recurrence_boost(F.col("recurrence")), 6))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query", F.lit("northquay").alias("project"))


def r10_prompt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lessons with enough evidence for each prompt, with additive boosts."""
    return retrieve.prompt_scores(store(spark, d), _prompts(spark, d), _chains(spark, d))


def r10_not_shown(spark: SparkSession, d: str) -> DataFrame:
    """The same for a session that has had every lesson that was ever shown."""
    st = store(spark, d)
    had = st.lessons.filter(F.coalesce("shown_count", F.lit(0)) > 0).select("id")
    shown = _prompts(spark, d).select("query_id").crossJoin(had)  # a stated query set
    return retrieve.prompt_scores(st, _prompts(spark, d), _chains(spark, d), shown)


def r13_prompt_recall(spark: SparkSession, d: str) -> DataFrame:
    """What each prompt is shown, those shown before left out, with the text as rendered."""
    st = store(spark, d)
    top = retrieve.prompt_recall(st, _prompts(spark, d), _chains(spark, d))
    return retrieve.rendered(top, st)


def _lessons_holding(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id, relevant)``: of each judged query the lessons that hold its passage."""
    q = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "passage")
    held = metrics.holding(lessons(spark, d).select("id", F.col("content").alias("text")), q)
    held = held.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("relevant"))
    return q.select("query_id").join(held, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<long>")))


def g10_recall_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking against the lessons that hold each passage; an answer of thin hits only counts as none where nothing is relevant."""
    answers = table(f1_recall(spark, d).select("query_id", "rank", "id", "thin"), "answers")
    thin = answers.groupBy("query_id").agg(F.every("thin").alias("thin"))
    return metrics.evaluate(metrics.judge(answers, _lessons_holding(spark, d)).join(thin, "query_id", "left"))


def g11_prompt_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """What prompts are shown against the lessons that hold each passage."""
    top = retrieve.prompt_recall(store(spark, d), _prompts(spark, d), _chains(spark, d))
    return metrics.evaluate(metrics.judge(top.select("query_id", "rank", "id"), _lessons_holding(spark, d)))


def v1_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors for the stated queries, those whose id is divisible by 100."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = knn.nearest(v.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "qid"), v, 10)
    return near.select("qid", "rank", "id", F.round("similarity", 5).alias("similarity"))


def w8_suggest(spark: SparkSession, d: str) -> DataFrame:
    """For the lessons of the stated passages, those whose id is divisible by 100, the lesson most like each."""
    v = read(spark, d, "chunks_vec").filter(F.size("embedding") == 64).groupBy("chunk_id").agg(F.min("embedding").alias("v"))
    rows = passages(spark, d).withColumnRenamed("id", "chunk_id").join(v, "chunk_id").select("chunk_id", "lesson_id", "text", "v")
    rows = table(rows, "passages")
    out = recurrence.suggest(rows.filter(F.col("chunk_id") % 100 == 0), rows)
    return out.select("lesson_id", "of_lesson", F.round("similarity", 5).alias("similarity"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ten best documents of each judged query, and the documents that hold its passage, wholly or for the most part."""
    keep = _keeper(spark, d, "documents", "eval_items")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    ix = index.build(docs, ["text"]).stored(lambda name, make: keep(f"documents-{name}", make))
    plan = index.plan_queries(asked(spark, d))
    hits = retrieve._ranked(index.bm25(ix, index.phrases(plan, "terms")), "any", 10)
    passages_ = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "passage")
    held = metrics.holding(docs, passages_).groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("relevant"))
    judgements = asked(spark, d).select("query_id").join(held, "query_id", "left")
    judgements = judgements.withColumn("relevant", F.coalesce("relevant", F.array().cast("array<long>")))
    return table(hits.select("query_id", "rank", "id", "score"), "answers"), keep("judgements", lambda: judgements)


def g10_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(metrics.judge(*_judged(spark, d)))


def g12_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Metrics for eight thresholds of the score."""
    answers, judgements = _judged(spark, d)
    return metrics.sweep(answers.withColumn("score", -F.col("score")), judgements, SWEEP)


def g17_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.report(g10_evaluate(spark, d))


def g18_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failures(metrics.judge(*_judged(spark, d))).withColumn("recall", F.round("recall", 9))


QUERIES = {
    f.__name__: f
    for f in (
        t1_query_plan, t5_quoted, t8_passages, t9_paragraphs, t10_previews, t13_project_names, t15_classify, t17_hashes, k2_index_stats, k2_update,
        r8_browse, f1_recall, f1_recall_filtered, f1_recall_project, r6_hybrid, f4_severity_boosts, g5_recurrence, r10_prompt_scores, r10_not_shown, r13_prompt_recall,
        g10_recall_evaluation, g11_prompt_evaluation,
        v1_knn, w8_suggest, g10_evaluate, g12_sweep, g17_report, g18_failures,
    )
}
QUERIES |= {"r1_all": _lexical("all"), "r2_any": _lexical("any"), "r3_prefix": _lexical("prefix"), "r4_chunk_all": _passage("chunk_all"), "r5_chunk_any": _passage("chunk_any")}

# --- SQL ---------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_FOLD = f"translate(lower(coalesce({{}}, '')), '{tx.ACCENTED}', '{tx.PLAIN}')"
_TOKENS = r"list_filter(regexp_split_to_array(" + _FOLD + r", '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_STRIP = r"regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
CUR = "cur AS (SELECT * FROM lessons QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) = 1)"
PAS = """pas AS (SELECT id, arg_min(lesson_id, loaded_at) AS lesson_id, arg_min("text", loaded_at) AS "text" FROM lesson_chunks GROUP BY id),
live AS (SELECT pas.* FROM pas JOIN cur ON cur.id = pas.lesson_id)"""


def _terms(strict: bool = False, source: str = "eval_items", key: str = "item_id", column: str = "query") -> str:
    """CTEs up to ``term(query_id, i, w)``."""
    return rf"""word AS (
  SELECT query_id, min(i) AS i, w FROM (
    SELECT k AS query_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT {key} AS k, list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '') AS ws FROM {source}))
  GROUP BY query_id, w),
level AS (SELECT *, CASE WHEN length(w) >= 3 AND w NOT IN ({_STOP}) THEN 1 WHEN length(w) >= 2 THEN 2 ELSE 3 END AS lv FROM word),
best AS (SELECT query_id, min(lv) AS lv FROM level GROUP BY 1),
term AS (
  SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY i) AS i
  FROM level JOIN best USING (query_id) WHERE level.lv <= best.lv {"AND best.lv = 1" if strict else ""}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 24),
stemmed AS (SELECT query_id, i, w, CASE WHEN length(w) >= 6 THEN substr(w, 1, 5) ELSE w END AS s FROM term),
shape AS (SELECT query_id, count(*) AS n, bool_or(s <> w) AS has_prefix FROM stemmed GROUP BY 1)"""


def _bm25(name: str, grain: str, source: str, prefix: bool) -> str:
    """CTEs ``{name}_score(query_id, id, score, n)`` over occurrences ``{grain}_occ`` for ``source(query_id, phrase)``."""
    part = f"""{name}_ph AS (SELECT DISTINCT phrase, {_TOKENS.format("phrase")} AS parts FROM {source}),
{name}_pt AS (SELECT phrase, len(parts) AS m, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS j FROM {name}_ph WHERE len(parts) > 0)"""
    if prefix:
        grow = f"""{name}_w AS (
  SELECT phrase, m, part AS term, j FROM {name}_pt WHERE j < m - 1
  UNION ALL SELECT phrase, m, v.term, j FROM {name}_pt JOIN (SELECT DISTINCT term FROM {grain}_occ) v ON starts_with(v.term, part) WHERE j = m - 1)"""
    else:
        grow = f"{name}_w AS (SELECT phrase, m, part AS term, j FROM {name}_pt)"
    return f"""{part},
{grow},
{name}_at AS (SELECT phrase, m, o.id, o.pos - j AS pos FROM {name}_w w JOIN {grain}_occ o ON o.term = w.term GROUP BY ALL HAVING count(*) = m),
{name}_tf AS (SELECT phrase, id, count(*) AS tf FROM {name}_at GROUP BY 1, 2),
{name}_df AS (SELECT phrase, greatest(ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM {name}_tf, {grain}_stat GROUP BY phrase, n_docs),
{name}_score AS (
  SELECT query_id, t.id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS n
  FROM {source} s JOIN {name}_tf t USING (phrase) JOIN {name}_df USING (phrase) JOIN {grain}_len l ON l.id = t.id, {grain}_stat GROUP BY 1, 2)"""


def _occ(grain: str, table_: str, columns: list[str]) -> str:
    arms = " UNION ALL ".join(f'SELECT id, {k} AS c, {_TOKENS.format(chr(34) + c + chr(34))} AS t FROM {table_}' for k, c in enumerate(columns))
    return f"""{grain}_tok AS ({arms}),
{grain}_occ AS (SELECT id, unnest(t) AS term, c * 1048576 + generate_subscripts(t, 1) - 1 AS pos FROM {grain}_tok),
{grain}_len AS (SELECT id, sum(len(t)) AS dl FROM {grain}_tok GROUP BY id),
{grain}_stat AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM {grain}_len)"""


_L = _occ("l", "cur", retrieve.FIELDS)
_P = _occ("p", "live", ["text"])
_SRC = "exact AS (SELECT DISTINCT query_id, w AS phrase FROM term),\nstem AS (SELECT DISTINCT query_id, s AS phrase FROM stemmed JOIN shape USING (query_id) WHERE has_prefix)"
_ALLOWED = "JOIN (SELECT item_id AS query_id, category AS want FROM eval_items) want USING (query_id) JOIN (SELECT id AS {0}, category AS has FROM cur) has USING ({0})"


_TAGGED = "list_transform(CASE WHEN starts_with(trim(tags), '[') THEN from_json(trim(tags), '[\"VARCHAR\"]') ELSE string_split(tags, ',') END, lambda t: lower(trim(t)))"
_OF_PROJECT = f"project = 'northquay' OR coalesce(list_contains({_TAGGED}, 'northquay'), false) OR coalesce(scope, 'project') = 'global'"
_STATED = "asked AS (SELECT item_id, query FROM eval_items UNION ALL VALUES " + ", ".join(f"(-{k}, '{q}')" for k, q in enumerate(STATED, 1)) + ")"


def _retrievers(filtered: bool | str = False, own: bool = False) -> str:
    if filtered == "project":
        ok = lambda k: f"SELECT b.* FROM {{0}} b WHERE {k} IN (SELECT id FROM cur WHERE {_OF_PROJECT})"
    elif filtered:
        ok = lambda k: f"SELECT b.* FROM {{0}} b {_ALLOWED.format(k)} WHERE want IS NULL OR want = has"
    else:
        ok = lambda k: "SELECT * FROM {0}"
    rank = "row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank"
    passage = lambda n, cond: f"""{n}_top AS (SELECT * FROM c_hit WHERE {cond} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= 150),
{n}_one AS (SELECT query_id, lesson_id AS id, id AS chunk_id, score FROM {n}_top QUALIFY row_number() OVER (PARTITION BY query_id, lesson_id ORDER BY score, id) = 1),
{n} AS (SELECT *, {rank} FROM {n}_one QUALIFY rank <= 50)"""  # noqa: E731
    return f"""WITH {CUR}, {PAS},
{_STATED},
{_terms(source="asked" if own else "eval_items")},
{_SRC},
{_L},
{_P},
{_bm25("e", "l", "exact", False)},
{_bm25("s", "l", "stem", True)},
{_bm25("c", "p", "exact", False)},
e_ok AS ({ok("id").format("e_score")}),
s_ok AS ({ok("id").format("s_score")}),
c_own AS (SELECT c.*, lesson_id FROM c_score c JOIN live ON live.id = c.id),
c_ok AS ({ok("lesson_id").format("c_own")}),
c_hit AS (SELECT query_id, c.id, lesson_id, score, c.n, shape.n AS terms FROM c_ok c JOIN shape USING (query_id)),
q_all AS (SELECT query_id, e.id, score, {rank} FROM e_ok e JOIN shape USING (query_id) WHERE e.n = shape.n AND shape.n >= 2 QUALIFY rank <= 50),
q_any AS (SELECT query_id, id, score, {rank} FROM e_ok QUALIFY rank <= 50),
q_prefix AS (SELECT query_id, id, score, {rank} FROM s_ok QUALIFY rank <= 50),
{passage("q_chunk_all", "n = terms AND terms >= 2")},
{passage("q_chunk_any", "true")}"""


_WALK = """walk(id, node, dist, trail) AS (
  SELECT id, repeats, 1, [id] FROM cur WHERE repeats IS NOT NULL
  UNION ALL SELECT w.id, c.repeats, dist + 1, list_append(trail, c.id) FROM walk w JOIN cur c ON c.id = w.node
  WHERE c.repeats IS NOT NULL AND NOT list_contains(list_append(trail, c.id), c.repeats)),
chain AS (SELECT id, max(CASE WHEN list_contains(trail, node) THEN dist ELSE dist + 1 END)::BIGINT AS recurrence FROM walk GROUP BY id)"""


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The hashed bags of words of queries and passages, and the passages near each query.
_HASHED = rf"""said_(side, k, t) AS (SELECT 'q', item_id, query FROM eval_items UNION ALL SELECT 'p', id, "text" FROM live),
word_ AS (SELECT side, k, unnest(list_filter(regexp_split_to_array(lower(coalesce(t, '')), '{_SPACE}'), lambda w: w <> '')) AS w FROM said_),
code_ AS (SELECT DISTINCT w, list_reduce(list_transform(regexp_extract_all(w, '(?s).'), lambda c: ord(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295) % 64 AS dim FROM word_),
count_ AS (SELECT side, k, dim, count(*) AS n FROM word_ JOIN code_ USING (w) GROUP BY ALL),
float_ AS (SELECT side, k, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY side, k)))::FLOAT::DOUBLE AS x FROM count_),
unit_ AS (SELECT side, k, dim, x / sqrt(sum(x * x) OVER (PARTITION BY side, k)) AS x FROM float_),
far_ AS (SELECT q.k AS query_id, p.k AS chunk_id, round(sqrt(greatest(2 - 2 * sum(q.x * p.x), 0)), 9) AS d FROM unit_ q JOIN unit_ p ON p.dim = q.dim AND q.side = 'q' AND p.side = 'p' GROUP BY 1, 2),
near_ AS (SELECT *, round(1 - d * d / 2, 9) AS s FROM far_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) <= 150),
v_one AS (SELECT query_id, lesson_id AS id, chunk_id, s FROM near_ JOIN live ON live.id = chunk_id WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id, lesson_id ORDER BY s DESC, chunk_id) = 1),
q_vector AS (SELECT query_id, id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM v_one QUALIFY rank <= 50)"""


def _fused(filtered: bool | str = False, vector: bool = False) -> str:
    names = ["all", "any", "prefix", "chunk_all", "chunk_any", *(["vector"] if vector else [])]
    passage = ("chunk_all", "chunk_any", "vector")
    arms = " UNION ALL ".join(f"SELECT query_id, id, rank, '{n}' AS r, {'chunk_id' if n in passage else 'NULL'} AS chunk_id FROM q_{n}" for n in names)
    score = " + ".join(f"coalesce({retrieve.WEIGHTS[n]}::DOUBLE / (60 + min(rank) FILTER (r = '{n}')), 0.0::DOUBLE)" for n in names)
    who = ", ".join(f"CASE WHEN count(*) FILTER (r = '{n}') > 0 THEN '{n}' END" for n in names)
    return (
        _retrievers(filtered).replace("WITH ", "WITH RECURSIVE ", 1)
        + (f",\n{_HASHED}" if vector else "")
        + f""",
{_WALK},
list AS ({arms}),
fused AS (SELECT query_id, id, 0.0::DOUBLE + {score} AS base, list_filter([{who}], lambda x: x IS NOT NULL) AS who,
  coalesce(min(chunk_id) FILTER (r = 'chunk_all'), min(chunk_id) FILTER (r = 'chunk_any'), min(chunk_id) FILTER (r = 'vector')) AS chunk_id FROM list GROUP BY 1, 2),
boost AS (SELECT severity, 1 + 0.3 * (1 - count(*)::DOUBLE / (SELECT count(*) FROM cur)) AS boost FROM cur WHERE severity IN ('critical', 'important') GROUP BY 1),
scored AS (SELECT query_id, f.id, content, who, f.chunk_id,
  round(base * coalesce(boost, 1) * CASE WHEN coalesce(scope, 'project') = 'global' THEN 1.05 ELSE 1 END * least(1.3, 1 + 0.1 * (greatest(coalesce(recurrence, 1), 1) - 1)), 9) AS score
  FROM fused f JOIN cur ON cur.id = f.id LEFT JOIN boost USING (severity) LEFT JOIN chain ON chain.id = f.id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(who) DESC, id) AS rank FROM scored QUALIFY rank <= 10),
cov AS (SELECT query_id, id, CASE WHEN NOT bool_or(list_contains(who, 'vector')) THEN count(*) FILTER (contains(lower(content), s))::INTEGER END AS coverage FROM top JOIN stemmed USING (query_id) GROUP BY 1, 2),
floor AS (SELECT query_id, least(3, greatest(2, ceil(n * 0.6::DOUBLE)))::INTEGER AS coverage_floor FROM shape)
"""
    )


def _grams(source: str, n: int) -> str:
    """Distinct runs of ``n`` words of ``source(k, w)``, as SQL."""
    return f"SELECT DISTINCT k, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS s FROM {source} WHERE len(w) >= {n}"


_PROMPT = f"""WITH RECURSIVE {CUR}, {PAS},
{_terms(strict=True)},
two AS (SELECT query_id FROM shape WHERE n >= 2),
exact AS (SELECT DISTINCT query_id, w AS phrase FROM term JOIN two USING (query_id)),
stem AS (SELECT DISTINCT query_id, s AS phrase FROM stemmed JOIN two USING (query_id) JOIN shape USING (query_id) WHERE has_prefix),
{_L},
{_bm25("e", "l", "exact", False)},
{_bm25("s", "l", "stem", True)},
{_WALK},
e_top AS (SELECT query_id, id, score FROM e_score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= 60),
s_top AS (SELECT query_id, id, score + 2 AS score FROM s_score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= 60),
hit AS (SELECT * FROM e_top UNION ALL SELECT * FROM s_top WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM e_top)),
cov AS (SELECT query_id, h.id, count(*) FILTER (contains(lower(coalesce(content, '')), s))::INTEGER AS covered, least(3, greatest(2, ceil(count(*) * 0.4::DOUBLE)))::INTEGER AS floor
  FROM hit h JOIN cur ON cur.id = h.id JOIN stemmed USING (query_id) GROUP BY 1, 2),
hooked AS (SELECT query_id, h.id, round(score - CASE WHEN project = 'northquay' THEN 2 ELSE 0 END - CASE WHEN coalesce(scope, 'project') = 'global' THEN 1 ELSE 0 END
  - CASE WHEN severity = 'critical' THEN 1.5 WHEN severity IN ('important', 'high') THEN 0.75 ELSE 0 END - least(1.8, greatest(0, (coalesce(recurrence, 1) - 1) * 0.6)), 9) AS score, covered, floor
FROM hit h JOIN cov USING (query_id, id) JOIN cur ON cur.id = h.id LEFT JOIN chain ON chain.id = h.id WHERE covered >= floor)
"""
_SHOWN = f""",
{_P},
{_bm25("c", "p", "exact", False)},
passage AS (SELECT query_id, lesson_id AS id, arg_min(c.id, (score, c.id)) AS chunk_id FROM c_score c JOIN live ON live.id = c.id GROUP BY 1, 2),
three AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INTEGER AS rank FROM hooked QUALIFY rank <= 3),
given AS (SELECT t.query_id, t.rank, t.id, round(1.5::DOUBLE / (60 + t.rank), 9) AS score, chunk_id FROM three t LEFT JOIN passage USING (query_id, id))
"""
_HELD = rf""",
said AS (SELECT item_id AS k, {_TOKENS.format("passage")} AS w FROM eval_items),
said4 AS ({_grams("said", 4)}),
said12 AS ({_grams("said", 12)}),
text AS (SELECT id AS k, {_TOKENS.format("content")} AS w FROM cur),
text4 AS (SELECT * FROM ({_grams("text", 4)}) WHERE s IN (SELECT s FROM said4)),
text12 AS (SELECT * FROM ({_grams("text", 12)}) WHERE s IN (SELECT s FROM said12)),
size4 AS (SELECT k, count(*) AS n FROM said4 GROUP BY 1),
rel AS (
  SELECT i.k AS query_id, t.k AS id FROM said4 i JOIN text4 t USING (s) JOIN size4 ON size4.k = i.k GROUP BY i.k, t.k, n HAVING count(*) >= 0.5 * n - 1e-9
  UNION SELECT i.k, t.k FROM said12 i JOIN text12 t USING (s)),
nrel AS (SELECT e.item_id AS query_id, count(rel.id) AS nrel FROM eval_items e LEFT JOIN rel ON rel.query_id = e.item_id GROUP BY 1)
"""


def _evaluated(answers: str) -> str:
    """Metrics of ``answers(query_id, rank, id, thin)`` against ``rel``, as SQL."""
    return f""",
one AS (
  SELECT n.query_id, nrel, count(a.id) AS got, coalesce(bool_and(thin), false) AS thin,
         count(*) FILTER (rel.id IS NOT NULL AND rank <= 1) AS h1, count(*) FILTER (rel.id IS NOT NULL AND rank <= 3) AS h3, count(*) FILTER (rel.id IS NOT NULL AND rank <= 5) AS h5,
         min(rank) FILTER (rel.id IS NOT NULL) AS first
  FROM nrel n LEFT JOIN ({answers}) a ON a.query_id = n.query_id LEFT JOIN rel ON rel.query_id = a.query_id AND rel.id = a.id GROUP BY 1, 2)
SELECT count(*) AS n_queries, round(coalesce(avg(h1 / nrel) FILTER (nrel > 0), 0), 9) AS recall_1, round(coalesce(avg(h3 / nrel) FILTER (nrel > 0), 0), 9) AS recall_3,
       round(coalesce(avg(h5 / nrel) FILTER (nrel > 0), 0), 9) AS recall_5, round(coalesce(avg(h1) FILTER (nrel > 0), 0), 9)::DOUBLE AS precision_1,
       round(coalesce(avg(coalesce(1 / first, 0)) FILTER (nrel > 0), 0), 9) AS mrr, round(coalesce(avg(CASE WHEN got = 0 THEN 1 ELSE 0 END) FILTER (nrel > 0), 0), 9)::DOUBLE AS zero_result_rate,
       round(coalesce(avg(CASE WHEN got = 0 OR thin THEN 1 ELSE 0 END) FILTER (nrel = 0), 1), 9)::DOUBLE AS true_negative_rate FROM one"""


_JUDGED = f"""WITH docs AS (SELECT doc_id AS id, "text" FROM documents),
{_terms()},
exact AS (SELECT DISTINCT query_id, w AS phrase FROM term),
{_occ("l", "docs", ["text"])},
{_bm25("e", "l", "exact", False)},
ans AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM e_score QUALIFY rank <= 10),
said AS (SELECT item_id AS k, {_TOKENS.format("passage")} AS w FROM eval_items),
said4 AS ({_grams("said", 4)}),
said12 AS ({_grams("said", 12)}),
text AS (SELECT id AS k, t AS w FROM l_tok),
text4 AS (SELECT * FROM ({_grams("text", 4)}) WHERE s IN (SELECT s FROM said4)),
text12 AS (SELECT * FROM ({_grams("text", 12)}) WHERE s IN (SELECT s FROM said12)),
size4 AS (SELECT k, count(*) AS n FROM said4 GROUP BY 1),
rel AS (
  SELECT i.k AS query_id, t.k AS id FROM said4 i JOIN text4 t USING (s) JOIN size4 ON size4.k = i.k GROUP BY i.k, t.k, n HAVING count(*) >= 0.5 * n - 1e-9
  UNION SELECT i.k, t.k FROM said12 i JOIN text12 t USING (s)),
nrel AS (SELECT e.item_id AS query_id, count(rel.id) AS nrel FROM eval_items e LEFT JOIN rel ON rel.query_id = e.item_id GROUP BY 1),
cut AS (SELECT unnest([{", ".join(map(str, SWEEP))}]) AS threshold),
one AS (
  SELECT threshold, n.query_id, nrel, count(a.id) AS got,
         count(*) FILTER (rel.id IS NOT NULL AND rank <= 1) AS h1, count(*) FILTER (rel.id IS NOT NULL AND rank <= 3) AS h3, count(*) FILTER (rel.id IS NOT NULL AND rank <= 5) AS h5,
         min(rank) FILTER (rel.id IS NOT NULL) AS first
  FROM (SELECT -1e9 AS threshold UNION ALL SELECT threshold::DOUBLE FROM cut) t CROSS JOIN nrel n
  LEFT JOIN ans a ON a.query_id = n.query_id AND -a.score >= threshold LEFT JOIN rel ON rel.query_id = a.query_id AND rel.id = a.id GROUP BY 1, 2, 3),
met AS (
  SELECT threshold, count(*) AS n_queries, round(coalesce(avg(h1 / nrel) FILTER (nrel > 0), 0), 9) AS recall_1, round(coalesce(avg(h3 / nrel) FILTER (nrel > 0), 0), 9) AS recall_3,
         round(coalesce(avg(h5 / nrel) FILTER (nrel > 0), 0), 9) AS recall_5, round(coalesce(avg(CASE WHEN got > 0 THEN h1 ELSE 0 END) FILTER (nrel > 0), 0), 9) AS precision_1,
         round(coalesce(avg(coalesce(1 / first, 0)) FILTER (nrel > 0), 0), 9) AS mrr, round(coalesce(avg(CASE WHEN got = 0 THEN 1 ELSE 0 END) FILTER (nrel > 0), 0), 9) AS zero_result_rate,
         round(coalesce(avg(CASE WHEN got = 0 THEN 1 ELSE 0 END) FILTER (nrel = 0), 1), 9) AS true_negative_rate
  FROM one GROUP BY 1)
"""
def _rules(text: str, rules: tuple) -> str:
    """Rules as SQL, with word boundaries that know all letters."""
    edge = r"[^\p{L}\p{N}_]"
    bounded = lambda p: re.sub(r"\\b(?=\w)", lambda _: f"(?:^|{edge})", p).replace(r"\b", f"(?:$|{edge})")
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){bounded(p)}') THEN '{n}'" for n, p in rules) + " END"


_CLASSIFY = f"""WITH d AS (SELECT doc_id, kind, project, coalesce("text", '') AS body FROM documents),
w AS (SELECT *, list_concat(['imported-md', 'note', project], list_filter(regexp_split_to_array(coalesce(kind, ''), '[-_\\s]'), lambda t: length(t) > 2)[1:6]) AS every FROM d),
l AS (SELECT *, list_filter(list_transform(every, lambda t: lower(t)), lambda t: t IS NOT NULL AND t <> '') AS t FROM w)
SELECT doc_id, CASE WHEN kind IN ('feedback', 'user') THEN 'workflow' WHEN kind = 'reference' THEN 'tooling' ELSE coalesce({_rules("body", tx.CATEGORY_RULES)}, 'business') END AS category,
  coalesce({_rules("' ' || body", tx.SEVERITY_RULES)}, 'info') AS severity,
  array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:10], ',') AS tags FROM l"""
_PLAIN_TEXT = _STRIP.format("coalesce(content, '')")

SQL = {
    "t1_query_plan": f"""WITH {_terms()}
SELECT query_id, string_agg(w, ' ' ORDER BY i) AS terms, string_agg(s, ' ' ORDER BY i) AS stems, count(*) >= 2 AS has_all, bool_or(s <> w) AS has_prefix FROM stemmed GROUP BY 1""",
    "t5_quoted": r"""SELECT item_id AS query_id, array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(query, ''), '[^\p{L}\p{N}_]+'), lambda t: t <> ''), lambda t: '"' || t || '"'), ' ') AS quoted FROM eval_items""",
    "t9_paragraphs": rf"""WITH {CUR}, p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '\n\s*\n+'), lambda s: {_STRIP.format("s")}), lambda s: s <> '') AS p FROM cur)
SELECT id, len(p) AS paragraphs, p[1] AS "first" FROM p WHERE len(p) > 0""",
    "t13_project_names": r"""SELECT name, regexp_replace(string_split(regexp_replace(path || '-hotfix-1', '/+$', ''), '/')[-1], '-(session|hotfix|worktree)-.*$', '') AS folder FROM project_index""",
    "t17_hashes": f"WITH {CUR} SELECT id, sha256(content) AS hash FROM cur WHERE content IS NOT NULL",
    "k2_index_stats": f"WITH {CUR}, {_L} SELECT term, count(DISTINCT id) AS lessons, count(*)::BIGINT AS occurrences FROM l_occ GROUP BY 1",
    "k2_update": f"WITH {CUR}, {_L} SELECT term, count(DISTINCT id) AS lessons, count(*)::BIGINT AS occurrences FROM l_occ GROUP BY 1",
    "r8_browse": f"WITH {CUR} SELECT id, created_at FROM cur ORDER BY created_at DESC, id DESC LIMIT 10",
    "f4_severity_boosts": f"WITH {CUR} SELECT severity, round(1 + 0.3 * (1 - count(*)::DOUBLE / (SELECT count(*) FROM cur)), 9) AS boost FROM cur WHERE severity IN ('critical', 'important') GROUP BY 1",
    "g5_recurrence": f"WITH RECURSIVE {CUR}, {_WALK} SELECT id, recurrence, round(CASE WHEN recurrence <= 1 THEN 1 ELSE least(1.3, 1 + 0.1 * (recurrence - 1)) END, 6)::DOUBLE AS boost FROM chain",
    "f1_recall": _fused()
    + """SELECT query_id, rank::INTEGER AS rank, id, score, array_to_string(who, ',') AS matched_by, chunk_id, coverage, coverage_floor, coverage < coverage_floor AS thin
FROM top JOIN cov USING (query_id, id) JOIN floor USING (query_id)""",
    "r6_hybrid": _fused(vector=True)
    + """SELECT query_id, rank::INTEGER AS rank, id, score, array_to_string(who, ',') AS matched_by, chunk_id, coverage, coverage_floor, coverage < coverage_floor AS thin
FROM top JOIN cov USING (query_id, id) JOIN floor USING (query_id)""",
    "f1_recall_filtered": _fused(True) + "SELECT query_id, rank::INTEGER AS rank, id FROM top",
    "r10_prompt_scores": _PROMPT + "SELECT * FROM hooked",
    "r10_not_shown": _PROMPT + "SELECT * FROM hooked WHERE id NOT IN (SELECT id FROM cur WHERE coalesce(shown_count, 0) > 0)",
    "r13_prompt_recall": _PROMPT
    + _SHOWN
    + """SELECT g.*, CASE WHEN length(coalesce(content, '')) > 1200 AND live."text" IS NOT NULL THEN live."text" ELSE substr(content, 1, 1200) END AS shown
FROM given g JOIN cur ON cur.id = g.id LEFT JOIN live ON live.id = g.chunk_id""",
    "g11_prompt_evaluation": _PROMPT + _SHOWN + _HELD + _evaluated("SELECT query_id, rank, id, NULL::BOOLEAN AS thin FROM given"),
    "g10_recall_evaluation": _fused() + _HELD + _evaluated("SELECT query_id, rank, id, coverage < coverage_floor AS thin FROM top JOIN cov USING (query_id, id) JOIN floor USING (query_id)"),
    "f1_recall_project": _fused("project") + "SELECT query_id, rank::INTEGER AS rank, id FROM top",
    "g17_report": _JUDGED
    + """SELECT printf('recall@5 %.1f%%  precision@1 %.1f%%  MRR %.3f  empty %.1f%%  true negatives %.1f%%', recall_5 * 100, precision_1 * 100, mrr, zero_result_rate * 100, true_negative_rate * 100) AS report
FROM met WHERE threshold = -1e9""",
    "t10_previews": f"""WITH {CUR}, f AS (
  SELECT id, coalesce(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda s: {_STRIP.format("s")}), lambda s: s <> '')[1], '') AS line,
         trim(regexp_replace(coalesce(content, ''), '[\\s\\x{{a0}}]+', ' ', 'g')) AS c FROM cur),
h AS (SELECT *, substr(c, 1, 120) AS head FROM f),
k AS (SELECT *, CASE WHEN contains(head, ' ') THEN 121 - instr(reverse(head), ' ') - 1 ELSE -1 END AS space FROM h)
SELECT id, CASE WHEN length(line) > 110 THEN substr(line, 1, 110) || '…' ELSE line END AS preview,
       CASE WHEN length(c) <= 120 THEN c ELSE regexp_replace(CASE WHEN space > 72 THEN substr(head, 1, space) ELSE head END, '[ ,.;:]+$', '') || ' …' END AS clipped FROM k""",
    "t15_classify": _CLASSIFY,
    "v1_knn": """WITH v AS (SELECT vec_id AS id, (embedding::DOUBLE[])::DOUBLE[64] AS e FROM embeddings),
d AS (SELECT q.id AS qid, v.id, array_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.id <> v.id WHERE q.id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id)::INTEGER AS rank FROM d QUALIFY rank <= 10)
SELECT qid, rank, id, round(c, 5) AS similarity FROM t""",
    "w8_suggest": f"""WITH {PAS.split("," + chr(10) + "live")[0]},
v AS (SELECT chunk_id, (min(embedding)::DOUBLE[])::DOUBLE[64] AS e FROM chunks_vec WHERE len(embedding) = 64 GROUP BY 1),
p AS (SELECT pas.id, lesson_id, e FROM pas JOIN v ON v.chunk_id = pas.id WHERE length("text") >= 250 AND list_max(list_transform(e::DOUBLE[], lambda x: abs(x))) > 0),
d AS (SELECT q.id AS qid, q.lesson_id, p.lesson_id AS of_lesson, p.id, round(array_cosine_similarity(q.e, p.e), 8) AS c FROM p q JOIN p ON p.lesson_id <> q.lesson_id WHERE q.lesson_id IN (SELECT lesson_id FROM pas JOIN v ON v.chunk_id = pas.id WHERE pas.id % 100 = 0)),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) <= 12),
b AS (SELECT lesson_id, of_lesson, max(c) AS c FROM k WHERE c >= 0.68 GROUP BY 1, 2)
SELECT lesson_id, of_lesson, round(c, 5) AS similarity FROM b QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY c DESC, of_lesson) = 1""",
    "g10_evaluate": _JUDGED + "SELECT * EXCLUDE (threshold) FROM met WHERE threshold = -1e9",
    "g12_sweep": _JUDGED + "SELECT * FROM met WHERE threshold > -1e9",
    "g18_failures": _JUDGED
    + """SELECT query_id, round(CASE WHEN nrel = 0 THEN 1 ELSE h5 / nrel END, 9)::DOUBLE AS recall, nrel = 0 AS negative FROM one
WHERE threshold = -1e9 AND ((nrel > 0 AND h5 < nrel) OR (nrel = 0 AND got > 0))""",
}
for _name in ("all", "any", "prefix"):
    SQL[{"all": "r1_all", "any": "r2_any", "prefix": "r3_prefix"}[_name]] = _retrievers(own=_name == "all") + f"SELECT query_id, rank::INTEGER AS rank, id, score FROM q_{_name}"
for _name, _key in (("chunk_all", "r4_chunk_all"), ("chunk_any", "r5_chunk_any")):
    SQL[_key] = _retrievers(own=_name == "chunk_all") + f"SELECT query_id, rank::INTEGER AS rank, id, chunk_id, score FROM q_{_name}"
