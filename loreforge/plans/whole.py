"""Queries on the store as a whole: learning, forgetting, vectors, patterns, contexts and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.operators import digest, embed, events, knowledge, store
from loreforge.operators.index import build
from loreforge.operators.retrieve import FIELDS
from loreforge.sources.files import _LESSON
from loreforge.plans.search import CUR, PAS, _keeper, _occ, lessons, passages
from loreforge.plans.upkeep import _RANK, _TAG_LIST
from loreforge.streaming import incidents as stream
from loreforge.tables import read, tag_array

#: Patterns of our own; the tables have none.
PATTERNS = (
    ("retry with a cap", "resilience", "Retries end after a stated number", "retry(3)", ("northquay", "birchdesk")),
    ("one writer", "storage", "Each file has one writer", "lock(path)", ("northquay",)),
    ("plain names", "style", "Names say what a thing is", None, ()),
)


def _knowledge(spark: SparkSession, d: str, indexed: bool = False) -> knowledge.Knowledge:
    les = _keeper(spark, d, "lessons", "lesson_chunks")("store-lessons", lambda: lessons(spark, d))
    vec = read(spark, d, "chunks_vec").filter(F.size("embedding") == 64).groupBy(F.col("chunk_id").alias("id")).agg(F.min("embedding").alias("v")).withColumn("model", F.lit("large"))
    ix = build(les, FIELDS).stored() if indexed else None
    return knowledge.Knowledge(les, read(spark, d, "lessons_archive"), passages(spark, d).select("id", "lesson_id", "ord", "text"), vec, ix)


def _new(spark: SparkSession, d: str, les: DataFrame) -> DataFrame:
    """Archived lessons whose content is not among the lessons, each content once."""
    rows = store.import_new(les, read(spark, d, "lessons_archive"))[0]
    return rows.withColumn("tags", tag_array(F.col("tags")))


def s6_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Single lessons by id and single projects by name."""
    les = lessons(spark, d).filter(F.col("id").isin(1, 2, 7, 64)).select(F.lit("lesson").alias("kind"), F.col("id").cast("string").alias("key"), F.col("content").alias("text"))
    pro = read(spark, d, "project_index").filter(F.col("name") == "northquay").select(F.lit("project").alias("kind"), F.col("name").alias("key"), F.col("description").alias("text"))
    return les.unionByName(pro)


def k1_learn(spark: SparkSession, d: str) -> DataFrame:
    """The lessons that learning everything new in the archive adds, with their ids."""
    les = lessons(spark, d)
    return store.learned(les, _new(spark, d, les))[1].select("id", "content", "scope", "shown_count")


def k1_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the lessons after everything new was learned and tips were forgotten."""
    k = _knowledge(spark, d, indexed=True)
    after = k.learn(_new(spark, d, k.lessons)).forget(k.lessons.filter(F.col("severity") == "tip"), "tip", confirm=True)
    return after.lesson_index.postings.groupBy("term").agg(F.count("*").alias("lessons"), F.sum("tf").alias("occurrences"))


def k14_forgotten(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table after all tips were forgotten, and what is stranded or pending."""
    k = _knowledge(spark, d)
    return k.forget(k.lessons.filter(F.col("severity") == "tip"), "tip", confirm=True).counts()


def k15_restored(spark: SparkSession, d: str) -> DataFrame:
    """Rows of lessons, archive and vectors after everything archived was restored."""
    k = _knowledge(spark, d)
    return k.restore(k.archive, confirm=True).counts().filter(F.col("place").isin("lessons", "archive", "vectors"))


def k8_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors left after those of all tips were removed."""
    k = _knowledge(spark, d)
    tips = k.lessons.filter(F.col("severity") == "tip").select(F.col("id").alias("lesson_id"))
    return k.without_vectors(tips).vectors.select("id")


def k13_reindex(spark: SparkSession, d: str) -> DataFrame:
    """What making all passages and vectors anew with the offline default does."""
    return _knowledge(spark, d).reindex(embed.hashing_embedder(64), 64, "hashed", force=True)[1]


def _patterns(spark: SparkSession) -> DataFrame:
    none = spark.createDataFrame([], knowledge.PATTERN)
    new = spark.createDataFrame(list(PATTERNS), "name string, pattern_type string, description string, example string, projects array<string>")
    return knowledge.store_patterns(none, new)


def k18_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The stated patterns as stored."""
    return _patterns(spark).select("id", "name", "pattern_type", F.size("projects").alias("n_projects"))


def g15_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of every indexed project: its entry, lessons and patterns."""
    index = read(spark, d, "project_index")
    return knowledge.project_context(lessons(spark, d), index, _patterns(spark), index.select(F.col("name").alias("project")))


def t14_derived(spark: SparkSession, d: str) -> DataFrame:
    """The project of every flattened folder of the project index, and of folders beside them."""
    index = read(spark, d, "project_index")
    flat = F.translate("path", "/_", "--")
    folders = index.select(flat.alias("folder")).unionByName(index.select(F.concat(flat, F.lit("-notes")).alias("folder"))).distinct()
    return knowledge.derive_project(folders, index.select("name")).select("folder", "project")


def w6_digest_named(spark: SparkSession, d: str) -> DataFrame:
    """What a session in each indexed project opens with where one project's critical lessons are for all."""
    return digest.session_digest(lessons(spark, d), read(spark, d, "project_index").select(F.col("name").alias("project")), named=["northquay"])


def p14_problems(spark: SparkSession, d: str) -> DataFrame:
    """Lessons that might not be stored as they are, with the first reason."""
    return store.problems(lessons(spark, d)).select("id", "problem")


def e7_stop_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which sessions are asked for what they learned: errors stand for lessons written, odd users go on, every fifth was asked."""
    s = stream.session_activity(read(spark, d, "events"))
    rows = s.select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.unix_timestamp("start").cast("string")).alias("session_id"), (F.col("user_id") % 2 == 1).alias("continuing"),
        (F.col("user_id") % 5 == 0).alias("asked"), F.col("start").alias("started"), F.col("end").alias("stopped"), F.lit(0).alias("lessons_before"), F.col("errors").alias("lessons_now"),
    )
    return events.stop_gate(rows, least_seconds=1_900)


def e6_baselines(spark: SparkSession, d: str) -> DataFrame:
    """How many lessons there were when each session began."""
    s = stream.session_activity(read(spark, d, "events"))
    s = s.select(F.concat_ws("@", F.col("user_id").cast("string"), F.unix_timestamp("start").cast("string")).alias("session_id"), F.col("start").alias("started"))
    return events.session_baselines(s, lessons(spark, d)).select("session_id", "lessons_before")


def s17_named(spark: SparkSession, d: str) -> DataFrame:
    """The addresses of listed projects read back into names."""
    listed = digest.project_listing(read(spark, d, "project_index"))
    return listed.select("name", digest.named_by(F.col("uri")).alias("named"))


def k19_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Lessons after a round trip through the lines of an export."""
    rows = store.export_rows(lessons(spark, d)).select(F.from_json("json", _LESSON).alias("l")).select("l.*")
    return rows.select("id", "category", "content", "project", "severity", "scope", "repeats", F.array_join("tags", ",").alias("tags"))


QUERIES = {
    f.__name__: f
    for f in (
        s6_lookup, k1_learn, k1_index, k14_forgotten, k15_restored, k8_vectors, k13_reindex, k18_patterns, g15_context, t14_derived,
        w6_digest_named, p14_problems, e7_stop_gate, e6_baselines, s17_named, k19_read_back,
    )
}

_NEW = f"""fresh AS (
  SELECT content, arg_min(struct_pack(category := category, tags := tags, project := project, source := source, scope := scope), (created_at, id)) AS r FROM lessons_archive
  WHERE content IS NOT NULL AND content NOT IN (SELECT content FROM cur WHERE content IS NOT NULL) GROUP BY content),
made AS (SELECT (SELECT coalesce(max(id), 0) FROM cur) + row_number() OVER (ORDER BY sha256(content)) AS id, content, r.category AS category, r.tags AS tags, r.project AS project, r.source AS source, r.scope AS scope FROM fresh)"""
_OWN = PAS.split(",\nlive")[0]
_VEC = "vec AS (SELECT DISTINCT chunk_id AS id FROM chunks_vec WHERE len(embedding) = 64)"
_TIPPED = f"""WITH {CUR}, {_OWN}, {_VEC},
tip AS (SELECT id FROM cur WHERE severity = 'tip'),
p2 AS (SELECT * FROM pas WHERE lesson_id IS NULL OR lesson_id NOT IN (SELECT id FROM tip)),
v2 AS (SELECT * FROM vec WHERE id NOT IN (SELECT id FROM pas WHERE lesson_id IN (SELECT id FROM tip)))
"""
_CRIT = "CASE WHEN severity = 'critical' THEN 0 ELSE 1 END"

SQL = {
    "s6_lookup": f"WITH {CUR} SELECT 'lesson' AS kind, id::VARCHAR AS key, content AS \"text\" FROM cur WHERE id IN (1, 2, 7, 64) UNION ALL SELECT 'project', name, description FROM project_index WHERE name = 'northquay'",
    "k1_learn": f"WITH {CUR}, {_NEW} SELECT id, content, coalesce(scope, 'project') AS scope, 0::BIGINT AS shown_count FROM made",
    "k1_index": f"""WITH {CUR}, {_NEW},
text AS (SELECT id, content, category, tags, source, project FROM cur WHERE severity IS DISTINCT FROM 'tip'
  UNION ALL SELECT id, content, category, array_to_string({_TAG_LIST}, ','), source, project FROM made),
{_occ("l", "text", FIELDS)}
SELECT term, count(DISTINCT id) AS lessons, count(*)::BIGINT AS occurrences FROM l_occ GROUP BY 1""",
    "k14_forgotten": _TIPPED
    + """SELECT 'lessons' AS place, (SELECT count(*) FROM cur) - (SELECT count(*) FROM tip) AS n
UNION ALL SELECT 'archive', (SELECT count(*) FROM lessons_archive) + (SELECT count(*) FROM tip)
UNION ALL SELECT 'passages', count(*) FROM p2 UNION ALL SELECT 'vectors', count(*) FROM v2
UNION ALL SELECT 'stranded passages', count(*) FROM p2 WHERE lesson_id IS NULL OR lesson_id NOT IN (SELECT id FROM cur)
UNION ALL SELECT 'stranded vectors', count(*) FROM v2 WHERE id NOT IN (SELECT id FROM p2)
UNION ALL SELECT 'pending passages', count(*) FROM p2 WHERE id NOT IN (SELECT id FROM v2)""",
    "k15_restored": f"""WITH {CUR}, {_OWN}, {_VEC}, back AS (SELECT DISTINCT id FROM lessons_archive WHERE id NOT IN (SELECT id FROM cur))
SELECT 'lessons' AS place, (SELECT count(*) FROM cur) + (SELECT count(*) FROM back) AS n
UNION ALL SELECT 'archive', count(*) FROM lessons_archive WHERE id NOT IN (SELECT id FROM back)
UNION ALL SELECT 'vectors', count(*) FROM vec WHERE id NOT IN (SELECT id FROM pas WHERE lesson_id IN (SELECT id FROM back))""",
    "k8_vectors": _TIPPED + "SELECT id FROM v2",
    "k18_patterns": "SELECT row_number() OVER (ORDER BY name) AS id, name, pattern_type, n_projects FROM (VALUES " + ", ".join(f"('{n}', '{t}', {len(p)})" for n, t, _, _, p in PATTERNS) + ") v(name, pattern_type, n_projects)",
    "g15_context": f"""WITH {CUR} SELECT name AS project, 'project' AS kind, name AS key, concat_ws(': ', status, description) AS "text" FROM project_index WHERE name IS NOT NULL
UNION ALL SELECT project, 'lesson', id::VARCHAR, content FROM cur WHERE project IN (SELECT name FROM project_index)
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{q}', 'pattern', '{n}', '{x}')" for n, _, x, _, p in PATTERNS for q in p) + ") v(p, k, n, x) WHERE p IN (SELECT name FROM project_index)",
    "t14_derived": """WITH flat AS (SELECT translate(path, '/_', '--') AS f FROM project_index WHERE path IS NOT NULL),
folders AS (SELECT f AS folder FROM flat UNION SELECT f || '-notes' FROM flat),
hit AS (SELECT folder, name FROM folders JOIN (SELECT DISTINCT name FROM project_index) n ON ends_with(folder, '-' || replace(name, '_', '-')))
SELECT folder, coalesce((SELECT arg_min(name, (-length(name), name)) FROM hit WHERE hit.folder = folders.folder), nullif(string_split(folder, '-')[-1], ''), 'unknown') AS project FROM folders""",
    "w6_digest_named": f"""WITH {CUR}, ask AS (SELECT DISTINCT name AS asked FROM project_index),
own AS (SELECT asked, id, content, 0 AS stage, row_number() OVER (PARTITION BY asked ORDER BY {_RANK}, updated_at DESC, id) AS n FROM ask JOIN cur ON starts_with(asked, project) QUALIFY n <= 12),
wide AS (SELECT asked, id, content, 1 AS stage, row_number() OVER (PARTITION BY asked ORDER BY {_CRIT}, updated_at DESC, id) AS n
  FROM ask JOIN cur ON coalesce(scope, 'project') = 'global' AND project IS DISTINCT FROM asked QUALIFY n <= 4),
named AS (SELECT id, content, row_number() OVER (ORDER BY updated_at DESC, id) AS n FROM cur WHERE severity = 'critical' AND project = 'northquay' QUALIFY n <= 4),
every AS (SELECT * FROM own UNION ALL SELECT * FROM wide UNION ALL SELECT asked, id, content, 2, n FROM ask, named),
kept AS (SELECT *, min(stage) OVER (PARTITION BY asked, content) AS first, row_number() OVER (PARTITION BY asked, content ORDER BY stage, n) AS d FROM every QUALIFY stage = 0 OR (first = stage AND d = 1))
SELECT asked AS project, row_number() OVER (PARTITION BY asked ORDER BY stage, n)::INTEGER AS rank, id FROM kept QUALIFY rank <= 16""",
    "p14_problems": f"""WITH {CUR}, w AS (SELECT id, CASE WHEN content IS NULL OR content = '' THEN 'no content' WHEN length(content) > 10000 THEN 'content too long'
  WHEN category IS NULL OR category NOT IN ({", ".join(f"'{c}'" for c in store.CATEGORIES)}) THEN 'unknown category'
  WHEN severity IS NOT NULL AND severity NOT IN ({", ".join(f"'{c}'" for c in store.SEVERITIES)}) THEN 'unknown severity' WHEN length(project) > 200 THEN 'project too long' END AS problem FROM cur)
SELECT * FROM w WHERE problem IS NOT NULL""",
    "e6_baselines": f"""WITH {CUR}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
one AS (SELECT user_id || '@' || floor(epoch(min(ts)))::BIGINT AS session_id, min(ts) AS a FROM s GROUP BY user_id, k),
born AS (SELECT created_at AS at, row_number() OVER (ORDER BY created_at) AS n FROM cur WHERE created_at IS NOT NULL QUALIFY lead(created_at) OVER (ORDER BY created_at) IS DISTINCT FROM created_at)
SELECT session_id, coalesce(n, 0) AS lessons_before FROM one ASOF LEFT JOIN born ON a >= born.at""",
    "s17_named": "SELECT name, name AS named FROM project_index ORDER BY name LIMIT 200",
    "k19_read_back": f"WITH {CUR} SELECT id, category, content, project, severity, scope, repeats, coalesce(array_to_string({_TAG_LIST}, ','), '') AS tags FROM cur",
    "e7_stop_gate": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
one AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, k)
SELECT user_id || '@' || floor(epoch(a))::BIGINT AS session_id,
  user_id % 2 <> 1 AND user_id % 5 <> 0 AND floor(epoch(b))::BIGINT - floor(epoch(a))::BIGINT >= 1900 AND errors <= 0 AS ask FROM one""",
}
