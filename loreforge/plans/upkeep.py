"""Queries on keeping the store: changes, repairs, summaries, and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.operators import chunking, digest, embed, events, store
from loreforge.plans.search import CUR, LESSON, PAS, _terms, lessons, passages
from loreforge.session import scratch
from loreforge.streaming import incidents as stream
from loreforge.tables import read, tag_array


def s4_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Archived lessons with the columns that only newer tables have."""
    return store.migrate(read(spark, d, "lessons_archive")).select("id", "shown_count", "last_shown_at", "scope", "repeats", "archived_at")


def s17_lessons(spark: SparkSession, d: str) -> DataFrame:
    return digest.lesson_listing(lessons(spark, d))


def s17_projects(spark: SparkSession, d: str) -> DataFrame:
    return digest.project_listing(read(spark, d, "project_index"))


def p3_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags of every lesson, whichever way they were written down."""
    return lessons(spark, d).select("id", F.explode(tag_array(F.col("tags"))).alias("tag"))


def k3_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """Passages after lessons without any were cut and those of missing lessons removed."""
    les, pas = lessons(spark, d), passages(spark, d)
    gone = chunking.stranded(les, pas).select("lesson_id")
    return chunking.ensure(les, chunking.remove(pas, gone).select("id", "lesson_id", F.col("ord").cast("int").alias("ord"), "text"))


def k6_without_passages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.missing(lessons(spark, d), passages(spark, d)).select("id")


def k10_orphan_vectors(spark: SparkSession, d: str) -> DataFrame:
    vec = read(spark, d, "chunks_vec").select(F.col("chunk_id").alias("id")).distinct()
    return embed.prune(vec, passages(spark, d))[1]


def k12_pending(spark: SparkSession, d: str) -> DataFrame:
    vec = read(spark, d, "chunks_vec").filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").alias("id"))
    return embed.pending(passages(spark, d), vec).select("id", "lesson_id")


def k12_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What embedding all pending passages with the offline default does."""
    v = read(spark, d, "chunks_vec").filter(F.size("embedding") == 64).groupBy(F.col("chunk_id").alias("id")).agg(F.min("embedding").alias("v"))
    return embed.backfill(passages(spark, d).select("id", "text"), v, embed.hashing_embedder(64), 64)[1]


def k14_forget(spark: SparkSession, d: str) -> DataFrame:
    """Lessons and archive after every lesson of severity tip was forgotten."""
    les, arch = store.forget(lessons(spark, d), read(spark, d, "lessons_archive"), lessons(spark, d).filter(F.col("severity") == "tip"), "tip", confirm=True)
    return les.select(F.lit("lessons").alias("place"), "id").unionByName(arch.select(F.lit("archive").alias("place"), "id"))


def k15_restore(spark: SparkSession, d: str) -> DataFrame:
    """Lessons after everything in the archive was restored."""
    arch = read(spark, d, "lessons_archive")
    return store.restore(lessons(spark, d), arch, arch, confirm=True)[0].select("id", "content", "scope")


def k16_rescope(spark: SparkSession, d: str) -> DataFrame:
    """Scope of every lesson after lessons 1 to 20 became global."""
    return store.rescope(lessons(spark, d), list(range(1, 21))).select("id", "scope")


def k17_shown(spark: SparkSession, d: str) -> DataFrame:
    """Counters after every view event showed the lesson of its user's number."""
    shown = read(spark, d, "events").filter(F.col("event_type") == "view").select(F.col("user_id").alias("id"), F.col("ts").alias("at"))
    return store.record_shown(lessons(spark, d), shown).select("id", "shown_count", "last_shown_at")


def k19_export(spark: SparkSession, d: str) -> DataFrame:
    return store.export_rows(lessons(spark, d))


def k20_markdown(spark: SparkSession, d: str) -> DataFrame:
    return store.export_markdown(lessons(spark, d))


def k21_import(spark: SparkSession, d: str) -> DataFrame:
    """Archived lessons whose content is not among the lessons."""
    return store.import_new(lessons(spark, d), read(spark, d, "lessons_archive"))[0].select("id", "content")


def k22_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What importing the newest archived lesson of each source would do."""
    arch = read(spark, d, "lessons_archive").filter(F.col("source").isNotNull())
    one = arch.groupBy("source").agg(F.max_by("content", F.struct("updated_at", "id")).alias("content"))
    return store.plan_upsert(lessons(spark, d), one).select("source", "id", "action")


def g3_project_names(spark: SparkSession, d: str) -> DataFrame:
    return digest.project_names(lessons(spark, d), read(spark, d, "project_index"))


def g4_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return digest.dashboard(lessons(spark, d), as_of=F.lit("2025-01-01").cast("timestamp"))


def g6_categories(spark: SparkSession, d: str) -> DataFrame:
    return lessons(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def g13_health(spark: SparkSession, d: str) -> DataFrame:
    vec = read(spark, d, "chunks_vec").filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").alias("id"))
    return digest.coverage_counts(lessons(spark, d), passages(spark, d), vec)


def g16_projects(spark: SparkSession, d: str) -> DataFrame:
    """Every project with its index entry and its lessons."""
    return digest.project_summary(lessons(spark, d), read(spark, d, "project_index"))


def w5_digest(spark: SparkSession, d: str) -> DataFrame:
    """What a session in each indexed project opens with."""
    return digest.session_digest(lessons(spark, d), read(spark, d, "project_index").select(F.col("name").alias("project")))


def w7_scope_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lessons that speak of tools and name no project, all of them."""
    out = digest.scope_candidates(lessons(spark, d), read(spark, d, "project_index"), limit=None)
    return out.select("id", F.array_join("matched", ",").alias("matched"))


def _failures(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "event_type")


def e5_failures(spark: SparkSession, d: str) -> DataFrame:
    """Errors of one user with one key, from the second on."""
    return events.repeated_failures(_failures(read(spark, d, "events")), "session_id", "key", "at", "seq", F.col("event_type") == "error")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    reader = spark.readStream.schema(schema)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return reader.parquet(f"{d}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows that a stream writes to a table in the shared folder before it runs dry."""
    import uuid

    out = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + ".state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def e5_failures_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same by keyed state over a stream."""
    failed = _failures(_event_stream(spark, d)).filter(F.col("event_type") == "error").drop("event_type")
    return _drained(spark, stream.repeated_failures(failed))


def e9_never_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first view of each key."""
    offers = _failures(_event_stream(spark, d)).filter(F.col("event_type") == "view").select("session_id", F.col("key").cast("long").alias("id"), "at")
    return _drained(spark, stream.never_repeat(offers))


def e6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by gaps of half an hour."""
    return stream.session_activity(read(spark, d, "events"))


def e6_hourly(spark: SparkSession, d: str) -> DataFrame:
    return stream.windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4))


def _commands(spark: SparkSession, d: str) -> DataFrame:
    """Shell lines of documents; each is run, and fails when a document says it again."""
    lines = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.col("created_at").alias("ts"), F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))
    cmd = lines.filter(F.col("line").rlike(r"^\s*(- )?\$ ")).withColumn("command", F.regexp_replace("line", r"^\s*(- )?\$ ", ""))
    return cmd.select("session_id", "ts", "seq", F.explode(F.array(F.lit("run"), F.lit("failure"))).alias("event"), "command")


def e4_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Undone work and repeated failures among the shell lines of documents."""
    return events.incidents(_commands(spark, d))


def e8_incident_digest(spark: SparkSession, d: str) -> DataFrame:
    return events.incident_digest(e4_incidents(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        s4_migrated, s17_lessons, s17_projects, k3_reindexed, k6_without_passages, k10_orphan_vectors, k12_pending, k12_backfill, k14_forget,
        k15_restore, k16_rescope, k17_shown, k19_export, k20_markdown, k21_import, k22_upsert, g3_project_names, g4_dashboard, g6_categories,
        g13_health, g16_projects, w5_digest, w7_scope_candidates, e4_incidents, e5_failures, e5_failures_streamed, e6_sessions, e6_hourly,
        e8_incident_digest, e9_never_repeat,
    )
} | {"f3_tags": p3_tags}

def _labels() -> str:
    """The label of the undo that the heads of commands (``ran``, ``copied``) tell, as SQL."""
    whens = []
    for name, pattern, _ in events.UNDO:
        if pattern:
            whens.append(f"WHEN len(list_filter(ran, lambda c: regexp_matches(c, '^(?:{pattern})'))) > 0 THEN '{name}'")
        else:
            words = r"list_filter(regexp_split_to_array(trim(c), '\s+'), lambda w: NOT starts_with(w, '-'))"
            back = r"""len(w) >= 3 AND regexp_matches(w[1], '^(?:\S*/)?(?:cp|mv|rsync|install)$') AND NOT regexp_matches(w[len(w)], '^["'']*(?:(?:/private)?/tmp/|/var/folders/)')
    AND len(list_filter(w[2:len(w) - 1], lambda x: regexp_matches(x, '\.(bak|backup|orig)\b'))) > 0"""
            whens.append(f"WHEN len(list_filter(list_transform(copied, lambda c: {words}), lambda w: {back})) > 0 THEN '{name}'")
    return "CASE " + "\n  ".join(whens) + " END"


def _heads(text: str, leading: str) -> str:
    return rf"list_transform(regexp_split_to_array(regexp_replace({text}, '(<<-?\s*[\x22'']?\w+[\x22'']?).*$', '\1'), '&&|\|\||[;|&\n]'), lambda c: regexp_replace(c, '^\s*(?:(?:\w+=\S*|{leading})\s+)*(\S)', '\1'))"


_MEANING = "CASE label " + " ".join(f"WHEN '{n}' THEN '{m}'" for n, _, m in events.UNDO) + " END"
_INCIDENTS = rf"""WITH line AS (
  SELECT doc_id::VARCHAR AS session_id, created_at AS ts, unnest(l) AS line, generate_subscripts(l, 1) AS seq FROM (SELECT doc_id, created_at, regexp_split_to_array("text", '\r?\n') AS l FROM documents)),
cmds AS (SELECT * FROM (SELECT session_id, ts, seq, substr(regexp_replace(line, '^\s*(- )?\$ ', ''), 1, 400) AS cmd FROM line WHERE regexp_matches(line, '^\s*(- )?\$ ')) WHERE cmd <> ''),
keyed AS (SELECT *, substr(regexp_replace(regexp_replace(cmd, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 120) AS key FROM cmds),
again AS (SELECT *, count(*) OVER (PARTITION BY session_id, key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS count FROM keyed),
heads AS (SELECT *, {_heads("cmd", "command|env|nohup|sudo|time")} AS ran, {_heads(r"regexp_replace(cmd, '\$\([^)]*\)|`[^`]*`', '', 'g')", "command|env|sudo")} AS copied FROM cmds),
labelled AS (SELECT session_id, ts, cmd, {_labels()} AS label FROM heads),
inc AS (
  SELECT session_id, ts, 'retry' AS kind, NULL::VARCHAR AS label, NULL::VARCHAR AS meaning, key AS cmd, count FROM again WHERE count >= 2
  UNION ALL SELECT session_id, ts, 'revert', label, {_MEANING}, cmd, NULL FROM labelled WHERE label IS NOT NULL)
"""
_P = PAS.split(",\nlive")[0]
_FAIL = """SELECT session_id, key, "at", count FROM (
  SELECT user_id::VARCHAR AS session_id, json_extract_string(props, '$.k') AS key, ts AS "at", count(*) OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS count
  FROM events WHERE event_type = 'error') WHERE count >= 2"""
_TAG_TEXT = "CASE WHEN starts_with(trim(tags), '[') THEN from_json(trim(tags), '[\"VARCHAR\"]') ELSE string_split(tags, ',') END"
_TAG_LIST = rf"list_sort(list_distinct(list_filter(list_transform({_TAG_TEXT}, lambda t: lower(trim(t))), lambda t: t <> '')))"
_MARKERS = ", ".join(f"'{m}'" for m in digest.TOOL_MARKERS)
_RANK = "CASE WHEN severity = 'critical' THEN 0 WHEN severity IN ('important', 'high') THEN 1 ELSE 2 END"

SQL = {
    "s4_migrated": "SELECT id, 0::BIGINT AS shown_count, NULL::TIMESTAMP AS last_shown_at, coalesce(scope, 'project') AS scope, repeats, archived_at FROM lessons_archive",
    "s17_lessons": f"""WITH {CUR} SELECT id, 'lesson://' || id AS uri, '[' || coalesce(severity, 'info') || '] ' || substr(coalesce(content, ''), 1, 80) AS title FROM cur ORDER BY created_at DESC, id DESC LIMIT 200""",
    "s17_projects": "SELECT name, 'project://' || url_encode(name) AS uri FROM project_index ORDER BY name LIMIT 200",
    "f3_tags": f"WITH {CUR} SELECT id, unnest({_TAG_LIST}) AS tag FROM cur",
    "k6_without_passages": f"WITH {CUR} SELECT id FROM cur WHERE id NOT IN (SELECT lesson_id FROM lesson_chunks)",
    "k10_orphan_vectors": "SELECT DISTINCT chunk_id AS id FROM chunks_vec WHERE chunk_id NOT IN (SELECT id FROM lesson_chunks)",
    "k12_pending": f"WITH {_P} SELECT id, lesson_id FROM pas WHERE id NOT IN (SELECT chunk_id FROM chunks_vec WHERE embedding IS NOT NULL)",
    "k12_backfill": f"""WITH {_P}, todo AS (SELECT * FROM pas WHERE id NOT IN (SELECT chunk_id FROM chunks_vec WHERE len(embedding) = 64))
SELECT count(*) FILTER (regexp_matches(coalesce("text", ''), '\\S')) AS embedded, count(*) FILTER (NOT regexp_matches(coalesce("text", ''), '\\S')) AS failed, count(*) FILTER (NOT regexp_matches(coalesce("text", ''), '\\S')) AS remaining FROM todo""",
    "k14_forget": f"""WITH {CUR} SELECT 'lessons' AS place, id FROM cur WHERE severity IS NULL OR severity <> 'tip'
UNION ALL SELECT 'archive', id FROM cur WHERE severity = 'tip' UNION ALL SELECT 'archive', id FROM lessons_archive""",
    "k15_restore": f"""WITH {CUR} SELECT id, content, scope FROM cur
UNION ALL SELECT id, arg_max(content, archived_at), coalesce(arg_max(scope, archived_at), 'project') FROM lessons_archive WHERE id NOT IN (SELECT id FROM cur) GROUP BY id""",
    "k16_rescope": f"WITH {CUR} SELECT id, CASE WHEN id BETWEEN 1 AND 20 AND coalesce(scope, 'project') <> 'global' THEN 'global' ELSE scope END AS scope FROM cur",
    "k17_shown": f"""WITH {CUR}, ev AS (SELECT user_id AS id, count(*) AS n, max(ts) AS "at" FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT cur.id, coalesce(shown_count, 0) + coalesce(n, 0) AS shown_count, greatest(last_shown_at, "at") AS last_shown_at FROM cur LEFT JOIN ev USING (id)""",
    "k20_markdown": rf"""WITH {CUR}, b AS (SELECT coalesce(category, '') AS section, id, {_TAG_LIST} AS t, coalesce(content, '') AS c FROM cur)
SELECT section, id, c || CASE WHEN len(t) > 0 THEN E'\n\nTags: ' || array_to_string(t, ', ') ELSE '' END || E'\n\n---' AS markdown FROM b
UNION ALL SELECT section, NULL, '## ' || section || ' (' || count(*) || ')' FROM b GROUP BY section""",
    "k21_import": f"""WITH {CUR} SELECT arg_min(id, (created_at, id)) AS id, content FROM lessons_archive
WHERE content IS NOT NULL AND content NOT IN (SELECT content FROM cur WHERE content IS NOT NULL) GROUP BY content""",
    "k22_upsert": f"""WITH {CUR}, new AS (SELECT source, arg_max(content, (updated_at, id)) AS content FROM lessons_archive WHERE source IS NOT NULL GROUP BY 1),
old AS (SELECT source, id, content FROM cur WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, id DESC) = 1)
SELECT source, old.id, CASE WHEN old.id IS NULL THEN 'insert' WHEN old.content IS NOT DISTINCT FROM new.content THEN 'skip' ELSE 'update' END AS action FROM new LEFT JOIN old USING (source)""",
    "g3_project_names": f"WITH {CUR} SELECT DISTINCT n AS name FROM (SELECT lower(trim(project)) AS n FROM cur UNION ALL SELECT lower(trim(name)) FROM project_index) WHERE length(n) >= 3",
    "g4_dashboard": f"""WITH {CUR}, one AS (SELECT count(*) AS lessons, count(*) FILTER (coalesce(shown_count, 0) > 0) AS shown,
  count(*) FILTER (created_at < TIMESTAMP '2024-12-02' AND coalesce(shown_count, 0) = 0) AS stale, count(*) FILTER (severity IN ('critical', 'important')) AS loud FROM cur)
SELECT 'total' AS section, 'lessons' AS name, lessons AS n, NULL::DOUBLE AS value FROM one
UNION ALL SELECT 'use', 'shown', shown, NULL FROM one UNION ALL SELECT 'use', 'older than 30 days and never shown', stale, NULL FROM one
UNION ALL SELECT 'warning', 'too many critical and important', loud, NULL FROM one WHERE loud >= 0.6 * lessons AND lessons > 0
UNION ALL SELECT 'category', coalesce(category, ''), count(*), NULL FROM cur GROUP BY 2
UNION ALL SELECT 'project', coalesce(project, ''), count(*), NULL FROM cur GROUP BY 2
UNION ALL SELECT 'severity', coalesce(severity, ''), count(*), round(CASE WHEN coalesce(severity, '') IN ('critical', 'important') THEN 1 + 0.3 * (1 - count(*)::DOUBLE / (SELECT count(*) FROM cur)) ELSE 1 END, 9) FROM cur GROUP BY coalesce(severity, '')""",
    "g6_categories": f"WITH {CUR} SELECT category, count(*) AS n FROM cur GROUP BY 1",
    "g13_health": f"""WITH {CUR}, {_P}, e AS (SELECT DISTINCT chunk_id AS id FROM chunks_vec WHERE embedding IS NOT NULL)
SELECT (SELECT count(*) FROM cur) AS lessons, (SELECT count(*) FROM cur WHERE scope = 'global') AS global_lessons,
  (SELECT count(*) FROM cur WHERE id NOT IN (SELECT lesson_id FROM pas)) AS without_passages, (SELECT count(*) FROM pas) AS passages,
  (SELECT count(*) FROM pas WHERE lesson_id NOT IN (SELECT id FROM cur)) AS orphan_passages, (SELECT count(*) FROM e WHERE id IN (SELECT id FROM pas)) AS embedded_passages,
  (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM pas)) AS orphan_vectors, (SELECT count(*) FROM pas WHERE id NOT IN (SELECT id FROM e)) AS pending_passages,
  (SELECT count(DISTINCT lesson_id) FROM pas WHERE id IN (SELECT id FROM e)) AS embedded_lessons""",
    "g16_projects": f"""WITH {CUR} SELECT coalesce(p.name, c.project) AS name, status, description, array_to_string(stack, ',') AS stack, c.id AS lesson, severity, c.created_at
FROM (SELECT * FROM cur WHERE project IS NOT NULL) c FULL JOIN project_index p ON p.name = c.project""",
    "w5_digest": f"""WITH {CUR}, ask AS (SELECT DISTINCT name AS asked FROM project_index),
own AS (SELECT asked, id, content, 0 AS stage, row_number() OVER (PARTITION BY asked ORDER BY {_RANK}, updated_at DESC, id) AS n FROM ask JOIN cur ON starts_with(asked, project) QUALIFY n <= 12),
wide AS (SELECT asked, id, content, 1 AS stage, row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, updated_at DESC, id) AS n
  FROM ask JOIN cur ON coalesce(scope, 'project') = 'global' AND project IS DISTINCT FROM asked QUALIFY n <= 4),
every AS (SELECT * FROM own UNION ALL SELECT * FROM wide),
kept AS (SELECT *, min(stage) OVER (PARTITION BY asked, content) AS first, row_number() OVER (PARTITION BY asked, content ORDER BY stage, n) AS d FROM every QUALIFY stage = 0 OR (first = stage AND d = 1))
SELECT asked AS project, row_number() OVER (PARTITION BY asked ORDER BY stage, n)::INTEGER AS rank, id FROM kept QUALIFY rank <= 16""",
    "w7_scope_candidates": f"""WITH {CUR}, loc AS (SELECT * FROM cur WHERE coalesce(scope, 'project') <> 'global'),
{_terms(source="loc", key="id", column="content").replace("eval_items", "loc")},
lt AS (SELECT query_id AS id, list(w) AS ws FROM term GROUP BY 1),
names AS (SELECT DISTINCT n FROM (SELECT lower(trim(project)) AS n FROM cur UNION ALL SELECT lower(trim(name)) FROM project_index) WHERE length(n) >= 3),
parts AS (SELECT n, list_filter(regexp_split_to_array(n, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 3) AS p FROM names),
free AS (SELECT lt.* FROM lt WHERE NOT EXISTS (SELECT 1 FROM parts WHERE len(p) > 0 AND list_has_all(ws, p)))
SELECT id, array_to_string(list_sort(list_filter(ws, lambda w: w IN ({_MARKERS}))), ',') AS matched FROM free WHERE len(list_filter(ws, lambda w: w IN ({_MARKERS}))) >= 2""",
    "e4_incidents": _INCIDENTS + "SELECT * FROM inc",
    "e8_incident_digest": _INCIDENTS
    + """, told AS (SELECT session_id, list(concat_ws(' ', kind, label, substr(cmd, 1, 140)) ORDER BY ts, kind, cmd) AS l FROM inc GROUP BY 1)
SELECT session_id, len(l) AS n, array_to_string(l[1:6], chr(10)) || CASE WHEN len(l) > 6 THEN chr(10) || '…and ' || (len(l) - 6) || ' more' ELSE '' END AS digest FROM told""",
    "e5_failures": _FAIL,
    "e5_failures_streamed": _FAIL,
    "e6_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, k""",
    "e6_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "e9_never_repeat": """SELECT user_id::VARCHAR AS session_id, json_extract_string(props, '$.k')::BIGINT AS id, min(ts) AS "at" FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
}
