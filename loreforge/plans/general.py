"""Queries on hierarchies and references, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.operators import hierarchy as tree
from loreforge.operators import references as ref
from loreforge.session import table
from loreforge.tables import current, read


def _links(spark: SparkSession, d: str) -> DataFrame:
    return current(read(spark, d, "lessons"), "repeats")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and status of every lesson that repeats another."""
    found = tree.located(_links(spark, d), parent="repeats").filter(F.col("parent").isNotNull())
    return found.select("id", "root_id", "depth", "status")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Full path, depth, root, status and number of descendants of every lesson."""
    out = tree.hierarchy(_links(spark, d), parent="repeats")
    return out.select("id", "root_id", "depth", "status", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every lesson with each lesson below it."""
    return tree.descendants(_links(spark, d), parent="repeats")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ref.knowledge_store_references(*(read(spark, d, t) for t in ("lessons", "lessons_archive", "lesson_chunks", "chunk_embeddings")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is missing, archived or arrived later than they did."""
    return ref.broken_references(*_references(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, reason and quarter."""
    return p6_found(spark, d).groupBy("child_table", "reason", "period").agg(F.count("*").alias("n"), F.countDistinct("ref_id").alias("targets"))


def p6_orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys with references and no record, with the number of references."""
    return ref.orphan_keys(_references(spark, d)[1]).select(F.col("target").alias("target_table"), F.col("key").alias("ref_id"), "refs", "reason")


def p6_from_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The same keys from a state kept quarter by quarter, each quarter's deltas only.

    A quarter brings the rows loaded in it, in every version and repeat. The quarter after, the
    lessons among them of severity tip go again, and one more quarter later they come back: in the end the state is that of the whole tables. A lesson's reference is that
    of its newest version so far, the one before being taken back.
    """
    les, chu, emb = (read(spark, d, t) for t in ("lessons", "lesson_chunks", "chunk_embeddings"))
    quarter = F.trunc("loaded_at", "quarter")
    seen = les.select(quarter.alias("q")).union(chu.select(quarter)).union(emb.select(quarter)).distinct()
    quarters = sorted((r["q"] for r in seen.collect()), key=lambda q: (q is not None, q))  # four a year
    state = ref.apply_deltas(None, ref.existence_deltas(read(spark, d, "lessons_archive"), "lessons", "id", archived=True))
    for k, q in enumerate([*quarters, None, None]):
        deltas = []
        if k < len(quarters):
            for df, key, value, target, order in ((les, "id", "repeats", "lessons", F.struct("updated_at", "loaded_at")), (chu, "id", "lesson_id", "lessons", None), (emb, "chunk_id", "chunk_id", "lesson_chunks", None)):
                deltas += ref.reference_changes(df, quarter, q, key, value, target, order)
            deltas += [ref.existence_deltas(t.filter(quarter.eqNullSafe(F.lit(q))), name, "id", loaded="loaded_at") for t, name in ((les, "lessons"), (chu, "lesson_chunks"))]
        for back, sign in ((1, -1), (2, 1)):
            if 0 <= k - back < len(quarters):
                moved = les.filter(quarter.eqNullSafe(F.lit(quarters[k - back])) & (F.col("severity") == "tip"))
                deltas.append(ref.existence_deltas(moved, "lessons", "id", sign=sign, loaded="loaded_at"))
        state = table(ref.apply_deltas(state, *deltas), "references")
    return ref.orphan_keys(state).select(F.col("target").alias("target_table"), F.col("key").alias("ref_id"), "refs", "reason")


QUERIES = {f.__name__: f for f in (p5_found, p5_hierarchy, p5_descendants, p6_found, p6_report, p6_orphan_keys, p6_from_deltas)}

_CUR = "cur AS (SELECT id, repeats FROM (SELECT id, repeats, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM lessons) WHERE rn = 1)"
_WALK = f"""WITH RECURSIVE {_CUR},
walk(id, node, dist, trail) AS (
  SELECT id, id, 0::BIGINT, [id] FROM cur
  UNION ALL
  SELECT w.id, p.id, w.dist + 1, list_append(w.trail, p.id)
  FROM walk w JOIN cur c ON c.id = w.node JOIN cur p ON p.id = c.repeats
  WHERE NOT list_contains(w.trail, p.id)),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist DESC) = 1),
facts AS (
  SELECT e.id, own.repeats AS parent, e.trail, e.dist, e.node,
         CASE WHEN c.repeats IS NULL THEN 'tree' WHEN p.id IS NULL THEN 'open' ELSE 'cycle' END AS status,
         list_position(e.trail, c.repeats) AS enters
  FROM ends e JOIN cur c ON c.id = e.node LEFT JOIN cur p ON p.id = c.repeats JOIN cur own ON own.id = e.id),
solved AS (
  SELECT id, parent, status,
         CASE WHEN status = 'cycle' THEN list_min(list_slice(trail, enters, len(trail))) ELSE node END AS root_id,
         CASE WHEN status = 'cycle' THEN enters - 1 ELSE dist END::BIGINT AS depth,
         list_reverse(CASE WHEN status = 'cycle' THEN list_slice(trail, 1, enters) ELSE trail END) AS path
  FROM facts),
below AS (SELECT a.unnest AS ancestor_id, id AS descendant_id, depth - (a.ord - 1) AS distance
          FROM solved, unnest(path) WITH ORDINALITY AS a(unnest, ord) WHERE a.unnest <> id)
"""
_REFS = """WITH les AS (SELECT id, arg_max(coalesce(repeats, -1), (updated_at, loaded_at)) AS r, min(loaded_at) AS since FROM lessons GROUP BY id),
chu AS (SELECT id, min(lesson_id) AS r, min(loaded_at) AS since FROM lesson_chunks GROUP BY id),
emb AS (SELECT chunk_id AS id, chunk_id AS r, min(loaded_at) AS since FROM chunk_embeddings GROUP BY chunk_id),
kids AS (
  SELECT 'lesson_chunks' AS child_table, id AS child_id, 'lessons' AS target, r AS ref_id, since FROM chu WHERE r IS NOT NULL
  UNION ALL SELECT 'chunk_embeddings', id, 'lesson_chunks', r, since FROM emb
  UNION ALL SELECT 'lessons', id, 'lessons', r, since FROM les WHERE r >= 0),
there AS (SELECT 'lessons' AS target, id, since FROM les UNION ALL SELECT 'lesson_chunks', id, since FROM chu),
gone AS (SELECT DISTINCT 'lessons' AS target, id FROM lessons_archive),
found AS (
  SELECT k.child_table, k.child_id, k.target, k.ref_id,
         CASE WHEN t.id IS NOT NULL THEN CASE WHEN t.since > k.since THEN 'late' END WHEN g.id IS NOT NULL THEN 'archived' ELSE 'missing' END AS reason,
         strftime(k.since, '%Y-%m') AS period
  FROM kids k LEFT JOIN there t ON t.target = k.target AND t.id = k.ref_id LEFT JOIN gone g ON g.target = k.target AND g.id = k.ref_id)
"""

SQL = {
    "p5_found": _WALK + "SELECT id, root_id, depth, status FROM solved WHERE parent IS NOT NULL",
    "p5_hierarchy": _WALK
    + """SELECT s.id, root_id, depth, status, array_to_string(path, '/') AS path, coalesce(n, 0)::BIGINT AS descendants
FROM solved s LEFT JOIN (SELECT ancestor_id, count(*) AS n FROM below GROUP BY 1) b ON b.ancestor_id = s.id""",
    "p5_descendants": _WALK + "SELECT ancestor_id, descendant_id, distance::BIGINT AS distance FROM below",
    "p6_found": _REFS + "SELECT child_table, child_id, ref_id, reason, period FROM found WHERE reason IS NOT NULL",
    "p6_report": _REFS + "SELECT child_table, reason, period, count(*) AS n, count(DISTINCT ref_id) AS targets FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_from_deltas": _REFS + "SELECT target AS target_table, ref_id, count(*) AS refs, reason FROM found WHERE reason IN ('missing', 'archived') GROUP BY ALL",
    "p6_orphan_keys": _REFS + "SELECT target AS target_table, ref_id, count(*) AS refs, reason FROM found WHERE reason IN ('missing', 'archived') GROUP BY ALL",
}
