"""Changes to the store as set operations: every function takes tables and gives the tables after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.text import content_hash
from loreforge.operators.joins import hot_key_join
from loreforge.session import table
from loreforge.tables import tag_array

# Categories and severities of lessons.
CATEGORIES = (
    "bug-fix", "architecture", "performance", "security", "deployment", "tooling",
    "pattern", "gotcha", "best-practice", "client", "seo", "i18n", "testing",
    "design", "marketing", "sales", "workflow", "business", "financial", "market",
    "client-feedback",
)
SEVERITIES = ("critical", "important", "info", "tip")
MAX_CONTENT, MAX_PROJECT, MAX_LIMIT = 10_000, 200, 100

#: Columns that older tables lack, with what they hold there.
ADDED = {"shown_count": ("bigint", 0), "last_shown_at": ("timestamp", None), "scope": ("string", "project"), "repeats": ("bigint", None)}


def migrate(lessons: DataFrame) -> DataFrame:
    """Adds the columns an older table lacks and fills nulls with their defaults; running it again changes nothing."""
    for name, (kind, default) in ADDED.items():
        old = F.col(name) if name in lessons.columns else F.lit(None)
        value = old.cast(kind)
        lessons = lessons.withColumn(name, value if default is None else F.coalesce(value, F.lit(default).cast(kind)))
    return lessons


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def problems(rows: DataFrame) -> DataFrame:
    """``(row..., problem)``: new lessons that may not be stored, with the first reason."""
    why = (
        F.when(F.col("content").isNull() | (F.length("content") == 0), "no content")
        .when(F.length("content") > MAX_CONTENT, "content too long")
        .when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unknown category")
        .when(F.col("severity").isNotNull() & ~F.col("severity").isin(*SEVERITIES), "unknown severity")
        .when(F.length("project") > MAX_PROJECT, "project too long")
    )
    return rows.withColumn("problem", why).filter(F.col("problem").isNotNull())


def numbered(new: DataFrame, after: DataFrame, order: list) -> DataFrame:
    """``new`` with dense ids that go on after the greatest of ``after``, in the given order.

    Rows are range-partitioned by the order and numbered within each partition; the partitions'
    counts, one small row each, give where each begins. The sorted rows are written first, so
    that partitions are the same for counting and numbering.
    """
    keys = [c.alias(f"_o{k}") for k, c in enumerate(order)]
    names = [f"_o{k}" for k in range(len(keys))]
    sorted_ = table(new.select("*", *keys).repartitionByRange(*names).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    begin = counts.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")  # one row per partition
    top = after.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*names))
    out = sorted_.withColumn("_k", within).join(F.broadcast(begin), "_p").crossJoin(F.broadcast(top))  # one row
    return out.withColumn("id", (F.col("_top") + F.col("_b") + F.col("_k")).cast("long")).drop("_p", "_b", "_k", "_top", *names)


def learned(lessons: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lessons after, rows added)`` for ``new(category, content, tags array, project, severity, scope, repeats, source)``.

    Ids go on after the greatest without gaps, in the order of the content's hash.
    """
    now = F.current_timestamp()
    made = numbered(new, lessons, [F.sha2("content", 256), F.to_json(F.struct("category", "project", "tags", "source"))])
    out = made.select(
        "id", "category", F.to_json(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), "content", "source", "project",
        F.coalesce("severity", F.lit("info")).alias("severity"), now.alias("created_at"), now.alias("updated_at"), F.lit(0).cast("long").alias("shown_count"),
        F.lit(None).cast("timestamp").alias("last_shown_at"), F.coalesce("scope", F.lit("project")).alias("scope"), F.col("repeats").cast("long").alias("repeats"),
    )
    out = out.select(lessons.columns)
    return lessons.unionByName(out), out


def learn(lessons: DataFrame, new: DataFrame) -> DataFrame:
    """The lessons after ``new`` ones were added (see ``learned``)."""
    return learned(lessons, new)[0]


def forget(lessons: DataFrame, archive: DataFrame, ids: DataFrame, reason: str | None = None, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(lessons, archive)`` after ``ids(id)`` were archived; without ``confirm`` both are as before."""
    if not confirm:
        return lessons, archive
    ids = ids.select("id").distinct()
    gone = lessons.join(ids, "id", "left_semi").withColumn("archived_at", F.current_timestamp()).withColumn("reason", F.lit(reason))
    return lessons.join(ids, "id", "left_anti"), archive.unionByName(gone, allowMissingColumns=True)


def restore(lessons: DataFrame, archive: DataFrame, ids: DataFrame, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """The inverse of ``forget``; an id that is in the lessons again stays as it is there."""
    if not confirm:
        return lessons, archive
    ids = ids.select("id").distinct().join(lessons.select("id"), "id", "left_anti")
    last = Window.partitionBy("id").orderBy(F.desc("archived_at"))
    back = archive.join(ids, "id", "left_semi").withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "archived_at", "reason")
    return lessons.unionByName(migrate(back).select([c for c in migrate(back).columns if c in lessons.columns]), allowMissingColumns=True), archive.join(ids, "id", "left_anti")


def rescope(lessons: DataFrame, ids: list[int]) -> DataFrame:
    """Lessons with these ids become global; ``updated_at`` stays. No ids is an error."""
    if not ids:
        raise ValueError("name the lessons to make global")
    hit = F.col("id").isin(ids) & (F.coalesce("scope", F.lit("project")) != "global")
    return lessons.withColumn("scope", F.when(hit, "global").otherwise(F.col("scope")))


def record_shown(lessons: DataFrame, shown: DataFrame) -> DataFrame:
    """Adds ``shown(id, at)`` events to the counters; ``updated_at`` stays."""
    per = shown.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    out = lessons.join(per, "id", "left")
    out = out.withColumn("shown_count", F.coalesce("shown_count", F.lit(0)) + F.coalesce("_n", F.lit(0)))
    return out.withColumn("last_shown_at", F.greatest("last_shown_at", "_at")).drop("_n", "_at")


def import_new(lessons: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows to insert, report)``: incoming rows whose content is not stored yet, each content once.

    ``report`` is one row ``(inserted, skipped)``. Of equal contents the oldest row wins, ties
    by the smallest id. Rows without content are skipped.
    """
    have = lessons.select(content_hash(F.col("content")).alias("_h")).distinct()
    rows = incoming.withColumn("_h", content_hash(F.col("content")))
    first = rows.filter(F.col("_h").isNotNull()).groupBy("_h").agg(F.min_by(F.struct(*incoming.columns), F.struct("created_at", "id")).alias("r"))
    fresh = first.join(have, "_h", "left_anti").select(*[F.col("r")[c].alias(c) for c in incoming.columns])
    n, total = fresh.agg(F.count("*").alias("inserted")), incoming.agg(F.count("*").alias("total"))
    return fresh, n.crossJoin(total).select("inserted", (F.col("total") - F.col("inserted")).alias("skipped"))


def plan_upsert(lessons: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming(source, content, ...)`` with ``action``: insert, update (the content differs) or skip, and the ``id`` of the row it meets.

    Of several stored rows of one source the newest counts; incoming rows are one per source.
    """
    have = lessons.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max_by(F.struct(F.col("id").alias("id"), F.col("content").alias("old")), F.struct("updated_at", "id")).alias("h"))
    out = hot_key_join(incoming, have, "source", "left")
    action = F.when(F.col("h").isNull(), "insert").when(F.col("h.old").eqNullSafe(F.col("content")), "skip").otherwise("update")
    return out.select("source", F.col("h.id").alias("id"), action.alias("action"), *[c for c in incoming.columns if c not in ("source", "id")])


def export_rows(lessons: DataFrame) -> DataFrame:
    """One JSON document per lesson, tags as arrays: lines that readers can split."""
    cols = [c for c in ("id", "category", "content", "source", "project", "severity", "created_at", "updated_at", "shown_count", "scope", "repeats") if c in lessons.columns]
    return lessons.select("id", F.to_json(F.struct(*cols, tag_array(F.col("tags")).alias("tags"))).alias("json"))


def export_markdown(lessons: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """``(section, id, markdown)``: each category's heading with its count (a null id), and one piece per lesson with its tags.

    ``patterns`` make a section of their own at the end. In the order of section and id, nulls
    first, the pieces joined by blank lines are the document; no section is ever one row.
    """
    tags = tag_array(F.col("tags"))
    body = F.concat(F.coalesce("content", F.lit("")), F.when(F.size(tags) > 0, F.concat(F.lit("\n\nTags: "), F.array_join(tags, ", "))).otherwise(""))
    rows = lessons.select(F.coalesce("category", F.lit("")).alias("section"), "id", F.concat(body, F.lit("\n\n---")).alias("markdown"))
    if patterns is not None:
        told = F.concat(F.lit("### "), F.col("name"), F.lit("\n\n"), F.coalesce("description", F.lit("")))
        rows = rows.unionByName(patterns.select(F.lit("~patterns").alias("section"), "id", told.alias("markdown")))
    heads = rows.groupBy("section").agg(F.count("*").alias("n"))
    heading = F.concat(F.lit("## "), "section", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return heads.select("section", F.lit(None).cast("long").alias("id"), heading.alias("markdown")).unionByName(rows)
