"""Readers and writers of exports, notes with front matter, incident journals and project trees."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

MAX_FILE = 1 << 20
MAX_EXPORT = 64 << 20
VERSION = 1
_LESSON = StructType(
    [
        *[StructField(n, StringType()) for n in ("category", "content", "source", "project", "severity", "scope", "created_at", "updated_at")],
        StructField("id", LongType()),
        StructField("shown_count", LongType()),
        StructField("repeats", LongType()),
        StructField("tags", ArrayType(StringType())),
    ]
)
_PATTERN = StructType([*[StructField(n, StringType()) for n in ("name", "pattern_type", "description", "example")], StructField("projects", ArrayType(StringType()))])
_EXPORT = StructType([StructField("export_version", LongType()), StructField("lessons", ArrayType(_LESSON)), StructField("patterns", ArrayType(_PATTERN))])


def confined(path: str, folder: str) -> str | None:
    """The real path of a file to be read or written inside a folder; None when it leaves it, its parent is missing, or it names a database there."""
    root, target = os.path.realpath(folder), os.path.realpath(os.path.join(folder, path))
    inside = target != root and os.path.commonpath([root, target]) == root
    return target if inside and os.path.isdir(os.path.dirname(target)) and Path(target).suffix not in (".db", ".db-wal", ".db-shm") else None


def read_export(spark: SparkSession, path: str, folder: str | None = None, most: int = MAX_EXPORT) -> tuple[DataFrame, DataFrame]:
    """``(lessons, patterns)`` of an export document; a broken or foreign file gives no rows.

    With ``folder`` a path that leaves it is an error, as is a document of more than ``most``
    bytes: one document is one row. Larger exports are JSON lines of lessons (``read_lines``).
    """
    if folder is not None:
        inside = confined(path, folder)
        if inside is None:
            raise ValueError("the file is not one inside the folder")
        path = inside
    if os.path.isfile(path) and os.path.getsize(path) > most:
        raise ValueError(f"a document of more than {most} bytes must come as JSON lines")
    doc = spark.read.schema(_EXPORT).option("multiLine", True).json(path).filter(F.col("export_version") == VERSION)
    lessons = doc.select(F.explode("lessons").alias("l")).select("l.*").filter(F.col("content").isNotNull())
    return lessons, doc.select(F.explode("patterns").alias("p")).select("p.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lessons of JSON lines; broken lines are left out."""
    return spark.read.schema(_LESSON).option("mode", "DROPMALFORMED").json(path).filter(F.col("content").isNotNull())


def write_lines(lessons: DataFrame, path: str) -> None:
    """Lessons as JSON lines, one file per task, tags as arrays."""
    from loreforge.operators.store import export_rows

    export_rows(lessons).select(F.col("json").alias("value")).write.text(path)


def export_document(lessons: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """One row with the whole export as JSON, for stores small enough to be handed out as one document."""
    from loreforge.tables import tag_array

    cols = [F.col(c).cast(_LESSON[c].dataType).alias(c) for c in _LESSON.names if c in lessons.columns and c != "tags"]
    rows = lessons.select("id", F.struct(*cols, tag_array(F.col("tags")).alias("tags")).alias("l"))
    doc = rows.agg(F.array_sort(F.collect_list(F.struct("id", "l"))).alias("x")).select(F.col("x.l").alias("lessons"))
    pats = F.array().cast(ArrayType(_PATTERN))
    if patterns is not None:
        doc = doc.crossJoin(patterns.agg(F.sort_array(F.collect_list(F.struct(*_PATTERN.names))).alias("patterns")))  # single rows
        pats = F.col("patterns")
    return doc.select(F.to_json(F.struct(F.lit(VERSION).alias("export_version"), "lessons", pats.alias("patterns"))).alias("json"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """``(source, name, description, type, body)`` of notes with front matter in ``memory`` folders; notes without it are left out."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    files = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    files = files.filter(F.col("source").rlike("/memory/") & ~F.col("source").endswith("/MEMORY.md"))
    return parse_notes(files)


def parse_notes(files: DataFrame) -> DataFrame:
    """``files(source, text)`` to the parts of their front matter and body."""
    head = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    field = lambda n: F.nullif(F.regexp_replace(F.regexp_extract(head, rf"(?m)^\s*{n}:[ \t]*(.*)$", 1), r"^[\"'\s]+|[\"'\s]+$", ""), F.lit(""))
    body = F.regexp_replace(F.regexp_extract("text", r"(?s)\A---\r?\n.*?\r?\n---[ \t]*\r?\n?(.*)\z", 1), r"(?U)^\s+|\s+$", "")
    rows = files.filter(F.col("text").rlike(r"(?s)\A---\r?\n.*?\r?\n---"))
    return rows.select("source", F.coalesce(field("name"), F.lit("")).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"), F.coalesce(field("type"), F.lit("")).alias("type"), body.alias("body"))


_CORPUS = "lessons array<struct<key:string,content:string,category:string,project:string,severity:string,scope:string>>"
_QUERIES = "queries array<struct<query:string,relevant:array<string>,project:string,category:string,requiresSemantic:boolean>>"


def read_judged(spark: SparkSession, corpus: str, queries: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, judged)`` of a judged corpus in two JSON documents.

    ``documents(id, key, content, category, project, severity, scope)`` are numbered in their
    order; ``judged(query_id, query, project, category, semantic, relevant)`` has the ids of the
    relevant documents. A query that names an unknown key is an error.
    """
    one = spark.read.schema(_CORPUS).option("multiLine", True).json(corpus).select(F.posexplode("lessons").alias("n", "l"))
    docs = one.select((F.col("n") + 1).cast("long").alias("id"), "l.*")
    rows = spark.read.schema(_QUERIES).option("multiLine", True).json(queries).select(F.posexplode("queries").alias("n", "q"))
    rows = rows.select((F.col("n") + 1).cast("long").alias("query_id"), "q.query", "q.project", "q.category", F.coalesce("q.requiresSemantic", F.lit(False)).alias("semantic"), "q.relevant")
    known = rows.select("query_id", F.explode("relevant").alias("key")).join(docs.select("key", "id"), "key", "left")
    ids = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no document with the key "), "key")).cast("long")).otherwise(F.col("id"))
    known = known.select("query_id", ids.alias("id")).groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("relevant"))
    out = rows.drop("relevant").join(known, "query_id", "left")
    return docs, out.withColumn("relevant", F.coalesce("relevant", F.array().cast("array<long>")))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents of JSON lines; broken lines are left out."""
    schema = "ts double, kind string, label string, cmd string, meaning string, count long, detail string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("kind").isNotNull())


def scan_projects(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, path, stack, description)`` of the project folders directly under ``folder``.

    The stack comes from package.json, composer.json and Dockerfile; files above one MiB and
    links are not read, hidden folders are no projects.
    """
    root = os.path.realpath(folder)
    names = [e.name for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
    rows = []
    for n in names:
        have = {f for f in ("package.json", "composer.json", "Dockerfile", "README.md") if (p := Path(root, n, f)).is_file() and not p.is_symlink() and p.stat().st_size <= MAX_FILE}
        text = {f: Path(root, n, f).read_text(errors="replace") for f in have}
        rows.append((n, str(Path(root, n)), text.get("package.json"), text.get("composer.json"), "Dockerfile" in have, text.get("README.md")))
    df = spark.createDataFrame(rows, "name string, path string, package string, composer string, docker boolean, readme string")
    deps = F.from_json("package", "dependencies map<string,string>, devDependencies map<string,string>")
    names_of = lambda c: F.coalesce(F.map_keys(deps[c]), F.array().cast("array<string>"))
    every = F.array_union(names_of("dependencies"), names_of("devDependencies"))
    known = F.filter(every, lambda d: d.isin("react", "vue", "next", "express", "typescript", "svelte"))
    stack = F.concat(F.when(F.col("package").isNotNull(), F.array(F.lit("node"))).otherwise(F.array().cast("array<string>")), F.array_sort(known))
    stack = F.concat(stack, F.when(F.col("composer").isNotNull(), F.array(F.lit("php"))).otherwise(F.array().cast("array<string>")))
    stack = F.concat(stack, F.when(F.col("docker"), F.array(F.lit("docker"))).otherwise(F.array().cast("array<string>")))
    first = F.get(F.filter(F.transform(F.split(F.coalesce("readme", F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, "^#+", ""))), lambda s: s != ""), F.lit(0))
    return df.select("name", "path", stack.alias("stack"), first.alias("description"), F.current_timestamp().alias("last_scanned"))
