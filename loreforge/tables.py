"""Readers for the driver's tables and the shared notions of a current row and a first load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG_JSON = "array<string>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(df: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """The row with the greatest ``updated_at`` (then ``loaded_at``) of each key, with ``columns`` only.

    Partial aggregation keeps one row per key and task before the shuffle, so a
    key that was delivered millions of times costs one row per task. Rows with a
    null key are no records and are left out; a null ``updated_at`` is oldest.
    """
    pick = F.struct(*[F.col(c) for c in columns])
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(pick, F.struct("updated_at", "loaded_at")).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in columns])
    )


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One record per key: the row that arrived first; rows without ``loaded_at`` count as the last."""
    pick = F.struct(*[F.col(c) for c in columns])
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(pick, F.struct(F.col("loaded_at").isNull(), F.col("loaded_at"))).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in columns])
    )


def tag_array(tags: Column) -> Column:
    """``tags`` text as sorted distinct tags, trimmed and lower-cased.

    Accepts JSON array text and comma-separated text; null and broken text give an
    empty array (broken JSON is read as a comma-separated list without brackets).
    """
    text = F.trim(tags)
    json = F.from_json(text, TAG_JSON)
    bare = F.split(F.regexp_replace(text, r'^\[|\]$|"', ""), ",")
    raw = F.when(text.startswith("["), F.coalesce(json, bare)).otherwise(F.split(tags, ","))
    clean = F.transform(raw, lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    kept = F.filter(clean, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast(TAG_JSON))


#: The tables of a store, as they are created; older ones are brought up to date by ``store.migrate``.
STORE = {
    "lessons": "id long, category string, tags string, content string, source string, project string, severity string, created_at timestamp, updated_at timestamp, "
    "shown_count long, last_shown_at timestamp, scope string, repeats long",
    "lessons_archive": "id long, category string, tags string, content string, source string, project string, severity string, created_at timestamp, updated_at timestamp, "
    "shown_count long, last_shown_at timestamp, scope string, repeats long, archived_at timestamp, reason string",
    "passages": "id long, lesson_id long, ord int, text string",
    "vectors": "id long, v array<float>, model string",
    "patterns": "id long, name string, pattern_type string, description string, example string, projects array<string>",
    "projects": "name string, path string, stack array<string>, status string, description string, last_scanned timestamp",
}


def open_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of the store under ``folder``; one that is not there yet is empty."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = {}
    for name, schema in STORE.items():
        p = fs.Path(f"{folder}/{name}")
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        out[name] = spark.read.parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)
    return out


def create_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Writes the tables that are missing under ``folder`` as empty ones and opens the store; what is there stays."""
    for name, df in open_store(spark, folder).items():
        if df.isEmpty():
            df.write.mode("ignore").parquet(f"{folder}/{name}")
    return open_store(spark, folder)
