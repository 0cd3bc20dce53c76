"""How often a lesson has come back: the length of its chain of stated repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreforge.operators.hierarchy import resolve
from loreforge.operators.joins import hot_key_join
from loreforge.operators.knn import nearest


def chain_lengths(lessons: DataFrame) -> DataFrame:
    """``(id, recurrence)`` of the lessons that repeat another: different lessons met on the walk, the first included.

    A link to a lesson that is not there counts as one more; a circle is walked once.
    """
    r = resolve(lessons, parent="repeats", sizes=False)
    rings = r.filter((F.col("status") == "cycle") & (F.col("depth") == 0)).groupBy("root_id").agg(F.count("*").alias("ring"))
    linked = hot_key_join(r.filter(F.col("parent").isNotNull()), rings, "root_id", "left")
    n = F.when(F.col("status") == "cycle", F.col("depth") + F.col("ring")).when(F.col("status") == "open", F.col("depth") + 2).otherwise(F.col("depth") + 1)
    return linked.select("id", n.cast("long").alias("recurrence"))


def suggest(queries: DataFrame, passages: DataFrame, k: int = 12, floor: float = 0.68, least: int = 250) -> DataFrame:
    """``(lesson_id, of_lesson, similarity)``: the lesson that each asked lesson most resembles.

    ``passages(chunk_id, lesson_id, text, v)``; ``queries(lesson_id)``. Only passages of ``least``
    characters or more take part; the k nearest passages of other lessons are looked at.
    """
    long = passages.filter(F.length("text") >= least).select("chunk_id", "lesson_id", "v")
    asked = long.join(queries.select("lesson_id").distinct(), "lesson_id", "left_semi")
    near = nearest(asked.select(F.col("chunk_id").alias("qid"), "v", F.col("lesson_id").alias("grp")), long.select(F.col("chunk_id").alias("id"), "v", F.col("lesson_id").alias("grp")), k, floor)
    owner = long.select(F.col("chunk_id").alias("id"), F.col("lesson_id").alias("of_lesson"))
    mine = long.select(F.col("chunk_id").alias("qid"), "lesson_id")
    rows = near.join(owner, "id").join(mine, "qid").groupBy("lesson_id", "of_lesson").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("lesson_id").orderBy(F.desc("similarity"), "of_lesson")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
