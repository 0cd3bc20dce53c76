"""Passages of lessons, and keeping them in step with the lessons."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LEAST, MOST = 400, 1_000
_BLANK = re.compile(r"\n\s*\n+")
_END = re.compile(r"[.!?…](?=\s|$)")


def _cut_point(head: str, least: int) -> int:
    line = head.rfind("\n")
    if line >= least:
        return line
    ends = [m.end() for m in _END.finditer(head) if m.start() >= least]
    return ends[-1] if ends else len(head)


def _fitting(part: str, least: int, most: int):
    """A paragraph as stretches of at most ``most`` characters."""
    while len(part) > most:
        at = _cut_point(part[:most], least)
        if piece := part[:at].strip():
            yield piece
        part = part[at:].strip()
    if part:
        yield part


def split_passages(text: str | None, least: int = LEAST, most: int = MOST) -> list[str]:
    """Passages of one text: paragraphs, long ones cut at lines, sentence ends or anywhere, short ones joined to the next.

    None and blank texts have none; a text that fits is one passage.
    """
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    out: list[str] = []
    for paragraph in filter(None, (p.strip() for p in _BLANK.split(text))):
        for piece in _fitting(paragraph, least, most):
            if out and len(out[-1]) < least and len(out[-1]) + 1 + len(piece) <= most:
                out[-1] += "\n" + piece
            else:
                out.append(piece)
    return out or [text]


@F.pandas_udf(ArrayType(StringType()))
def _passages(texts: pd.Series) -> pd.Series:
    return texts.map(split_passages)


def passage_id(lesson_id: Column, ord_: Column) -> Column:
    """Deterministic, so that rebuilding never strands a vector."""
    return lesson_id * (1 << 20) + ord_


def chunk(lessons: DataFrame) -> DataFrame:
    """``(id, lesson_id, ord, text)`` of ``lessons(id, content)``; short texts never leave the JVM."""
    from loreforge.functions.text import strip

    clean = lessons.filter(F.col("id").isNotNull()).select("id", strip(F.coalesce("content", F.lit(""))).alias("t"))
    long = F.length("t") > MOST
    parts = F.when(long, _passages(F.when(long, F.col("t")))).otherwise(F.filter(F.array("t"), lambda p: p != ""))
    rows = clean.select(F.col("id").alias("lesson_id"), F.posexplode(parts).alias("ord", "text"))
    return rows.select(passage_id(F.col("lesson_id"), F.col("ord")).alias("id"), "lesson_id", "ord", "text")


def missing(lessons: DataFrame, passages: DataFrame) -> DataFrame:
    """Lessons without any passage."""
    return lessons.join(passages.select(F.col("lesson_id").alias("id")).distinct(), "id", "left_anti")


def ensure(lessons: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages after those of lessons without any were made."""
    return passages.unionByName(chunk(missing(lessons, passages)))


def reindex(passages: DataFrame, changed: DataFrame) -> DataFrame:
    """The passages after those of the changed lessons were made anew."""
    return remove(passages, changed.select(F.col("id").alias("lesson_id"))).unionByName(chunk(changed))


def remove(passages: DataFrame, lesson_ids: DataFrame) -> DataFrame:
    return passages.join(lesson_ids.select("lesson_id").distinct(), "lesson_id", "left_anti").select(passages.columns)


def stranded(lessons: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages of lessons that are not there."""
    return passages.join(lessons.select(F.col("id").alias("lesson_id")), "lesson_id", "left_anti").select(passages.columns)
