"""Cutting oversized texts at natural boundaries, by balanced targets.

The fewest pieces that can hold the text give equal-length targets; each target is moved
to the strongest boundary near it (paragraph, line, sentence, word, any place), and when
some piece then breaks the limit, more pieces are planned. Where limit and overlap leave no
room for targets (an overlap of nearly the limit), full pieces are cut wherever they end.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

LIMIT, OVERLAP = 1_000, 100
BLANKS = " \t\r\n"

#: A cut falls after the match; stronger first.
_KINDS = (
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+"),
    re.compile(r"(?:\r\n|\r|\n)"),
    re.compile(r"[.!?…。][\"'”’»)\]]*\s+"),
    re.compile(r"\s+"),
)
_CUTS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("fresh", IntegerType())]))


def _boundary(text: str, low: int, high: int, target: int) -> tuple[int, int]:
    """``(strength, place)`` of the strongest boundary in [low, high], nearest to the target; (0, place) for none."""
    for rank, kind in enumerate(_KINDS):
        begin = max(0, low - 200)  # a match that ends in the range begins before it
        ends = [m.end() for m in kind.finditer(text, begin, min(len(text), high + 1)) if low <= m.end() <= high]
        if ends:
            return len(_KINDS) - rank, min(ends, key=lambda e: (abs(e - target), e))
    return 0, min(max(target, low), high)


def _inside_mark(text: str, at: int) -> bool:
    """Whether a cut would part a CR LF pair or a letter from its combining marks."""
    import unicodedata

    return 0 < at < len(text) and ((text[at - 1] == "\r" and text[at] == "\n") or bool(unicodedata.combining(text[at])) or text[at] in "‍️" or text[at - 1] == "‍")


def _overlap_start(text: str, cut: int, overlap: int, floor: int) -> int:
    """Where the next piece begins: the first sentence, else word, within ``overlap`` before the cut."""
    low = max(floor, cut - overlap)
    for kind in (_KINDS[2], _KINDS[3]):
        for m in kind.finditer(text, max(0, low - 1), cut):
            if low <= m.end() < cut:
                return m.end()
    while low < cut and _inside_mark(text, low):
        low += 1
    return low


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, end, fresh)`` of the pieces of one text: ``[start, fresh)`` repeats the piece before.

    The stretches ``[fresh, end)`` joined are the text from its first to its last character
    that is no white space. No text, no pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    a = len(text) - len(text.lstrip(BLANKS))
    b = len(text.rstrip(BLANKS))
    if a >= b:
        return []
    if b - a <= limit:
        return [(a, b, a)]
    body = text[a:b]
    n = 1 + math.ceil((len(body) - limit) / (limit - overlap))
    pieces = None
    while pieces is None and len(body) - overlap >= 2 * n:  # targets at least two characters apart
        pieces = _balanced(body, n, limit, overlap)
        n += max(1, n // 20)
    return [(s + a, e + a, f + a) for s, e, f in pieces or _hard(body, limit, overlap)]


def _hard(body: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Full pieces with the full overlap, wherever the cuts fall; holds for every limit."""
    out, start, fresh = [], 0, 0
    while len(body) - start > limit:
        at = start + limit
        while at > fresh + 1 and _inside_mark(body, at):
            at -= 1
        if _inside_mark(body, at):
            at = start + limit
        out.append((start, at, fresh))
        start, fresh = max(at - overlap, 0), at
    return [*out, (start, len(body), fresh)]


def _balanced(body: str, n: int, limit: int, overlap: int) -> list[tuple[int, int, int]] | None:
    """The pieces for ``n`` targets, or None when a limit fails."""
    even = (len(body) + (n - 1) * overlap) / n
    step = even - overlap
    reach = max(1, int(step / 3))
    out, start, fresh = [], 0, 0
    for i in range(1, n):
        target = round(overlap + i * step)
        high = min(target + reach, start + limit, len(body) - 1)
        low = max(target - reach, fresh + 1)
        if low > high:
            return None
        at = _boundary(body, low, high, min(target, high))[1]
        while at > low and _inside_mark(body, at):
            at -= 1
        out.append((start, at, fresh))
        start, fresh = (_overlap_start(body, at, overlap, fresh + 1) if overlap else at), at
    if len(body) - start > limit:
        return None
    return [*out, (start, len(body), fresh)]


def trimmed(text: Column) -> Column:
    """Text without blanks, tabs, CR and LF at both ends."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def cuts(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces of a text column as array<struct<start,end,fresh>>, in code points from 0.

    Only texts above the limit are sent to Python; null and blank texts have no pieces.
    """

    @F.pandas_udf(_CUTS)
    def long_cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t, limit, overlap))

    whole = F.length(text)
    lead = whole - F.length(F.ltrim(text, F.lit(BLANKS)))
    inner = F.length(F.trim(text, F.lit(BLANKS)))
    one = F.array(F.struct(lead.alias("start"), (lead + inner).alias("end"), lead.alias("fresh")))
    none = F.array().cast(_CUTS)
    return F.coalesce(F.when(text.isNull() | (inner == 0), none).when(inner <= limit, one).otherwise(long_cuts(F.when(inner > limit, text))), none)


def pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(table_name, row_id, ord, start, end, overlap, text)`` of ``texts(table_name, row_id, text)``, ``ord`` from 0.

    Every input row is cut on its own: repeated rows give repeated pieces, ties cannot arise.
    Other columns are dropped, whatever their names.
    """
    made = texts.select("table_name", "row_id", "text").withColumn("_c", cuts(F.col("text"), limit, overlap))
    rows = made.select("table_name", "row_id", "text", F.posexplode("_c").alias("ord", "p"))
    return rows.select(
        "table_name", "row_id", "ord", F.col("p.start").alias("start"), F.col("p.end").alias("end"), (F.col("p.fresh") - F.col("p.start")).alias("overlap"),
        F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("text"),
    )
