"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

HOT_KEYS = 1000
HOT_ROWS = 100_000  # a key with fewer rows of a few numbers each is no problem for one task


def hot_keys(df: DataFrame, key: str, most: int = HOT_KEYS, least: int = HOT_ROWS) -> list:
    """The keys with at least ``least`` rows and one row in ``most`` of all, largest first.

    No more than ``most`` keys can hold that share, so the list is whole, and what the driver
    receives does not grow. Counts are pre-aggregated in each task.
    """
    seen = Observation()
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).observe(seen, F.sum("_n").alias("total"))
    top = counts.filter(F.col("_n") >= least).orderBy(F.desc("_n"), key).limit(most).collect()
    return [r[0] for r in top if r[1] * most >= (seen.get["total"] or 0)] if top else []


def hot_key_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join ``many`` rows to ``one`` (unique on ``key``); the hot keys of ``many`` never shuffle.

    The rows of ``one`` for hot keys number at most ``HOT_KEYS`` and are broadcast; all
    other keys (each less than one row in ``HOT_KEYS``, or few rows) are hashed. Null keys match nothing and stay only in a left join.
    ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    hot = hot_keys(many, key) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = many.filter(~is_hot).join(one, key, how)
    warm = many.filter(is_hot).join(F.broadcast(one.filter(F.col(key).isin(hot))), key, how)
    return cold.unionByName(warm)
