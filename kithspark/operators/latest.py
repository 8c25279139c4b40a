"""Latest delivery of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kithspark.session import BROADCAST_ROWS


def latest_rows(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row for each ``key``: the values of ``columns`` in its latest row by ``at``.

    Meant for narrow columns: the rows are reduced before the shuffle, so a key
    with many deliveries is no hot spot. A null key gives no row. A null ``at``
    comes before any time. Rows with the same ``at`` that differ are ordered by
    the columns themselves, so the result doesn't depend on the partitioning.
    """
    picked = F.max(F.struct(F.col(at).alias("at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("top")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, *[F.col(f"top.c{i}").alias(c) for i, c in enumerate(columns)])


def latest_wide(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """As ``latest_rows``, for wide columns such as vectors of which few keys repeat.

    Only keys are shuffled to find those delivered more than once. While they are
    few enough to broadcast (they are counted), rows of other keys stay where they
    are; otherwise every row is shuffled.
    """
    df = df.where(F.col(key).isNotNull())
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if not few:
        return latest_rows(df, key, at, columns)
    once = df.join(F.broadcast(again), key, "left_anti").select(key, *columns)
    return once.unionByName(latest_rows(df.join(F.broadcast(again), key, "left_semi"), key, at, columns))
