"""Per-key work where a few keys hold most rows.

Heavy keys are found with a mergeable weighted counter sketch, then treated
apart: rows of a heavy key stay in their partitions and meet the few matching
rows of the other side by broadcast, all others go through an ordinary shuffle,
and the two results are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kithspark.session import BROADCAST_ROWS

#: Counters of a sketch. A key's weight is underestimated by at most total / COUNTERS.
COUNTERS = 512


def _shrink(counts: pd.Series, counters: int) -> pd.Series:
    """Keep at most ``counters`` of the counters, taking the next largest from each."""
    if len(counts) <= counters:
        return counts
    cut = counts.nlargest(counters + 1).iloc[-1]
    counts = counts - cut
    return counts[counts > 0]


def heavy_hitters(df: DataFrame, key: str, share: float, weight: str | None = None) -> DataFrame:
    """Keys with at least ``share`` of the total weight: (key bigint, weight double, total double).

    ``weight`` is a numeric column, 1 for each row by default. Rows with a null
    key, or with a null, NaN or non-positive weight, don't count. One pass makes
    a sketch of ``COUNTERS`` counters for each partition; candidates are the keys
    whose sketched weight could reach the share, at most 1 / (share - 1 /
    COUNTERS) of them, so they can be broadcast; a second pass weighs them
    exactly. An empty table gives no row; a key exactly at the share counts.
    """
    if not 2 / COUNTERS <= share <= 1:
        raise ValueError(f"share must be within {2 / COUNTERS} and 1")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(key).cast("bigint").alias("key"), w.alias("w")).where("key is not null and w > 0 and w < double('infinity')")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, total = pd.Series(dtype="float64"), 0.0
        for b in batches:
            total += b.w.sum()
            kept = _shrink(kept.add(b.groupby("key").w.sum(), fill_value=0.0), COUNTERS)
        yield pd.DataFrame({"key": pd.Series(kept.index, dtype="Int64"), "w": kept.to_numpy(), "total": 0.0})
        yield pd.DataFrame({"key": pd.Series([None], dtype="Int64"), "w": [0.0], "total": [total]})

    sums = rows.mapInPandas(sketch, "key bigint, w double, total double").groupBy("key").agg(F.sum("w").alias("w"), F.sum("total").alias("total"))
    few = sums.orderBy(F.col("key").isNotNull(), F.desc("w")).limit(COUNTERS + 1).toPandas()
    total = float(few.total.sum()) if len(few) else 0.0
    chosen = few[few.key.notna() & (few.w >= (share - 1 / COUNTERS) * total)]
    spark = df.sparkSession
    names = spark.createDataFrame([(int(k),) for k in chosen.key], "key bigint")
    exact = rows.join(F.broadcast(names), "key").groupBy("key").agg(F.sum("w").alias("weight"))
    return exact.withColumn("total", F.lit(total)).where(F.col("weight") >= F.lit(share) * F.col("total"))


def heavy_keys(df: DataFrame, key: str, share: float) -> list[int]:
    """The heavy keys themselves; at most 1 / share of them."""
    return [r.key for r in heavy_hitters(df, key, share).select("key").collect()]


def skew_join(big: DataFrame, other: DataFrame, key: str, share: float = 0.01, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join ``big`` with ``other`` on the integer column ``key`` without a hot task.

    ``how`` is inner or left. Rows of ``big`` with a heavy key are joined in place
    with the matching rows of ``other``, which are broadcast if they are at most
    BROADCAST_ROWS (they are counted); if they are more, heavy rows of ``big`` are
    spread over ``salts`` and those of ``other`` copied to each salt. Other rows
    go through a shuffled join. Null keys match nothing. Columns of ``other`` with
    a name that ``big`` has too get the suffix ``_other``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    taken = {c.lower() for c in big.columns}
    right = other.select(F.col(key).alias("__k"), *[F.col(c).alias(c if c.lower() not in taken else f"{c}_other") for c in other.columns if c != key])
    heavy = heavy_keys(big, key, share)
    on = F.col(key) == F.col("__k")
    if not heavy:
        return big.join(right, on, how).drop("__k")
    is_heavy: Column = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    hot = right.where(F.col("__k").isin(heavy))
    light = big.where(~is_heavy).join(right.where(~F.col("__k").isin(heavy)), on, how)
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        apart = big.where(is_heavy).join(F.broadcast(hot), on, how)
    else:
        # By a hash of the row, so that a task that is tried again salts it as before.
        left = big.where(is_heavy).withColumn("__s", F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(big.columns)]))), F.lit(salts)).cast("int"))
        copies = hot.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        apart = left.join(copies, on & (F.col("__s") == F.col("__t")), how).drop("__s", "__t")
    return apart.unionByName(light).drop("__k")


def skew_group(df: DataFrame, key: str, value: str, share: float = 0.01) -> DataFrame:
    """Per-key ``rows``, ``distinct_values`` of ``value``: exact, without a hot task.

    A distinct count can't be reduced to a number before the shuffle, so a heavy
    key's values are spread over tasks by (key, value) and counted in two steps;
    other keys are counted in one. Null values count as rows but not as values;
    rows with a null key form a group of their own.
    """
    heavy = heavy_keys(df, key, share)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    light = df.where(~is_heavy).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(value).alias("distinct_values"))
    if not heavy:
        return light
    by_value = df.where(is_heavy).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    apart = by_value.groupBy(key).agg(F.sum("n").alias("rows"), F.count(value).alias("distinct_values"))
    return light.unionByName(apart)


SCHEMA_FOUND = T.StructType([T.StructField("key_field", T.StringType()), T.StructField("key_value", T.LongType())])


def found_heavy(faces: DataFrame, persons: DataFrame, share: float = 0.04) -> DataFrame:
    """(key_field, key_value) of heavy clusters by faces and heavy persons by faces_seen.

    ``faces`` holds each face once; cluster ids below 0 and null don't count.
    """
    clusters = heavy_hitters(faces.where("cluster_id >= 0"), "cluster_id", share)
    people = heavy_hitters(persons, "person_id", share, "faces_seen")
    tag = lambda df, name: df.select(F.lit(name).alias("key_field"), F.col("key").alias("key_value"))
    return tag(clusters, "cluster_id").unionByName(tag(people, "person_id"))
