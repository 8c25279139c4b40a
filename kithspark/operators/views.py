"""What a person looks at: filtered, sorted and shortened lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def containing(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose text contains the query, without regard to case; all for a blank query."""
    q = (query or "").strip().lower()
    return rows.where(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(q))) if q else rows


def by_photos(rows: DataFrame, name: str = "person_name") -> DataFrame:
    return rows.orderBy(F.desc("photos"), name)


def clusters_matching(clusters: DataFrame, query: str) -> DataFrame:
    """Clusters (cluster_id, name, ...) whose name, or 'group' and number from 1, contains the query."""
    q = (query or "").strip().lower()
    shown = F.concat(F.lit("group "), (F.col("cluster_id") + 1).cast("string"))
    return clusters.where(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(q)) | F.contains(shown, F.lit(q))) if q else clusters


def cluster_order(by: str) -> list[Column]:
    """Order of clusters by size, photos or name; unnamed ones sort under ~ and their id."""
    if by not in ("size", "photos", "name"):
        raise ValueError("by must be size, photos or name")
    named = F.coalesce("name", F.concat(F.lit("~"), F.col("cluster_id").cast("string")))
    return [named if by == "name" else F.desc(by), F.col("cluster_id")]


def most_recent(rows: DataFrame, at: str, n: int, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """The ``n`` latest rows; null times come last."""
    return rows.orderBy(F.desc_nulls_last(at), *ties).limit(n)


def capped(rows: DataFrame, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` rows, one row with the total)."""
    return rows.orderBy(*order).limit(n), rows.agg(F.count(F.lit(1)).alias("total"))


def named_and_not(clusters: DataFrame) -> DataFrame:
    """One row: clusters, those with a name, those without, and the sum of their photos."""
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), F.count("name").alias("named"), (F.count(F.lit(1)) - F.count("name")).alias("unnamed"), F.coalesce(F.sum("photos"), F.lit(0)).alias("photos"))


def payload(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object in ``payload``."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("payload"))
