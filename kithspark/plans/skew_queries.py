"""Queries of the operators for keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithspark.operators.latest import latest_rows
from kithspark.operators.skew import found_heavy, skew_group, skew_join
from kithspark.plans.registry import Registry, table

R = Registry()

#: Each face once, by its latest row; rows of the same time are ordered as in ``latest_rows``.
LATEST_SQL = """latest AS (
  SELECT face_id, arg_max(r, r) AS r FROM (
    SELECT face_id, {{'at': arrived_at, {fields}}} AS r FROM face_records WHERE face_id IS NOT NULL)
  GROUP BY face_id)"""


@R.add("p2_found", f"""
WITH {LATEST_SQL.format(fields="'c': cluster_id")},
f AS (SELECT r.c AS c FROM latest WHERE r.c >= 0),
a AS (SELECT c, count(*) AS n FROM f GROUP BY c),
p AS (SELECT person_id, sum(faces_seen) AS n FROM persons WHERE faces_seen > 0 AND person_id IS NOT NULL GROUP BY person_id)
SELECT 'cluster_id' AS key_field, CAST(c AS BIGINT) AS key_value FROM a WHERE n >= 0.04 * (SELECT count(*) FROM f)
UNION ALL
SELECT 'person_id', CAST(person_id AS BIGINT) FROM p WHERE n >= 0.04 * (SELECT sum(n) FROM p)""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and persons that hold at least 4 % of all faces."""
    faces = latest_rows(table(spark, folder, "face_records"), "face_id", "arrived_at", ["cluster_id"])
    return found_heavy(faces, table(spark, folder, "persons"))


@R.add("p2_cluster_totals", f"""
WITH {LATEST_SQL.format(fields="'c': cluster_id, 'p': image_path")}
SELECT r.c AS cluster_id, count(*) AS faces, count(DISTINCT r.p) AS photos FROM latest GROUP BY r.c""")
def p2_cluster_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Faces and distinct photos of every cluster_id, null and -1 included."""
    faces = latest_rows(table(spark, folder, "face_records"), "face_id", "arrived_at", ["cluster_id", "image_path"])
    return skew_group(faces, "cluster_id", "image_path").select("cluster_id", F.col("rows").alias("faces"), F.col("distinct_values").alias("photos"))


@R.add("p2_faces_by_build", f"""
WITH {LATEST_SQL.format(fields="'c': cluster_id")},
b AS (SELECT cluster_id, count(*) AS builds FROM face_clusters GROUP BY cluster_id)
SELECT l.face_id, CAST(l.r.c AS BIGINT) AS cluster_id, b.builds FROM latest l LEFT JOIN b ON l.r.c = b.cluster_id""")
def p2_faces_by_build(spark: SparkSession, folder: str) -> DataFrame:
    """Every face with how many scans stored its cluster_id as a group; null if none did."""
    faces = latest_rows(table(spark, folder, "face_records"), "face_id", "arrived_at", ["cluster_id"])
    builds = table(spark, folder, "face_clusters").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("builds"))
    joined = skew_join(faces, builds, "cluster_id", how="left")
    return joined.select("face_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), "builds")
