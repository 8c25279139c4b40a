"""Queries over who is in which photo, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithspark.operators import relations as rel, views
from kithspark.plans.registry import Registry, table

R = Registry()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAMES = ["Supplier#000000001", " SUPPLIER#000000002 ", "supplier#000000002", ""]
PHOTO = "photo_1"


def key_sql(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


OCC = f"""occ AS (
  SELECT s_name AS person_name, {key_sql('s_name')} AS k, 'photo_' || l_orderkey AS image_path, count(*) AS faces, max(l_shipdate) AS seen_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""

#: face_occurrences within libraries, one row for each name and photo.
FOCC = f"""focc AS (
  SELECT library_id, {key_sql('person_name')} AS k, min(person_name) AS person_name, image_path, CAST(sum(coalesce(faces, 1)) AS BIGINT) AS faces, timezone('UTC', max(seen_at)) AS seen_at
  FROM face_occurrences WHERE trim(person_name) <> '' AND trim(image_path) <> '' GROUP BY library_id, k, image_path)"""


def occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as people, orders as photos, their lines as faces."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate")
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    # The name is part of the key, so a filter on it reaches the names and thins out the lines before they are shuffled.
    counts = lines.join(names, "l_suppkey").groupBy("l_suppkey", "s_name", "l_orderkey").agg(F.count(F.lit(1)).alias("faces"), F.max("l_shipdate").alias("seen_at"))
    return counts.select(F.col("s_name").alias("person_name"), F.concat(F.lit("photo_"), F.col("l_orderkey").cast("string")).alias("image_path"), "faces", "seen_at")


def by_library(spark: SparkSession, folder: str) -> DataFrame:
    return rel.record(None, table(spark, folder, "face_occurrences").select("library_id", "person_name", "image_path", "faces", "seen_at"), ["library_id"])


@R.add("r1_people_list", f"WITH {OCC} SELECT min(person_name) AS person_name, count(*) AS photos, CAST(sum(faces) AS BIGINT) AS faces, max(seen_at) AS last_seen FROM occ GROUP BY k")
def r1(spark, folder):
    return rel.people(occurrences(spark, folder))


@R.add("r1_people_by_library", f"WITH {FOCC} SELECT library_id, min(person_name) AS person_name, count(*) AS photos, CAST(sum(faces) AS BIGINT) AS faces, max(seen_at) AS last_seen FROM focc GROUP BY library_id, k")
def r1_library(spark, folder):
    return rel.people(by_library(spark, folder), ["library_id"])


@R.add("r2_photos_of_person", f"WITH {OCC} SELECT DISTINCT image_path FROM occ WHERE k = 'supplier#000000001'")
def r2(spark, folder):
    return rel.photos_of(occurrences(spark, folder), "SUPPLIER#000000001")


@R.add("o3_photos_of_person_limit", f"WITH {OCC} SELECT DISTINCT image_path FROM occ WHERE k = 'supplier#000000001' ORDER BY image_path LIMIT 5")
def o3(spark, folder):
    return rel.photos_of(occurrences(spark, folder), "supplier#000000001", 5)


@R.add("r3_people_in_photo", f"WITH {OCC} SELECT min(person_name) AS person_name FROM occ WHERE image_path = '{PHOTO}' GROUP BY k")
def r3(spark, folder):
    return rel.people_in(occurrences(spark, folder), PHOTO)


@R.add("r4_intersection", f"WITH {OCC} SELECT image_path FROM occ WHERE k IN ('supplier#000000001', 'supplier#000000002') GROUP BY image_path HAVING count(DISTINCT k) = 2")
def r4(spark, folder):
    """Photos of two people; case, blanks and repeated names in the request don't matter."""
    return rel.intersection(occurrences(spark, folder), NAMES)


@R.add("r4_intersection_unknown", f"WITH {OCC} SELECT image_path FROM occ WHERE k IN ('supplier#000000001', 'ghost') GROUP BY image_path HAVING count(DISTINCT k) = 2")
def r4_unknown(spark, folder):
    return rel.intersection(occurrences(spark, folder), ["Supplier#000000001", "ghost"])


@R.add("r4_intersections_of_requests", f"""
WITH {FOCC},
want AS (SELECT DISTINCT cluster_id AS request_id, library_id, {key_sql('name')} AS k FROM name_requests WHERE cluster_id IS NOT NULL AND trim(name) <> ''),
size AS (SELECT request_id, library_id, count(*) AS n FROM want GROUP BY ALL)
SELECT w.request_id, w.library_id, f.image_path FROM want w JOIN focc f USING (library_id, k) JOIN size s USING (request_id, library_id)
GROUP BY w.request_id, w.library_id, f.image_path, s.n HAVING count(*) = s.n""")
def r4_requests(spark, folder):
    """For each cluster, the photos of its library that hold everybody it was named."""
    asked = table(spark, folder, "name_requests").where("cluster_id is not null").select(F.col("cluster_id").alias("request_id"), "library_id", F.col("name").alias("person_name"))
    return rel.intersections(by_library(spark, folder), asked, ["library_id"])


@R.add("r5_resolve_names", f"""
WITH {OCC}, asked(position, requested, k) AS (VALUES (0, 'SUPPLIER#000000003', 'supplier#000000003'), (1, 'supplier#00000000', 'supplier#00000000'), (2, 'ghost', 'ghost'))
SELECT a.position, a.requested, (SELECT arg_min(o.person_name, (o.k <> a.k, o.person_name)) FROM occ o WHERE starts_with(o.k, a.k)) AS person_name FROM asked a""")
def r5(spark, folder):
    return rel.resolve(occurrences(spark, folder), ["SUPPLIER#000000003", "supplier#00000000", "ghost", "Ghost"])


@R.add("r6_intersection_summary", f"""
WITH {OCC}, h AS (SELECT image_path, count(*) AS n FROM occ WHERE k IN ('supplier#000000001', 'supplier#000000002') GROUP BY 1)
SELECT count(*) FILTER (n = 2) AS count, CAST(sum(n) AS BIGINT) AS total FROM h""")
def r6(spark, folder):
    """Unknown names are set aside; the matched ones give the count and the sum of their photos."""
    return rel.intersection_summary(occurrences(spark, folder), [*NAMES, "ghost"])


@R.add("r7_known_names", f"WITH {OCC} SELECT min(person_name) AS person_name FROM occ GROUP BY k")
def r7(spark, folder):
    return rel.known_names(occurrences(spark, folder))


PAIRS = "SELECT min(a.person_name) AS person_a, min(b.person_name) AS person_b, count(*) AS photos FROM occ a JOIN occ b ON a.image_path = b.image_path AND a.k < b.k GROUP BY a.k, b.k"


@R.add("r8_co_occurrence", f"WITH {OCC} {PAIRS}")
def r8(spark, folder):
    return rel.co_occurrence(occurrences(spark, folder))


@R.add("r8_co_occurrence_by_library", f"""
WITH {FOCC}, n AS (SELECT library_id, k, min(person_name) AS person_name FROM focc GROUP BY ALL)
SELECT a.library_id, x.person_name AS person_a, y.person_name AS person_b, count(*) AS photos
FROM focc a JOIN focc b ON a.library_id = b.library_id AND a.image_path = b.image_path AND a.k < b.k
JOIN n x ON x.library_id = a.library_id AND x.k = a.k JOIN n y ON y.library_id = b.library_id AND y.k = b.k GROUP BY ALL""")
def r8_library(spark, folder):
    return rel.co_occurrence(by_library(spark, folder), ["library_id"])


@R.add("r6_per_person", f"WITH {OCC} SELECT min(person_name) AS person_name, count(*) AS photos FROM occ WHERE k IN ('supplier#000000001', 'supplier#000000002') GROUP BY k")
def r6_per_person(spark, folder):
    """The matched names of the same request, each with its number of photos."""
    return rel.intersection_per_person(occurrences(spark, folder), [*NAMES, "ghost"])


@R.add("r9_matrix", f"""
WITH {OCC}, n AS (SELECT min(person_name) AS person_name, k, row_number() OVER (ORDER BY k) - 1 AS at FROM occ GROUP BY k),
p AS (SELECT a.k AS ka, b.k AS kb, count(*) AS photos FROM occ a JOIN occ b ON a.image_path = b.image_path AND a.k < b.k GROUP BY ALL)
SELECT x.at AS i, y.at AS j, x.person_name AS person_a, y.person_name AS person_b, photos FROM p JOIN n x ON x.k = ka JOIN n y ON y.k = kb""")
def r9(spark, folder):
    """Every entry of the matrix of pairs with its places on the axis."""
    return rel.matrix(occurrences(spark, folder))


@R.add("r9_axis", f"WITH {OCC} SELECT min(person_name) AS person_name, row_number() OVER (ORDER BY k) - 1 AS position FROM occ GROUP BY k")
def r9_axis(spark, folder):
    return rel.axis(occurrences(spark, folder)).select("person_name", "position")


@R.add("r9_totals", f"WITH {OCC}, p AS ({PAIRS}) SELECT count(*) AS pairs, coalesce(max(photos), 0) AS most, (SELECT count(DISTINCT k) FROM occ) AS names FROM p")
def r9_totals(spark, folder):
    """The size of the matrix of pairs, its largest entry and its axis."""
    occ = occurrences(spark, folder)
    pairs = rel.co_occurrence(occ).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.max("photos"), F.lit(0)).alias("most"))
    return pairs.join(F.broadcast(rel.known_names(occ).agg(F.count(F.lit(1)).alias("names"))))


@R.add("v5_top_pairs", f"""
WITH {OCC}, p AS ({PAIRS})
SELECT person_a, person_b, photos, greatest(8.0, round(photos / (SELECT max(photos) FROM p) * 100, 1)) AS weight
FROM p ORDER BY photos DESC, {key_sql('person_a')}, {key_sql('person_b')} LIMIT 24""")
def v5(spark, folder):
    return rel.ranked_pairs(rel.co_occurrence(occurrences(spark, folder)), 24)


@R.add("r10_gallery_selection", f"WITH {OCC} SELECT min(person_name) OVER (PARTITION BY k) AS person_name, image_path FROM occ")
def r10(spark, folder):
    return rel.gallery_selection(occurrences(spark, folder))


@R.add("r10_gallery_selection_named", f"WITH {OCC} SELECT person_name, image_path FROM occ WHERE k IN ('supplier#000000001', 'supplier#000000002')")
def r10_named(spark, folder):
    return rel.gallery_selection(occurrences(spark, folder), NAMES)


@R.add("r11_merge_people", f"""
WITH {OCC}, m AS (SELECT CASE WHEN k = 'supplier#000000002' THEN 'Supplier#000000001' ELSE person_name END AS person_name, image_path, faces, seen_at FROM occ)
SELECT person_name, image_path, CAST(sum(faces) AS BIGINT) AS faces, max(seen_at) AS seen_at FROM m GROUP BY ALL""")
def r11(spark, folder):
    return rel.merged(occurrences(spark, folder), "SUPPLIER#000000001", "supplier#000000002")


@R.add("k6_record_occurrences", f"WITH {FOCC} SELECT library_id, person_name, image_path, faces, seen_at FROM focc")
def k6(spark, folder):
    """Raw rows, repeated and in several cases, as one row for each name and photo of a library."""
    return by_library(spark, folder)


@R.add("k6_record_second_batch", f"WITH {FOCC} SELECT library_id, person_name, image_path, CAST(2 * faces AS BIGINT) AS faces, seen_at FROM focc")
def k6_again(spark, folder):
    """The same batch recorded twice adds up."""
    raw = table(spark, folder, "face_occurrences").select("library_id", "person_name", "image_path", "faces", "seen_at")
    return rel.record(by_library(spark, folder), raw, ["library_id"])


@R.add("k7_forget_person", f"WITH {OCC} SELECT person_name, image_path, faces, seen_at FROM occ WHERE k <> 'supplier#000000001'")
def k7(spark, folder):
    return rel.forget(occurrences(spark, folder), "SUPPLIER#000000001")


@R.add("v1_people_filter", f"WITH {OCC} SELECT person_name, count(*) AS photos FROM occ WHERE contains(lower(person_name), '#00000000') GROUP BY ALL")
def v1(spark, folder):
    return views.containing(rel.people(occurrences(spark, folder)), "person_name", " #00000000 ").select("person_name", "photos")


@R.add("v2_people_by_photos", f"WITH {OCC} SELECT person_name, count(*) AS photos FROM occ GROUP BY ALL ORDER BY photos DESC, person_name")
def v2(spark, folder):
    return views.by_photos(rel.people(occurrences(spark, folder)).select("person_name", "photos"))


@R.add("v6_photo_grid", f"WITH {OCC} SELECT DISTINCT image_path FROM occ ORDER BY image_path LIMIT 400")
def v6(spark, folder):
    return views.capped(occurrences(spark, folder).select("image_path").distinct(), ["image_path"], 400)[0]


@R.add("v10_recent_activity", "SELECT occurrence_id, timezone('UTC', seen_at) AS seen_at FROM face_occurrences ORDER BY face_occurrences.seen_at DESC NULLS LAST, occurrence_id LIMIT 24")
def v10(spark, folder):
    return views.most_recent(table(spark, folder, "face_occurrences").select("occurrence_id", "seen_at"), "seen_at", 24, ["occurrence_id"])


@R.add("v12_person_by_name", f"WITH {OCC} SELECT DISTINCT person_name FROM occ WHERE lower(person_name) = 'supplier#000000007'")
def v12(spark, folder):
    return rel.known_names(occurrences(spark, folder)).where(F.lower("person_name") == "supplier#000000007")


@R.add("w4_previous_and_next_photo", f"""
WITH {FOCC}, g AS (SELECT library_id || '/' || k AS person, image_path FROM focc)
SELECT person, image_path, row_number() OVER w AS position,
  coalesce(lag(image_path) OVER w, last_value(image_path) OVER a) AS previous,
  coalesce(lead(image_path) OVER w, first_value(image_path) OVER a) AS following
FROM g WINDOW w AS (PARTITION BY person ORDER BY image_path), a AS (PARTITION BY person ORDER BY image_path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def w4(spark, folder):
    """Every photo of a person with its neighbours; the first follows the last."""
    from kithspark.functions.text import name_key

    rows = by_library(spark, folder).select(F.concat_ws("/", "library_id", name_key(F.col("person_name"))).alias("person"), "image_path")
    return rel.neighbours_in_order(rows, "person", [F.col("image_path")], "image_path")


@R.add("k10_people_payload", f"WITH {FOCC} SELECT library_id, min(person_name) AS person_name, count(*) AS photos FROM focc GROUP BY library_id, k")
def k10(spark, folder):
    """People as JSON and read back."""
    rows = rel.people(by_library(spark, folder), ["library_id"]).select("library_id", "person_name", "photos")
    return views.payload(rows).select(F.from_json("payload", "library_id int, person_name string, photos bigint").alias("p")).select("p.*")
