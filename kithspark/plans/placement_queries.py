"""Queries over placement, names, paths, values to show, images and updates, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithspark.functions import text as tx
from kithspark.operators import identity, placement as plc, views
from kithspark.operators.latest import latest_rows, latest_wide
from kithspark.plans.registry import Registry, table
from kithspark.plans.relation_queries import FOCC, OCC, UPPER, by_library, key_sql, occurrences
from kithspark.schemas import DEVICE_NAMES
from kithspark.sources import images as img

R = Registry()

_DEVICES = ", ".join(f"'{d}'" for d in DEVICE_NAMES)
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
_ILLEGAL = r"""'[<>:"/\\|?*\x00-\x1f]'"""


def folder_sql(x: str) -> str:
    """Of a name that has no outer white space any more, the folder."""
    cut = f"rtrim(substr(regexp_replace({x}, {_ILLEGAL}, '_', 'g'), 1, 64), '. ')"
    return f"CASE WHEN {x} IS NULL OR lower({x}) IN ('', 'skip', 'unknown') OR {cut} = '' THEN NULL WHEN upper({cut}) IN ({_DEVICES}) THEN '_' || {cut} ELSE {cut} END"


_REQ = f"""req AS (SELECT request_id, arg_max(r, r) AS r FROM (SELECT request_id, {{'at': arrived_at, 'lib': library_id, 'c': cluster_id, 'name': name}} AS r FROM name_requests WHERE request_id IS NOT NULL) GROUP BY 1),
q AS (SELECT request_id, r.lib AS library_id, r.c AS cluster_id, r.name AS name, trim(r.name, {_BLANK}) AS s FROM req)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each request once, by its latest row."""
    return latest_rows(table(spark, folder, "name_requests"), "request_id", "arrived_at", ["library_id", "cluster_id", "name"])


@R.add("g2_folder_names", f"WITH {_REQ} SELECT request_id, {folder_sql('s')} AS folder FROM q")
def g2(spark, folder):
    """The folder of every typed name, null where it names nobody."""
    return requests(spark, folder).select("request_id", tx.folder_name(F.col("name")).alias("folder"))


@R.add("g3_gallery_names", f"""
WITH {_REQ}, c AS (SELECT request_id, rtrim(regexp_replace(coalesce(s, ''), {_ILLEGAL}, '_', 'g'), '. ') AS c FROM q),
n AS (SELECT request_id, CASE WHEN regexp_full_match(c, '[. ]*') THEN 'unnamed' ELSE c END AS n FROM c)
SELECT request_id, substr(CASE WHEN upper(n) IN ({_DEVICES}) THEN n || '_' ELSE n END, 1, 80) AS folder FROM n""")
def g3(spark, folder):
    return requests(spark, folder).select("request_id", tx.gallery_name(F.col("name")).alias("folder"))


@R.add("g3_gallery_folders", f"""
WITH p AS (SELECT DISTINCT person_name, trim(coalesce(person_name, ''), {_BLANK}) AS s FROM persons), c AS (SELECT person_name, rtrim(regexp_replace(s, {_ILLEGAL}, '_', 'g'), '. ') AS c FROM p),
n AS (SELECT person_name, CASE WHEN regexp_full_match(c, '[. ]*') THEN 'unnamed' ELSE c END AS n FROM c),
b AS (SELECT person_name, substr(CASE WHEN upper(n) IN ({_DEVICES}) THEN n || '_' ELSE n END, 1, 80) AS base FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY person_name NULLS FIRST) AS nth FROM b)
SELECT person_name, CASE WHEN nth = 1 THEN base ELSE substr(base, 1, 76) || ' (' || nth || ')' END AS folder FROM r""")
def g3_folders(spark, folder):
    """The folder of every person's name; names with the same one are told apart by a number."""
    return plc.gallery_folders(table(spark, folder, "persons"))


@R.add("i8_named_clusters", f"""
WITH {_REQ}, t AS (SELECT library_id, cluster_id, arg_max(name, request_id) AS typed, trim(arg_max(name, request_id), {_BLANK}) AS s FROM q WHERE cluster_id IS NOT NULL AND name IS NOT NULL GROUP BY ALL)
SELECT library_id, cluster_id, {folder_sql('s')} AS name FROM t""")
def i8(spark, folder):
    """The cleaned name of each cluster that was named, by its last request."""
    asked = requests(spark, folder).where("cluster_id is not null and name is not null").groupBy("library_id", "cluster_id").agg(F.max_by("name", "request_id").alias("typed"))
    # Ids mean something within a library, so both make the key.
    key = F.struct("library_id", "cluster_id").alias("cluster_id")
    labels = asked.select(key, F.lit(None).cast("string").alias("name"))
    return identity.named_clusters(labels, asked.select(key, "typed")).select("cluster_id.library_id", "cluster_id.cluster_id", "name")


_PLACE = f"""placed AS (SELECT DISTINCT library_id, image_path, coalesce({folder_sql('person_name')}, '_unknown') AS folder, regexp_extract(image_path, '([^/]*)$', 1) AS name FROM focc),
shape AS (SELECT *, regexp_extract(name, '(\\.[^.]+)$', 1) AS ext FROM placed),
num AS (SELECT *, name[1:len(name) - len(ext)] AS stem, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY image_path) - 1 AS i FROM shape),
man AS (SELECT image_path AS source, folder, CASE WHEN i = 0 THEN name ELSE stem || '_' || i || ext END AS target FROM num)"""


def _assigned(spark, folder):
    return by_library(spark, folder).select(F.trim("person_name").alias("person_name"), "image_path")


_MANIFEST = f"WITH {FOCC.replace('min(person_name) AS person_name', 'trim(min(person_name)) AS person_name')}, {_PLACE}"


@R.add("k1_placement_manifest", f"{_MANIFEST} SELECT source, folder, target FROM man")
def k1(spark, folder):
    """Every photo once in the folder of each of its people, under a free name."""
    return plc.organized(_assigned(spark, folder), [])


@R.add("g1_free_names", f"{_MANIFEST} SELECT folder, lower(target) AS target, count(*) AS n FROM man GROUP BY ALL")
def g1(spark, folder):
    """No name is given twice in a folder."""
    return plc.organized(_assigned(spark, folder), []).groupBy("folder", F.lower("target").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@R.add("a10_placement_totals", f"{_MANIFEST} SELECT count(DISTINCT folder) AS folders, count(DISTINCT source) AS files_placed, count(*) AS copies_written FROM man")
def a10(spark, folder):
    return plc.organize_totals(plc.organized(_assigned(spark, folder), []))


@R.add("v8_folder_counts", f"{_MANIFEST} SELECT folder, count(*) AS photos FROM man GROUP BY 1")
def v8(spark, folder):
    return plc.folder_counts(plc.organized(_assigned(spark, folder), []))


@R.add("t3_folders_of_photos", f"{_MANIFEST} SELECT source, count(DISTINCT folder) AS folders FROM man GROUP BY 1")
def t3(spark, folder):
    return plc.organized(_assigned(spark, folder), []).groupBy("source").agg(F.count_distinct("folder").alias("folders"))


@R.add("w3_suffixes", f"{_MANIFEST} SELECT i AS place, count(*) AS photos FROM num GROUP BY 1")
def w3(spark, folder):
    """How many photos got each number in their folder."""
    m = plc.organized(_assigned(spark, folder), [])
    given = m.select(tx.stem(tx.basename(F.col("source"))).alias("own"), tx.stem(F.col("target")).alias("new"))
    place = F.when(F.col("own") == F.col("new"), F.lit(0)).otherwise(F.regexp_extract("new", r"_(\d+)$", 1).cast("int"))
    return given.groupBy(place.cast("bigint").alias("place")).agg(F.count(F.lit(1)).alias("photos"))


@R.add("k2_intersection_export", f"""
WITH {OCC}, h AS (SELECT image_path FROM occ WHERE k IN ('supplier#000000001', 'supplier#000000002') GROUP BY 1 HAVING count(DISTINCT k) = 2)
SELECT '/scan/' || image_path AS source, image_path AS target FROM h""")
def k2(spark, folder):
    """The photos of two people, with the name each gets in the folder of the export."""
    from kithspark.operators.relations import intersection

    return plc.intersection_manifest(intersection(occurrences(spark, folder), ["Supplier#000000001", "Supplier#000000002"]), root="/scan/")


_GAL = f"""WITH {FOCC}, p AS (SELECT library_id || ' ' || k AS person_name, image_path FROM focc), s AS (
  SELECT person_name, image_path, i.status FROM p LEFT JOIN images i USING (image_path))"""


def _gallery(spark, folder):
    """Galleries of all people; images that are readable count as files that exist."""
    rows = by_library(spark, folder).select(F.concat_ws(" ", "library_id", tx.name_key(F.col("person_name"))).alias("person_name"), "image_path")
    return plc.gallery(rows, table(spark, folder, "images").select(F.col("image_path").alias("path"), (F.length("image_path") * 1000).cast("bigint").alias("bytes")))


@R.add("k3_gallery_people", _GAL + """ , g AS (SELECT person_name, count(*) AS photos, min(image_path) AS cover FROM s WHERE status IS NOT NULL GROUP BY 1)
SELECT person_name, person_name AS folder, photos, regexp_replace(regexp_extract(cover, '([^/]*)$', 1), '\\.[^.]+$', '') || '.jpg' AS cover FROM g""")
def k3(spark, folder):
    """Each person in the gallery with the folder, the number of photos shown and the first one."""
    return plc.gallery_people(_gallery(spark, folder)).select("person_name", "folder", "photos", "cover")


@R.add("a12_gallery_totals", _GAL + " SELECT count(status) AS photos, count(DISTINCT CASE WHEN status IS NOT NULL THEN person_name END) AS people, 0 AS skipped, count(*) FILTER (status IS NULL) AS missing, CAST(coalesce(sum(CASE WHEN status IS NOT NULL THEN length(image_path) * 1000 END), 0) AS BIGINT) AS bytes FROM s")
def a12(spark, folder):
    return plc.gallery_totals(_gallery(spark, folder))


@R.add("g4_sha256", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def g4(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.sha256_hex(F.col("text")).alias("digest"))


@R.add("g5_resolved_paths", "SELECT image_path, CASE WHEN starts_with(image_path, '/') THEN image_path ELSE '/root/scan/' || image_path END AS resolved FROM images UNION ALL SELECT 'x' || image_path, '/root/scan/x' || image_path FROM images")
def g5(spark, folder):
    i = table(spark, folder, "images").select("image_path")
    both = i.unionByName(i.select(F.concat(F.lit("x"), "image_path").alias("image_path")))
    return both.select("image_path", tx.resolved_path(F.col("image_path"), F.lit("/root/scan/")).alias("resolved"))


@R.add("g6_path_parts", r"""
WITH b AS (SELECT image_path, regexp_extract(image_path, '([^/\\]*)$', 1) AS basename FROM images), s AS (SELECT *, regexp_extract(basename, '[^.](\.[^.]+)$', 1) AS suffix FROM b)
SELECT image_path, basename, suffix, basename[1:len(basename) - len(suffix)] AS stem FROM s""")
def g6(spark, folder):
    p = F.col("image_path")
    return table(spark, folder, "images").select("image_path", tx.basename(p).alias("basename"), tx.suffix(p).alias("suffix"), tx.stem(p).alias("stem"))


@R.add("g7_index_lists", """
WITH l AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_linenumber))) AS n FROM lineitem GROUP BY 1) SELECT k, array_to_string(n, '|') AS numbers FROM l""")
def g7(spark, folder):
    """Lists as typed, such as '3, 1 2', read as sorted distinct numbers."""
    typed = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(", ", F.collect_list(F.col("l_linenumber").cast("string"))).alias("typed"))
    return typed.select(F.col("l_orderkey").alias("k"), F.array_join(F.transform(tx.index_list(F.col("typed")), lambda x: x.cast("string")), "|").alias("numbers"))


@R.add("g8_commands", f"WITH {_REQ} SELECT request_id, CASE WHEN regexp_extract(lower(s), '^(\\S+)', 1) IN ('skip', 'merge', 'no', 'unknown') THEN regexp_extract(lower(s), '^(\\S+)', 1) END AS command FROM q")
def g8(spark, folder):
    return requests(spark, folder).select("request_id", tx.command(F.col("name"), ["skip", "merge", "no", "unknown"]).alias("command"))


@R.add("g9_name_lists", f"WITH {_REQ} SELECT cluster_id, count(DISTINCT lower(s)) AS names FROM (SELECT cluster_id, trim(unnest(string_split(name, ',')), {_BLANK}) AS s FROM q WHERE cluster_id IS NOT NULL AND name IS NOT NULL) WHERE s <> '' GROUP BY 1")
def g9(spark, folder):
    """The names typed for a cluster, in lists with commas, each counted once; no cluster's names come together in one row."""
    typed = requests(spark, folder).where("cluster_id is not null and name is not null").select("cluster_id", F.explode(tx.name_list(F.col("name"))).alias("name"))
    return typed.groupBy("cluster_id").agg(F.count_distinct(F.lower("name")).alias("names"))


@R.add("g10_json_lists", "SELECT person_id, coalesce(len(sample_image_paths), 0) AS n, sample_image_paths[1] AS first_path FROM persons")
def g10(spark, folder):
    """Sample paths written as JSON and read back; null reads as an empty list."""
    back = tx.decoded_list(F.to_json(F.col("sample_image_paths")))
    return table(spark, folder, "persons").select("person_id", F.size(back).cast("bigint").alias("n"), F.try_element_at(back, F.lit(1)).alias("first_path"))


@R.add("g11_distinct_samples", "SELECT person_id, count(DISTINCT x) AS n FROM (SELECT person_id, unnest(sample_image_paths) AS x FROM persons) WHERE x IS NOT NULL GROUP BY 1")
def g11(spark, folder):
    p = table(spark, folder, "persons").select("person_id", F.size(F.array_distinct(F.array_compact("sample_image_paths"))).cast("bigint").alias("n"))
    return p.where("n > 0")


@R.add("t6_merged_samples", """
WITH f AS (SELECT library_id, arg_min(sample_image_paths, person_id) AS first FROM persons WHERE sample_image_paths IS NOT NULL GROUP BY 1),
p AS (SELECT person_id, list_filter(coalesce(sample_image_paths, []), lambda x: x IS NOT NULL)[1:5] AS own, list_filter(coalesce(first, []), lambda x: x IS NOT NULL) AS other FROM persons LEFT JOIN f USING (library_id)),
n AS (SELECT person_id, own, other, list_filter(other, lambda x: len(list_filter(own, lambda y: lower(y) = lower(x))) = 0) AS fresh FROM p),
o AS (SELECT person_id, own, list_filter(fresh, lambda x, i: list_position(list_transform(fresh, lambda y: lower(y)), lower(x)) = i) AS fresh FROM n)
SELECT person_id, array_to_string(list_concat(own, fresh)[1:8], '|') AS samples FROM o""")
def t6(spark, folder):
    """A person's first samples, and after them those of the library's first person that are new; eight at most."""
    p = table(spark, folder, "persons")
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    first = p.where("sample_image_paths is not null").groupBy("library_id").agg(F.min_by("sample_image_paths", "person_id").alias("first"))
    own = F.slice(clean(F.col("sample_image_paths")), 1, 5)
    return p.join(first, "library_id", "left").select("person_id", F.array_join(tx.merged_samples(own, clean(F.col("first")), 8), "|").alias("samples"))


@R.add("g12_timestamps", "SELECT person_id, strftime(timezone('UTC', created_at), '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(timezone('UTC', updated_at), '%Y-%m-%d %H:%M') AS stamp FROM persons")
def g12(spark, folder):
    return table(spark, folder, "persons").select("person_id", tx.iso_seconds(F.col("created_at")).alias("iso"), tx.stamp(F.col("updated_at")).alias("stamp"))


_AGO = "floor((s / {0}) + 0.5)"


@R.add("g13_when", f"""
WITH a AS (SELECT occurrence_id, round((epoch_us(TIMESTAMPTZ '2024-12-31 00:00:00+00') - epoch_us(seen_at)) / 1e6) AS s, seen_at FROM face_occurrences)
SELECT occurrence_id, CASE WHEN seen_at IS NULL THEN '' WHEN s < 45 THEN 'just now' WHEN s < 3600 THEN CAST({_AGO.format(60)} AS BIGINT) || ' min ago' WHEN s < 86400 THEN CAST({_AGO.format(3600)} AS BIGINT) || ' h ago'
  WHEN s < 604800 THEN CAST({_AGO.format(86400)} AS BIGINT) || ' d ago' ELSE strftime(timezone('UTC', seen_at), '%b %-d') END AS seen FROM a""")
def g13(spark, folder):
    now = F.lit("2024-12-31 00:00:00").cast("timestamp")
    return table(spark, folder, "face_occurrences").select("occurrence_id", tx.when_text(F.col("seen_at"), now).alias("seen"))


@R.add("g14_sizes_and_times", """
WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_partkey * l_partkey AS DOUBLE) * 64 AS b, CAST(l_suppkey * 37 AS DOUBLE) AS s FROM lineitem)
SELECT k, n, p, s, CASE WHEN b < 1024 THEN CAST(CAST(b AS BIGINT) AS VARCHAR) || ' B' WHEN b / 1024 < 1024 THEN CASE WHEN b / 1024 < 10 THEN printf('%.1f', b / 1024 + 1e-9) ELSE printf('%.0f', b / 1024 + 1e-9) END || ' KB'
  WHEN b / 1048576 < 1024 THEN CASE WHEN b / 1048576 < 10 THEN printf('%.1f', b / 1048576 + 1e-9) ELSE printf('%.0f', b / 1048576 + 1e-9) END || ' MB' ELSE CASE WHEN b / 1073741824 < 10 THEN printf('%.1f', b / 1073741824 + 1e-9) ELSE printf('%.0f', b / 1073741824 + 1e-9) END || ' GB' END AS size,
  CASE WHEN s < 10 THEN printf('%.1fs', s) WHEN s < 60 THEN printf('%.0fs', s) WHEN floor(s / 60) < 60 THEN CASE WHEN s % 60 = 0 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm' ELSE CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(s % 60 AS BIGINT) AS VARCHAR) || 's' END
  ELSE CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor(s / 60) % 60 AS BIGINT) AS VARCHAR) || 'm' END AS duration
FROM v""")
def g14(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), (F.col("l_partkey") * F.col("l_partkey")).cast("double").alias("b"), (F.col("l_suppkey") * 37).cast("double").alias("s"))
    return rows.select("k", "n", "p", "s", tx.bytes_text(F.col("b") * 64).alias("size"), tx.duration_text(F.col("s")).alias("duration"))


@R.add("g14_plurals", f"WITH {OCC} SELECT person_name, format('{{:,}}', count(*)) || CASE WHEN count(*) = 1 THEN ' photo' ELSE ' photos' END AS shown FROM occ GROUP BY 1")
def g14_plurals(spark, folder):
    n = occurrences(spark, folder).groupBy("person_name").agg(F.count(F.lit(1)).alias("n"))
    return n.select("person_name", tx.plural(F.col("n"), "photo").alias("shown"))


@R.add("g15_data_urls", "SELECT doc_id, 'data:image/jpeg;base64,' || to_base64(encode(text)) AS url FROM documents")
def g15(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.data_url(F.encode("text", "utf-8")).alias("url"))


@R.add("g16_rounded_scores", """
WITH latest AS (SELECT face_id, arg_max(r, r) AS r FROM (SELECT face_id, {'at': arrived_at, 'c': cluster_id, 's': score} AS r FROM face_records WHERE face_id IS NOT NULL) GROUP BY 1)
SELECT cluster_id, round(avg(s), 2) AS score FROM (SELECT r.c AS cluster_id, CASE WHEN CAST(r.s AS VARCHAR) <> 'nan' THEN r.s END AS s FROM latest) WHERE s IS NOT NULL GROUP BY 1""")
def g16(spark, folder):
    """Mean scores of each cluster's faces to two places; null and NaN don't count. (In the SQL a test by isnan would be optimised away by the file's statistics.)"""
    f = latest_rows(table(spark, folder, "face_records"), "face_id", "arrived_at", ["cluster_id", "score"]).where("score is not null and not isnan(score)")
    return f.groupBy("cluster_id").agg(F.round(F.avg("score"), 2).alias("score"))


@R.add("g17_throughput", "SELECT library_id, CASE WHEN sum(coalesce(embedded, 0)) > 0 THEN round(count(*) / CAST(sum(coalesce(embedded, 0)) AS DOUBLE), 3) ELSE 0.0 END AS rate FROM images GROUP BY 1")
def g17(spark, folder):
    n = table(spark, folder, "images").groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("embedded", F.lit(0))).alias("s"))
    return n.select("library_id", F.round(tx.throughput(F.col("n"), F.col("s")), 3).alias("rate"))


@R.add("g19_escaped_names", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def g19(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.html_escaped(F.col("text")).alias("escaped"))


@R.add("g20_casts", f"WITH {_REQ} SELECT request_id, coalesce(CASE WHEN regexp_full_match(s, '[+-]?[0-9]{{1,9}}') THEN CAST(s AS INTEGER) END, -1) AS value FROM q")
def g20(spark, folder):
    return requests(spark, folder).select("request_id", tx.cast_or(F.col("name"), "int", -1).alias("value"))


@R.add("a9_scan_totals", """
SELECT count(*) AS scanned, count(*) FILTER (status = 'unreadable') AS unreadable, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'failed' OR (status = 'ok' AND coalesce(faces_detected, 0) = 0)) AS without_faces, CAST(sum(faces_detected) AS BIGINT) AS faces_detected, CAST(sum(embedded) AS BIGINT) AS embedded FROM images""")
def a9(spark, folder):
    return img.scan_totals(table(spark, folder, "images"))


@R.add("s2_supported_images", "SELECT image_path FROM images WHERE regexp_matches(lower(image_path), '[^./]\\.(jpg|jpeg|png|bmp|webp)$')")
def s2(spark, folder):
    return table(spark, folder, "images").where(img.is_supported(F.col("image_path"))).select("image_path")


@R.add("s1_images_in_order", "SELECT image_path, row_number() OVER (ORDER BY lower(image_path), image_path) AS place FROM images")
def s1(spark, folder):
    """The order of a scan: by the path in lower case."""
    from kithspark.operators.clustering import _dense

    rows = table(spark, folder, "images").select("image_path", F.struct(F.lower("image_path"), "image_path").alias("by"))
    return _dense(rows, "by").select("image_path", (F.col("position") + 1).alias("place"))


@R.add("s8_persons_in_order", f"SELECT person_id, person_name FROM persons ORDER BY {key_sql('person_name')}, person_id")
def s8(spark, folder):
    return table(spark, folder, "persons").select("person_id", "person_name").orderBy(tx.name_key(F.col("person_name")), "person_id")


@R.add("s9_person_by_name", f"SELECT person_id, person_name FROM persons WHERE {key_sql('person_name')} = (SELECT min({key_sql('person_name')}) FROM persons)")
def s9(spark, folder):
    p = table(spark, folder, "persons")
    return identity.person_named(p, p.agg(F.min(tx.name_key(F.col("person_name")))).first()[0]).select("person_id", "person_name")


@R.add("s10_person_count", "SELECT count(*) AS persons FROM persons")
def s10(spark, folder):
    return table(spark, folder, "persons").agg(F.count(F.lit(1)).alias("persons"))


@R.add("k7_without_person", f"SELECT person_id FROM persons WHERE {key_sql('person_name')} <> (SELECT min({key_sql('person_name')}) FROM persons) OR person_name IS NULL")
def k7(spark, folder):
    p = table(spark, folder, "persons")
    return identity.without_person(p, p.agg(F.min(tx.name_key(F.col("person_name")))).first()[0]).select("person_id")


@R.add("sv_p7_names_by_prefix", f"SELECT person_id FROM persons WHERE starts_with({key_sql('person_name')}, 'ma')")
def p7(spark, folder):
    return table(spark, folder, "persons").where(F.startswith(tx.name_key(F.col("person_name")), F.lit("ma"))).select("person_id")


@R.add("sv_p10_gallery_suffixes", "SELECT image_path FROM images WHERE NOT regexp_matches(lower(image_path), '\\.(db|sqlite|sqlite3|json|html|htm|xml)$')")
def p10(spark, folder):
    from kithspark.schemas import NOT_IN_GALLERY

    return table(spark, folder, "images").where(~F.lower(tx.suffix(F.col("image_path"))).isin(*NOT_IN_GALLERY)).select("image_path")


@R.add("sv_p11_equal_lengths", "SELECT person_id, library_id, len(embedding) AS length, count(*) OVER (PARTITION BY library_id, len(embedding)) - 1 AS others FROM persons WHERE embedding IS NOT NULL AND library_id IS NOT NULL")
def p11(spark, folder):
    """Every person with the length of their vector and how many others of the library they can be compared with."""
    p = table(spark, folder, "persons").where("embedding is not null").select("person_id", "library_id", F.size("embedding").cast("bigint").alias("length"))
    n = p.groupBy("library_id", "length").agg((F.count(F.lit(1)) - 1).alias("others"))
    return p.join(n, ["library_id", "length"]).select("person_id", "library_id", "length", "others")


@R.add("sv_p12_named_rows", f"WITH {_REQ} SELECT request_id FROM q WHERE s <> ''")
def p12(spark, folder):
    return requests(spark, folder).where(tx.stripped(F.col("name")) != "").select("request_id")


@R.add("t2_requested_names", f"WITH {_REQ} SELECT library_id, {key_sql('s')} AS k, arg_min(s, request_id) AS name FROM q WHERE s <> '' GROUP BY ALL")
def t2(spark, folder):
    """Of requested names that differ in case only, the first of each library."""
    s = tx.stripped(F.col("name"))
    q = requests(spark, folder).where(s != "").select("library_id", "request_id", s.alias("name"), tx.name_key(s).alias("k"))
    return q.groupBy("library_id", "k").agg(F.min_by("name", "request_id").alias("name"))


@R.add("v11_empty_filter", "SELECT person_id FROM persons WHERE contains(lower(coalesce(person_name, '')), 'zzzz')")
def v11(spark, folder):
    return views.containing(table(spark, folder, "persons"), "person_name", "zzzz").select("person_id")


_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_GOOD = "(len({0}) > 0 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0)"


_MARKS = "CASE WHEN changed THEN round(list_sum(list_transform({0}, lambda x, i: CAST(CAST(x AS FLOAT) AS DOUBLE) * i)), 3) + 0.0 END AS {1}_mark"
_UNIT = "list_transform({0}, lambda x: x / " + _NORM + ")"

_UPSERTED = f"""
WITH face AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY arrived_at DESC NULLS LAST, library_id DESC NULLS LAST, person_name DESC NULLS LAST, image_path DESC NULLS LAST) AS rn FROM face_records WHERE face_id IS NOT NULL) WHERE rn = 1),
named AS (SELECT *, translate(trim(person_name), '{UPPER}', 'abcdefghijklmnopqrstuvwxyz') AS k FROM face WHERE person_name IS NOT NULL AND trim(person_name) <> '' AND len(embedding) = 64 AND {_GOOD.format('embedding')}),
best AS (SELECT library_id, k, arg_min({{'n': person_name, 'e': CAST(embedding AS DOUBLE[]), 'y': CASE WHEN {_GOOD.format('eye_embedding')} THEN CAST(eye_embedding AS DOUBLE[]) END}}, face_id) AS r, count(*) AS faces, count(*) FILTER ({_GOOD.format('eye_embedding')}) AS eyes,
  [min(image_path), max(image_path)] AS paths FROM named GROUP BY ALL),
b AS (SELECT library_id, k, trim(r.n) AS name, {_UNIT.format('r.e')} AS e, {_UNIT.format('r.y')} AS y, faces, greatest(1, eyes) AS eyes, list_filter(paths, lambda x, i: x IS NOT NULL AND (i = 1 OR lower(x) <> lower(paths[1]))) AS paths FROM best),
p AS (SELECT *, translate(person_name, '{UPPER}', 'abcdefghijklmnopqrstuvwxyz') AS k, CASE WHEN {_GOOD.format('eye_embedding')} THEN eye_embedding END AS oy, greatest(0, coalesce(eye_faces_seen, 0)) AS oe FROM persons),
j AS (SELECT coalesce(p.library_id, b.library_id) AS library_id, coalesce(b.name, p.person_name) AS person_name, b.name IS NOT NULL AS changed,
  CASE WHEN b.name IS NULL THEN p.faces_seen WHEN p.person_name IS NULL THEN b.faces ELSE greatest(1, coalesce(p.faces_seen, 1)) + b.faces END AS faces_seen,
  CASE WHEN p.person_name IS NULL OR len(p.embedding) IS DISTINCT FROM 64 OR NOT {_GOOD.format('p.embedding')} THEN b.e
    ELSE list_transform(range(1, 65), lambda i: p.embedding[i] * greatest(1, coalesce(p.faces_seen, 1)) + b.e[i] * b.faces) END AS v,
  CASE WHEN b.name IS NULL THEN p.eye_faces_seen WHEN b.y IS NULL THEN coalesce(p.oe, 0) WHEN p.oy IS NULL OR len(p.oy) <> len(b.y) THEN b.eyes ELSE p.oe + b.eyes END AS eye_faces_seen,
  CASE WHEN b.y IS NULL THEN CAST(p.oy AS DOUBLE[]) WHEN p.oy IS NULL OR len(p.oy) <> len(b.y) THEN b.y ELSE list_transform(range(1, len(b.y) + 1), lambda i: p.oy[i] * p.oe + b.y[i] * b.eyes) END AS w, b.y IS NULL OR p.oy IS NULL OR len(p.oy) <> len(b.y) AS w_done,
  coalesce(p.sample_image_paths, []) AS old_paths, coalesce(b.paths, []) AS new_paths
  FROM p FULL JOIN b ON p.library_id = b.library_id AND p.k = b.k),
u AS (SELECT *, {_UNIT.format('v')} AS full_vector, CASE WHEN w_done THEN w ELSE {_UNIT.format('w')} END AS eye_vector, list_concat(old_paths, list_filter(new_paths, lambda x: len(list_filter(old_paths, lambda y: lower(y) = lower(x))) = 0))[1:8] AS samples FROM j)
SELECT library_id, person_name, faces_seen, eye_faces_seen, CASE WHEN changed THEN array_to_string(samples, '|') END AS samples, {_MARKS.format('full_vector', 'full')}, {_MARKS.format('eye_vector', 'eye')} FROM u"""


def _batch(spark, folder) -> DataFrame:
    """All named faces as one batch of persons: of a name the least face's vectors, the number of its faces, two of its photos."""
    from kithspark.functions.vectors import usable

    columns = ["library_id", "person_name", "image_path", "embedding", "eye_embedding"]
    f = latest_wide(table(spark, folder, "face_records"), "face_id", "arrived_at", columns)
    f = f.where((F.trim("person_name") != "") & (F.size("embedding") == 64) & usable(F.col("embedding")))
    eye = usable(F.col("eye_embedding"))
    keyed = f.select("face_id", "library_id", tx.name_key(F.trim("person_name")).alias("k"), F.trim("person_name").alias("n"), "image_path", "embedding", F.when(eye, F.col("eye_embedding")).alias("eye"))
    counts = keyed.groupBy("library_id", "k").agg(F.min("face_id").alias("face_id"), F.count(F.lit(1)).cast("int").alias("faces"), F.count("eye").cast("int").alias("eyes"), F.min("image_path").alias("a"), F.max("image_path").alias("b"))
    chosen = keyed.select("face_id", "n", "embedding", "eye").join(counts, "face_id")
    return chosen.select("library_id", F.col("n").alias("person_name"), "embedding", tx.first_by(F.array_compact(F.array("a", "b")), F.lower).alias("sample_image_paths"), F.col("faces").alias("faces_seen"), F.col("eye").alias("eye_embedding"), F.col("eyes").alias("eye_faces_seen"))


_NOW = "2025-01-01 00:00:00"


def _shown(after: DataFrame) -> DataFrame:
    changed = F.col("updated_at") == F.lit(_NOW).cast("timestamp")
    mark = lambda v: F.when(changed, F.round(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 3) + 0.0)
    return after.select("library_id", "person_name", "faces_seen", "eye_faces_seen", F.when(changed, F.array_join("sample_image_paths", "|")).alias("samples"), mark("embedding").alias("full_mark"), mark("eye_embedding").alias("eye_mark"))


@R.add("i2_upserted_persons", _UPSERTED)
def i2(spark, folder):
    """Persons after all named faces were added: new ones, and both vectors blended by numbers of faces."""
    return _shown(identity.upserted(table(spark, folder, "persons"), _batch(spark, folder), F.lit(_NOW).cast("timestamp"), ["library_id"]))


_MERGED = f"""
WITH l AS (SELECT min(library_id) AS lib FROM persons), q AS (SELECT * FROM persons WHERE library_id = (SELECT lib FROM l)),
o AS (SELECT person_id, row_number() OVER (ORDER BY translate(person_name, '{UPPER}', 'abcdefghijklmnopqrstuvwxyz')) AS r FROM q WHERE len(embedding) = 64 AND {_GOOD.format('embedding')} AND {_GOOD.format('eye_embedding')} AND len(eye_embedding) = 64),
a AS (SELECT q.* FROM q JOIN o USING (person_id) WHERE r = 1), b AS (SELECT q.* FROM q JOIN o USING (person_id) WHERE r = 2),
n AS (SELECT a.person_id, greatest(1, coalesce(a.faces_seen, 1)) AS fa, greatest(1, coalesce(b.faces_seen, 1)) AS fb, greatest(1, coalesce(a.eye_faces_seen, 1)) AS ea, greatest(1, coalesce(b.eye_faces_seen, 1)) AS eb,
  CAST(a.embedding AS DOUBLE[]) AS va, CAST(b.embedding AS DOUBLE[]) AS vb, CAST(a.eye_embedding AS DOUBLE[]) AS ya, CAST(b.eye_embedding AS DOUBLE[]) AS yb, b.person_id AS gone FROM a, b),
m AS (SELECT person_id, gone, fa + fb AS faces, list_transform(range(1, 65), lambda i: va[i] * fa + vb[i] * fb) AS v, list_transform(range(1, 65), lambda i: ya[i] * ea + yb[i] * eb) AS y FROM n),
u AS (SELECT q.person_id, q.person_name, m.person_id IS NOT NULL AS changed, coalesce(m.faces, q.faces_seen) AS faces_seen, coalesce(m.faces, q.eye_faces_seen) AS eye_faces_seen, {_UNIT.format('m.v')} AS v, {_UNIT.format('m.y')} AS y
  FROM q LEFT JOIN m USING (person_id) WHERE q.person_id NOT IN (SELECT gone FROM m))
SELECT person_id, person_name, faces_seen, eye_faces_seen, {_MARKS.format('v', 'full')}, {_MARKS.format('y', 'eye')} FROM u"""


@R.add("i3_merged_persons", _MERGED)
def i3(spark, folder):
    """The persons of the first library after its first two people, by name, of those with both vectors were made one."""
    from kithspark.functions.vectors import usable

    p = table(spark, folder, "persons")
    lib = p.agg(F.min("library_id")).first()[0]
    q = p.where(F.col("library_id") == F.lit(lib))
    both = usable(F.col("embedding")) & (F.size("embedding") == 64) & usable(F.col("eye_embedding")) & (F.size("eye_embedding") == 64)
    two = [r.person_name for r in q.where(both).orderBy(tx.name_key(F.col("person_name"))).select("person_name").limit(2).collect()]
    after = identity.merged_persons(q, *two, F.lit(_NOW).cast("timestamp")) if len(two) == 2 else q
    ids = q.select("person_name", "person_id")
    return _shown(after).drop("samples", "library_id").join(ids, "person_name").select("person_id", "person_name", "faces_seen", "eye_faces_seen", "full_mark", "eye_mark")


@R.add("j8_unknown_names", f"""
WITH {_REQ} SELECT DISTINCT library_id, {key_sql('s')} AS name_key FROM q WHERE s <> '' AND NOT EXISTS (SELECT 1 FROM persons p WHERE p.library_id = q.library_id AND {key_sql('p.person_name')} = {key_sql('q.s')})""")
def j8(spark, folder):
    """Requested names that no person of the library has."""
    asked = requests(spark, folder).select("library_id", tx.name_key(tx.stripped(F.col("name"))).alias("name_key")).where("name_key <> ''").distinct()
    known = table(spark, folder, "persons").select("library_id", tx.name_key(F.col("person_name")).alias("name_key"))
    return asked.join(known, ["library_id", "name_key"], "left_anti")


@R.add("j7_photos_of_requested_people", f"""
WITH {FOCC}, {_REQ} SELECT DISTINCT f.library_id, f.image_path FROM focc f WHERE EXISTS (SELECT 1 FROM q WHERE q.library_id = f.library_id AND {key_sql('q.s')} = f.k)""")
def j7(spark, folder):
    """Photos of everybody who was asked for by name."""
    asked = requests(spark, folder).select("library_id", tx.name_key(tx.stripped(F.col("name"))).alias("name_key"))
    occ = by_library(spark, folder).withColumn("name_key", tx.name_key(F.col("person_name")))
    return occ.join(asked, ["library_id", "name_key"], "left_semi").select("library_id", "image_path").distinct()


@R.add("j4_labelled_faces", """
WITH latest AS (SELECT face_id, arg_max(r, r) AS r FROM (SELECT face_id, {'at': arrived_at, 'c': cluster_id, 'p': person_name} AS r FROM face_records WHERE face_id IS NOT NULL) GROUP BY 1),
l AS (SELECT r.c AS c, min(r.p) AS label FROM latest WHERE r.c >= 0 GROUP BY 1)
SELECT face_id, l.label FROM latest LEFT JOIN l ON r.c = l.c""")
def j4(spark, folder):
    """Every face with the label of its cluster, by a join that a heavy cluster doesn't slow."""
    from kithspark.operators.skew import skew_join

    f = latest_rows(table(spark, folder, "face_records"), "face_id", "arrived_at", ["cluster_id", "person_name"])
    labels = f.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("person_name").alias("label"))
    return skew_join(f.select("face_id", "cluster_id"), labels, "cluster_id", how="left").select("face_id", "label")


@R.add("k5_updated_persons", _UPSERTED)
def k5(spark, folder):
    """Persons written to a store, updated in its touched parts by a batch of named faces, and read back."""
    from kithspark.session import shared_dir
    from kithspark.sources.store import Store

    p = table(spark, folder, "persons")
    store = Store(spark, f"{shared_dir(spark)}/persons-{uuid.uuid4().hex}", p.schema, tx.name_key(F.trim("person_name")), 16)
    store.write(p)
    batch = _batch(spark, folder)
    parts = store.touched(batch)
    store.write(identity.upserted(store.read(parts), batch, F.lit(_NOW).cast("timestamp"), ["library_id"]), only=parts)
    store.drop_old(1)
    return _shown(store.read())


# A model that stands for a detector: what an image's bytes say decides what is found in it.
_STUB = """
WITH i AS (SELECT image_path, length(image_path) AS n FROM images WHERE image_path IS NOT NULL AND regexp_matches(lower(image_path), '[^./]\\.(jpg|jpeg|png|bmp|webp)$')),
k AS (SELECT *, CASE WHEN n % 5 = 4 THEN 'broken' WHEN n % 7 = 6 THEN 'unreadable' WHEN n % 11 = 10 THEN 'failed' ELSE 'ok' END AS kind FROM i)"""


def _scanned(spark, folder) -> DataFrame:
    """(path, content) of the images: four bytes that show the kind of file, and then the length of the path."""
    n = F.length("image_path")
    head = F.when(n % 5 == 4, F.lit("00000000")).when(n % 3 == 0, F.lit("FFD8FFE0")).when(n % 3 == 1, F.lit("89504E47")).otherwise(F.lit("424D0000"))
    content = F.concat(F.unhex(head), F.when(n % 3 == 1, F.unhex(F.lit("0D0A1A0A"))).otherwise(F.unhex(F.lit("20202020"))), F.encode(n.cast("string"), "utf-8"))
    i = table(spark, folder, "images").where(img.is_supported(F.col("image_path")))
    return i.select(F.col("image_path").alias("path"), content.alias("content"))


def _stub():
    def detect(content: bytes) -> list[dict]:
        n = int(content[8:])
        if n % 7 == 6:
            raise ValueError("no image")
        if n % 11 == 10:
            raise RuntimeError("out of order")
        return [{"x1": i, "y1": n, "x2": i + 10, "y2": n + 10, "score": 0.5, "embedding": [float(i), float(n)] if i % 2 == 0 else None, "eye_embedding": None} for i in range(n % 4)]

    return detect


@R.add("s3_readable_images", _STUB + " SELECT image_path AS path FROM k WHERE kind <> 'broken'")
def s3(spark, folder):
    """Images whose first bytes are those of a picture."""
    return _scanned(spark, folder).where(img.is_readable(F.col("content"))).select("path")


@R.add("u1_processed_images", _STUB + """ SELECT image_path AS path, kind AS status, CASE WHEN kind = 'ok' THEN n % 4 ELSE 0 END AS faces_detected, CASE WHEN kind = 'ok' THEN (n % 4 + 1) // 2 ELSE 0 END AS embedded,
  CASE kind WHEN 'unreadable' THEN 'no image' WHEN 'failed' THEN 'RuntimeError: out of order' END AS error FROM k WHERE kind <> 'broken'""")
def u1(spark, folder):
    """Every readable image through a model of one's own; what goes wrong in one image stays with it."""
    images = _scanned(spark, folder).where(img.is_readable(F.col("content")))
    return img.processed(images, _stub).select("path", "status", "faces_detected", "embedded", "error")


@R.add("sv_p1_faces_with_vectors", _STUB + """, f AS (SELECT image_path, n, unnest(range(n % 4)) AS i FROM k WHERE kind = 'ok')
SELECT image_path, i AS position, i AS x1, n AS y1, i + 10 AS x2, n + 10 AS y2, i * 1000 + n AS vector FROM f WHERE i % 2 = 0""")
def p1(spark, folder):
    """One row for each face that the model gave a vector."""
    images = _scanned(spark, folder).where(img.is_readable(F.col("content")))
    rows = img.face_rows(img.processed(images, _stub))
    return rows.select("image_path", "position", "x1", "y1", "x2", "y2", (F.col("embedding")[0] * 1000 + F.col("embedding")[1]).cast("bigint").alias("vector"))
