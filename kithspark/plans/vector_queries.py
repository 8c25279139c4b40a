"""Queries over vectors, boxes and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kithspark.functions import geometry as geo, vectors as vec
from kithspark.operators import clustering as clu, identity, views
from kithspark.operators.graph import close_pairs, density_clusters
from kithspark.operators.latest import latest_rows, latest_wide
from kithspark.plans.registry import Registry, table

R = Registry()

LATEST_COLUMNS = ["library_id", "image_path", "x1", "y1", "x2", "y2", "embedding", "eye_embedding", "score", "cluster_id", "person_name"]
#: Each face by its latest row; rows of one time are equal but for the fields that a correction touches.
FACE = """face AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY arrived_at DESC NULLS LAST, cluster_id DESC NULLS LAST, score DESC NULLS LAST) AS rn FROM face_records WHERE face_id IS NOT NULL) WHERE rn = 1)"""
OK = "(len({0}) > 0 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0)"
COS = "CASE WHEN {oka} AND {okb} AND len({a}) = len({b}) THEN list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) END"


def cos_sql(a: str, b: str) -> str:
    return COS.format(a=a, b=b, oka=OK.format(a), okb=OK.format(b))


def faces(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each face once, with the columns asked for."""
    rows = table(spark, folder, "face_records")
    wide = any(c.endswith("embedding") for c in columns)
    picked = list(columns)
    return (latest_wide if wide else latest_rows)(rows, "face_id", "arrived_at", picked)


#: The vectors of ``embeddings`` in two signals; those of label 0 lack the second.
SIGNALS = "f AS (SELECT vec_id AS id, CAST(embedding[1:40] AS DOUBLE[]) AS full, CASE WHEN label <> 0 THEN CAST(embedding[41:64] AS DOUBLE[]) END AS eye FROM embeddings)"
DIST_FULL = "1 - list_cosine_similarity(a.full, b.full)"
DIST_FUSED = "1 - coalesce(0.4 * list_cosine_similarity(a.full, b.full) + 0.6 * list_cosine_similarity(a.eye, b.eye), list_cosine_similarity(a.full, b.full))"


def signals(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 40).alias("full"), F.when(F.col("label") != 0, F.slice("embedding", 41, 24)).alias("eye"))


def edges_sql(name: str, distance: str, eps: float, where: str = "true") -> str:
    return f"{name} AS (SELECT a.id AS a, b.id AS b, {distance} AS distance FROM f a JOIN f b ON a.id < b.id WHERE {where} AND {distance} <= {eps})"


def components_sql(name: str, edges: str, vertices: str = "SELECT id FROM f") -> str:
    """CTEs of the connected components of ``edges`` over ``vertices``: ``name`` (id, label)."""
    return f"""{name}_r(id, label) AS (
  SELECT id, id FROM ({vertices}) UNION SELECT e.b, r.label FROM {name}_r r JOIN (SELECT a, b FROM {edges} UNION ALL SELECT b, a FROM {edges}) e ON e.a = r.id),
{name} AS (SELECT id, min(label) AS label FROM {name}_r GROUP BY id)"""


EPS, EPS_FUSED = 0.45, 0.5


def marks_sql(v: str) -> str:
    """Two numbers that every element of a vector, and its place, goes into."""
    return f"round(list_sum(list_transform({v}, lambda x, i: x * i)), 3) + 0.0 AS mark_1, round(list_sum(list_transform({v}, lambda x, i: x * (i % 7 - 3))), 3) + 0.0 AS mark_2"


def marks(v: Column, *names: str) -> list[Column]:
    total = lambda f: F.round(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * f(i + 1)), F.lit(0.0), lambda s, x: s + x), 3) + 0.0
    one, two = names or ("mark_1", "mark_2")
    return [total(lambda i: i).alias(one), total(lambda i: i % 7 - 3).alias(two)]


@R.add("c1_cosine_similarity", f"WITH {FACE} SELECT face_id, round({cos_sql('embedding', 'eye_embedding')}, 4) AS similarity FROM face")
def c1(spark, folder):
    """Similarity of a face's two vectors; null where one can't be used."""
    return faces(spark, folder, "embedding", "eye_embedding").select("face_id", F.round(vec.cosine_similarity(F.col("embedding"), F.col("eye_embedding")), 4).alias("similarity"))


@R.add("c2_cosine_distance", f"""
WITH d AS (SELECT person_id, coalesce(len(embedding) <> len(eye_embedding), false) AS refused, {cos_sql('embedding', 'eye_embedding')} AS c FROM persons)
SELECT person_id, refused, CASE WHEN NOT refused THEN round(CASE WHEN c IS NULL THEN 2.0 ELSE 1 - greatest(-1, least(1, c)) END, 4) END AS distance FROM d""")
def c2(spark, folder):
    """Distance of a person's two vectors, which are refused if their sizes differ."""
    a, b = F.col("embedding"), F.col("eye_embedding")
    refused = vec.sizes_differ(a, b)
    return table(spark, folder, "persons").select("person_id", refused.alias("refused"), F.round(F.when(~refused, vec.cosine_distance(a, b)), 4).alias("distance"))


_FP = f"""WITH {FACE}, fp AS (
  SELECT f.face_id, p.person_id, f.embedding AS fa, p.embedding AS fb, f.eye_embedding AS ea, p.eye_embedding AS eb
  FROM face f JOIN persons p ON f.library_id = p.library_id AND f.person_name = p.person_name),
s AS (SELECT face_id, person_id, {cos_sql('fa', 'fb')} AS fs, {cos_sql('ea', 'eb')} AS es FROM fp)"""


def _face_person(spark, folder):
    f = faces(spark, folder, "library_id", "person_name", "embedding", "eye_embedding").select("face_id", "library_id", "person_name", F.col("embedding").alias("fa"), F.col("eye_embedding").alias("ea"))
    p = table(spark, folder, "persons").select("person_id", "library_id", "person_name", F.col("embedding").alias("fb"), F.col("eye_embedding").alias("eb"))
    return f.join(p, ["library_id", "person_name"])


@R.add("c3_fused_similarity", _FP + " SELECT face_id, person_id, round(coalesce(0.4 * fs + 0.6 * es, fs, es), 4) AS similarity FROM s")
def c3(spark, folder):
    """Named faces against their person, by whichever signals both have."""
    return _face_person(spark, folder).select("face_id", "person_id", F.round(vec.fused_similarity(*map(F.col, ("fa", "fb", "ea", "eb"))), 4).alias("similarity"))


@R.add("c4_fused_distance", _FP + " SELECT face_id, person_id, round(1 - coalesce((2 * fs + 3 * es) / 5, fs, es), 4) AS distance FROM s")
def c4(spark, folder):
    return _face_person(spark, folder).select("face_id", "person_id", F.round(vec.fused_distance(*map(F.col, ("fa", "fb", "ea", "eb")), weights=(2, 3)), 4).alias("distance"))


@R.add("c7_weights_used", _FP + " SELECT face_id, person_id, CASE WHEN es IS NULL THEN 1e0 ELSE 4e-1 END AS full_weight, CASE WHEN es IS NULL THEN 0e0 ELSE 6e-1 END AS eye_weight FROM s")
def c7(spark, folder):
    w = vec.weights_used(F.col("ea"), F.col("eb"))
    return _face_person(spark, folder).select("face_id", "person_id", w["full"].alias("full_weight"), w["eye"].alias("eye_weight"))


@R.add("c8_unit_vectors", f"""
WITH {FACE}, u AS (SELECT face_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM face WHERE {OK.format('embedding')})
SELECT face_id, {marks_sql('v')} FROM u""")
def c8(spark, folder):
    return faces(spark, folder, "embedding").where(vec.usable(F.col("embedding"))).select("face_id", vec.unit(F.col("embedding")).alias("v")).select("face_id", *marks(F.col("v")))


@R.add("u3_distance_or_far", f"WITH {FACE} SELECT face_id, round(coalesce(1 - {cos_sql('embedding', 'eye_embedding')}, 2.0), 4) AS distance FROM face")
def u3(spark, folder):
    return faces(spark, folder, "embedding", "eye_embedding").select("face_id", F.round(vec.metric_or_far(1 - vec.cosine_similarity(F.col("embedding"), F.col("eye_embedding"))), 4).alias("distance"))


@R.add("sv_p2_usable_faces", f"WITH {FACE} SELECT face_id FROM face WHERE {OK.format('embedding')}")
def p2(spark, folder):
    return faces(spark, folder, "embedding").where(vec.usable(F.col("embedding"))).select("face_id")


@R.add("s11_decoded_persons", f"SELECT person_id, {OK.format('embedding')} IS TRUE AS has_full, {OK.format('eye_embedding')} IS TRUE AS has_eye FROM persons")
def s11(spark, folder):
    p = identity.decoded(table(spark, folder, "persons"))
    return p.select("person_id", F.col("embedding").isNotNull().alias("has_full"), F.col("eye_embedding").isNotNull().alias("has_eye"))


@R.add("j2_close_pairs", f"WITH {SIGNALS}, {edges_sql('e', DIST_FULL, EPS)} SELECT a, b, round(distance, 4) AS distance FROM e")
def j2(spark, folder):
    return close_pairs(signals(spark, folder), EPS).select("a", "b", F.round("distance", 4).alias("distance"))


@R.add("c6_fused_close_pairs", f"WITH {SIGNALS}, {edges_sql('e', DIST_FUSED, EPS_FUSED)} SELECT a, b, round(distance, 4) AS distance FROM e")
def c6(spark, folder):
    return close_pairs(signals(spark, folder), EPS_FUSED, eye="eye").select("a", "b", F.round("distance", 4).alias("distance"))


@R.add("d1_edge_degrees", f"WITH {SIGNALS}, {edges_sql('e', DIST_FULL, EPS)} SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id")
def d1(spark, folder):
    e = close_pairs(signals(spark, folder), EPS)
    return e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@R.add("d2_components", f"WITH RECURSIVE {SIGNALS}, {edges_sql('e', DIST_FULL, EPS)}, {components_sql('cc', 'e')} SELECT id, label FROM cc")
def d2(spark, folder):
    f = signals(spark, folder)
    return density_clusters(f, close_pairs(f, EPS))


@R.add("d3_dense_clusters", f"""
WITH RECURSIVE {SIGNALS}, {edges_sql('e', DIST_FULL, EPS)},
both_ways AS (SELECT a AS id, b AS near FROM e UNION ALL SELECT b, a FROM e),
core AS (SELECT id FROM both_ways GROUP BY id HAVING count(*) + 1 >= 3),
ce AS (SELECT id AS a, near AS b FROM both_ways WHERE id < near AND id IN (SELECT id FROM core) AND near IN (SELECT id FROM core)),
{components_sql('cc', 'ce', 'SELECT id FROM core')},
border AS (SELECT w.id, min(cc.label) AS label FROM both_ways w JOIN cc ON cc.id = w.near WHERE w.id NOT IN (SELECT id FROM core) GROUP BY w.id)
SELECT f.id, coalesce(cc.label, border.label, -1) AS label FROM f LEFT JOIN cc USING (id) LEFT JOIN border USING (id)""")
def d3(spark, folder):
    f = signals(spark, folder)
    return density_clusters(f, close_pairs(f, EPS), 3)


_D4 = f"""WITH RECURSIVE {SIGNALS}, {edges_sql('ee', DIST_FUSED, EPS_FUSED, 'a.eye IS NOT NULL AND b.eye IS NOT NULL')}, {edges_sql('fe', DIST_FULL, EPS_FUSED)},
{components_sql('g', 'ee', 'SELECT id FROM f WHERE eye IS NOT NULL')}, {components_sql('fl', 'fe')},
j AS (SELECT fl.id, fl.label AS fl, g.label AS g, CAST(f.eye IS NOT NULL AS DOUBLE) AS cov FROM fl JOIN f USING (id) LEFT JOIN g USING (id)),
hits AS (SELECT g, fl, count(*) AS h, min(id) AS seen FROM j WHERE g IS NOT NULL GROUP BY g, fl),
top AS (SELECT g, arg_max(h, (h, -seen)) AS h FROM hits GROUP BY g),
kept AS (SELECT j.g, any_value(top.h) / count(*) AS agreement, min(id) AS first_id FROM j JOIN top USING (g) GROUP BY j.g
  HAVING any_value(top.h) / count(*) >= 0.6 OR (avg(cov) >= 0.999 AND any_value(top.h) / count(*) >= 0.4)),
place AS (SELECT j.id, CASE WHEN k.g IS NOT NULL THEN 0 ELSE 1 END AS p1, CASE WHEN k.g IS NOT NULL THEN -k.agreement ELSE CAST(j.fl AS DOUBLE) END AS p2, CASE WHEN k.g IS NOT NULL THEN k.first_id ELSE 0 END AS p3 FROM j LEFT JOIN kept k USING (g)),
lab AS (SELECT id, dense_rank() OVER (ORDER BY p1, p2, p3) - 1 AS label FROM place)"""


@R.add("d5_reconciled", _D4 + " SELECT id, CAST(label AS BIGINT) AS label FROM lab")
def d5(spark, folder):
    """Faces of which some lack the second signal: both passes, reconciled."""
    return clu.face_labels(signals(spark, folder), EPS_FUSED)


@R.add("d4_all_with_eyes", f"""
WITH RECURSIVE g0 AS (SELECT 1), f AS (SELECT vec_id AS id, CAST(embedding[1:40] AS DOUBLE[]) AS full, CAST(embedding[41:64] AS DOUBLE[]) AS eye FROM embeddings),
{edges_sql('e', DIST_FUSED, EPS_FUSED)}, {components_sql('cc', 'e')} SELECT id, label FROM cc""")
def d4(spark, folder):
    """Every face has both signals: one fused pass."""
    e = table(spark, folder, "embeddings")
    return clu.face_labels(e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 40).alias("full"), F.slice("embedding", 41, 24).alias("eye")), EPS_FUSED)


@R.add("w1_numbered_clusters", f"""
WITH RECURSIVE {SIGNALS}, {edges_sql('e', DIST_FULL, EPS)}, {components_sql('cc', 'e')},
s AS (SELECT label, min(id) AS first_id, row_number() OVER (ORDER BY min(id)) - 1 AS cluster_id FROM cc GROUP BY label HAVING count(*) >= 2)
SELECT cc.id, CAST(s.cluster_id AS BIGINT) AS cluster_id FROM cc JOIN s USING (label)""")
def w1(spark, folder):
    """Clusters of two faces or more, numbered by their first face."""
    f = signals(spark, folder)
    return clu._numbered(density_clusters(f, close_pairs(f, EPS)), 2)


_BOXES = f"""{FACE}, b AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY CASE WHEN score IS NULL OR isnan(score) THEN NULL ELSE score END DESC NULLS LAST, face_id) AS r FROM face
  WHERE image_path IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL)"""
_AREA = "(greatest({0}x2 - {0}x1, 0) * greatest({0}y2 - {0}y1, 0))"
_INTER = "(greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0))"
_IOU = f"(CASE WHEN {_INTER} > 0 THEN {_INTER} / ({_AREA.format('k.')} + {_AREA.format('b.')} - {_INTER}) ELSE 0 END)"
_DIAG = "sqrt(({0}x2 - {0}x1) * ({0}x2 - {0}x1) + ({0}y2 - {0}y1) * ({0}y2 - {0}y1))"
_NEAR = f"(least({_DIAG.format('k.')}, {_DIAG.format('b.')}) > 0 AND sqrt(((k.x1 + k.x2 - b.x1 - b.x2) / 2.0) ** 2 + ((k.y1 + k.y2 - b.y1 - b.y2) / 2.0) ** 2) <= 0.35 * least({_DIAG.format('k.')}, {_DIAG.format('b.')}))"


def _nms_sql(same: str) -> str:
    one = "{'id': b.face_id, 'x1': CAST(b.x1 AS BIGINT), 'y1': CAST(b.y1 AS BIGINT), 'x2': CAST(b.x2 AS BIGINT), 'y2': CAST(b.y2 AS BIGINT)}"
    return f"""WITH RECURSIVE {_BOXES},
g(image_path, r, kept) AS (
  SELECT b.image_path, b.r, [{one}] FROM b WHERE b.r = 1
  UNION ALL
  SELECT b.image_path, b.r, CASE WHEN len(list_filter(g.kept, lambda k: {same})) = 0 THEN list_append(g.kept, {one}) ELSE g.kept END
  FROM g JOIN b ON b.image_path = g.image_path AND b.r = g.r + 1),
fin AS (SELECT image_path, arg_max(kept, r) AS kept FROM g GROUP BY image_path),
stay AS (SELECT unnest(kept).id AS face_id FROM fin)
SELECT face_id FROM stay UNION ALL SELECT face_id FROM face WHERE image_path IS NULL OR x1 IS NULL OR y1 IS NULL OR x2 IS NULL OR y2 IS NULL"""


_BOX = ("image_path", "x1", "y1", "x2", "y2", "score")


@R.add("b3_deduplicated_faces", _nms_sql(f"({_IOU} >= 0.5 OR {_NEAR})"))
def b3(spark, folder):
    """Faces that are left once double boxes of a photo are gone."""
    return clu.deduplicated(faces(spark, folder, *_BOX)).select("face_id")


@R.add("b2_deduplicated_by_overlap", _nms_sql(f"{_IOU} >= 0.5"))
def b2(spark, folder):
    return clu.deduplicated(faces(spark, folder, *_BOX), proximity=None).select("face_id")


@R.add("b1_box_overlap", f"""
WITH {FACE} SELECT k.face_id AS a, b.face_id AS b, round({_IOU}, 4) AS iou FROM face k JOIN face b ON k.image_path = b.image_path AND k.face_id < b.face_id WHERE {_IOU} > 0""")
def b1(spark, folder):
    """Overlap of the boxes of a photo that overlap at all."""
    f = faces(spark, folder, *_BOX)
    side = lambda n: f.select("image_path", F.col("face_id").alias(n), geo.box(*[F.col(c) for c in geo.SIDES]).alias(f"box_{n}"))
    value = geo.iou(F.col("box_a"), F.col("box_b"))
    return side("a").join(side("b"), "image_path").where("a < b").where(value > 0).select("a", "b", F.round(value, 4).alias("iou"))


@R.add("b4_box_measures", f"""
WITH {FACE} SELECT face_id, CAST(x2 - x1 AS DOUBLE) AS width, CAST(y2 - y1 AS DOUBLE) AS height, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, round({_DIAG.format('')}, 4) AS diagonal,
  CAST({_AREA.format('')} AS DOUBLE) AS area FROM face""")
def b4(spark, folder):
    b = geo.box(*[F.col(c) for c in geo.SIDES])
    cx, cy = geo.centre(b)
    return faces(spark, folder, *_BOX).select("face_id", geo.width(b).alias("width"), geo.height(b).alias("height"), cx.alias("cx"), cy.alias("cy"), F.round(geo.diagonal(b), 4).alias("diagonal"), geo.area(b).alias("area"))


@R.add("sv_p4_clipped_boxes", f"""
WITH {FACE}, c AS (SELECT face_id, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 3000) AS x2, least(y2, 2000) AS y2 FROM face)
SELECT face_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM c WHERE x2 > x1 AND y2 > y1""")
def p4(spark, folder):
    """Boxes within a frame of 3000 by 2000; those outside are dropped."""
    b = geo.clipped(geo.box(*[F.col(c) for c in geo.SIDES]), F.lit(3000), F.lit(2000))
    return faces(spark, folder, *_BOX).select("face_id", b.alias("b")).where("b is not null").select("face_id", "b.*")


@R.add("b8_crop_boxes", f"""
WITH {FACE}, d AS (SELECT face_id, x1, y1, x2, y2, greatest(x2 - x1, 1) * 0.12 AS dx, greatest(y2 - y1, 1) * 0.12 AS dy FROM face WHERE x1 IS NOT NULL),
c AS (SELECT face_id, greatest(floor(x1 - dx), 0) AS l, greatest(floor(y1 - dy), 0) AS t, least(ceil(x2 + dx), 3999) AS r, least(ceil(y2 + dy), 2999) AS b FROM d)
SELECT face_id, CAST(CASE WHEN r <= l OR b <= t THEN 0 ELSE l END AS DOUBLE) AS x1, CAST(CASE WHEN r <= l OR b <= t THEN 0 ELSE t END AS DOUBLE) AS y1,
  CAST(CASE WHEN r <= l OR b <= t THEN 4000 ELSE r END AS DOUBLE) AS x2, CAST(CASE WHEN r <= l OR b <= t THEN 3000 ELSE b END AS DOUBLE) AS y2 FROM c""")
def b8(spark, folder):
    b = geo.crop_box(geo.box(*[F.col(c) for c in geo.SIDES]), F.lit(4000), F.lit(3000))
    return faces(spark, folder, *_BOX).where("x1 is not null").select("face_id", b.alias("b")).select("face_id", "b.*")


#: Landmarks made from a box: the eyes, the nose and the corners of the mouth at fixed shares of its sides.
_MARKS = ((0.3, 0.4), (0.7, 0.38), (0.5, 0.6), (0.35, 0.8), (0.65, 0.8))


def _landmarks(spark, folder):
    at = lambda fx, fy: F.array(F.col("x1") + fx * (F.col("x2") - F.col("x1")), F.col("y1") + fy * (F.col("y2") - F.col("y1")))
    return faces(spark, folder, *_BOX).where("x2 > x1 and y2 > y1").select("face_id", F.array(*[at(*m) for m in _MARKS]).alias("points"))


_EYES = f"""{FACE}, e AS (SELECT face_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, ((x1 + 3e-1 * (x2 - x1)) + (x1 + 7e-1 * (x2 - x1))) / 2 AS mx, ((y1 + 4e-1 * (y2 - y1)) + (y1 + 38e-2 * (y2 - y1))) / 2 AS my,
  sqrt((0.4 * (x2 - x1)) ** 2 + (0.02 * (y2 - y1)) ** 2) AS span FROM face WHERE x2 > x1 AND y2 > y1)"""


@R.add("b5_eye_span", f"WITH {_EYES} SELECT face_id, round(span, 3) AS span FROM e")
def b5(spark, folder):
    return _landmarks(spark, folder).select("face_id", F.round(geo.eye_span(F.col("points")), 3).alias("span"))


@R.add("b6_expanded_landmarks", f"WITH {_EYES} SELECT face_id, round(mx + ((x1 + 5e-1 * w) - mx) * 55e-2 + 1e-7, 2) AS nose_x, round(my + ((y1 + 6e-1 * h) - my) * 55e-2 + 1e-7, 2) AS nose_y, round(x1 + 3e-1 * w + 1e-7, 2) AS eye_x FROM e")
def b6(spark, folder):
    p = geo.expanded_landmarks(F.col("points"))
    return _landmarks(spark, folder).select("face_id", F.round(p[2][0] + 1e-7, 2).alias("nose_x"), F.round(p[2][1] + 1e-7, 2).alias("nose_y"), F.round(p[0][0] + 1e-7, 2).alias("eye_x"))


@R.add("b7_periocular_sides", f"""
WITH {FACE}, e AS (SELECT face_id, (x1 + 3e-1 * (x2 - x1)) AS ax, (y1 + 4e-1 * (y2 - y1)) AS ay, (x1 + 7e-1 * (x2 - x1)) AS bx, (y1 + 38e-2 * (y2 - y1)) AS byy FROM face WHERE x2 > x1 AND y2 > y1),
p AS (SELECT face_id, (ax + bx) / 2 AS mx, (ay + byy) / 2 AS my, sqrt((ax - bx) * (ax - bx) + (ay - byy) * (ay - byy)) * 55e-2 / 352e-1 AS per FROM e)
SELECT face_id, floor(mx - 56e0 * per) AS x1, floor(my - 516e-1 * per) AS y1, ceil(mx + 56e0 * per) AS x2, ceil(my + 604e-1 * per) AS y2 FROM p WHERE per > 0""")
def b7(spark, folder):
    """The four sides of the eye region, rounded outwards."""
    return _landmarks(spark, folder).select("face_id", geo.periocular_box(F.col("points")).alias("b")).where("b is not null").select("face_id", "b.*")


@R.add("sv_p9_large_eye_regions", f"WITH {_EYES}, p AS (SELECT face_id, ceil(mx + 56 * span * 0.55 / 35.2) - floor(mx - 56 * span * 0.55 / 35.2) AS w, ceil(my + 60.4 * span * 0.55 / 35.2) - floor(my - 51.6 * span * 0.55 / 35.2) AS h FROM e) SELECT face_id FROM p WHERE least(w, h) >= 24")
def p9(spark, folder):
    return _landmarks(spark, folder).where(geo.large_enough(geo.periocular_box(F.col("points")))).select("face_id")


_ELEMENTS = f"""{FACE}, u AS (SELECT library_id, cluster_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM face WHERE cluster_id >= 0 AND len(embedding) = 64 AND {OK.format('embedding')}),
m AS (SELECT library_id, cluster_id, pos, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT library_id, cluster_id, max(n) AS n, list(x ORDER BY pos) AS v FROM m GROUP BY ALL),
cen AS (SELECT library_id, cluster_id, n, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS centroid FROM c)"""


def _centroids(spark, folder, column="embedding"):
    f = faces(spark, folder, "library_id", "cluster_id", column).where("cluster_id >= 0")
    return clu.centroids(f.where(F.size(column) == 64), ["library_id", "cluster_id"], column)


_EYE_ELEMENTS = f"""eu AS (SELECT library_id, cluster_id, CAST(unnest(eye_embedding) AS DOUBLE) AS x, generate_subscripts(eye_embedding, 1) AS pos FROM face WHERE cluster_id >= 0 AND len(eye_embedding) = 64 AND {OK.format('eye_embedding')}),
em AS (SELECT library_id, cluster_id, pos, avg(x) AS x, count(*) AS n FROM eu GROUP BY ALL),
ec AS (SELECT library_id, cluster_id, max(n) AS eye_n, list(x ORDER BY pos) AS v FROM em GROUP BY ALL),
ecen AS (SELECT library_id, cluster_id, eye_n, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS eye FROM ec)"""


@R.add("a5_centroids", f"WITH {_ELEMENTS} SELECT library_id, cluster_id, n, {marks_sql('centroid')} FROM cen")
def a5(spark, folder):
    return _centroids(spark, folder).select("library_id", "cluster_id", "n", *marks(F.col("centroid")))


@R.add("a6_eye_centroids", f"""
WITH {FACE}, {_EYE_ELEMENTS} SELECT library_id, cluster_id, eye_n AS n, {marks_sql('eye')} FROM ecen""")
def a6(spark, folder):
    return _centroids(spark, folder, "eye_embedding").select("library_id", "cluster_id", "n", *marks(F.col("centroid")))


def _mean_sql(k: str, c: str) -> str:
    return f"""{k}u AS (SELECT cluster_id, len({c}) AS d, CAST(unnest({c}) AS DOUBLE) AS x, generate_subscripts({c}, 1) AS pos FROM big WHERE {OK.format(c)}),
{k}m AS (SELECT cluster_id, d, pos, avg(x) AS x, count(*) AS n FROM {k}u GROUP BY ALL), {k}v AS (SELECT cluster_id, d, max(n) AS n, list(x ORDER BY pos) AS v FROM {k}m GROUP BY ALL),
{k}w AS (SELECT cluster_id, arg_max(n, d) AS n, arg_max(v, d) AS v FROM {k}v GROUP BY cluster_id),
{k} AS (SELECT cluster_id, n, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM {k}w)"""


@R.add("d7_cluster_profiles", f"""
WITH {FACE}, big AS (SELECT * FROM face WHERE cluster_id IS NOT NULL),
n AS (SELECT cluster_id, count(*) AS size, count(DISTINCT image_path) AS photos, round(avg(CASE WHEN {OK.format('eye_embedding')} THEN 1.0 ELSE 0.0 END), 3) AS eye_coverage FROM big GROUP BY cluster_id),
{_mean_sql('whole', 'embedding')}, {_mean_sql('eye', 'eye_embedding')}
SELECT n.cluster_id, size, photos, eye_coverage, eye.n AS eye_faces, {marks_sql('whole.v')}, {marks_sql('eye.v').replace('mark_', 'eye_mark_')}
FROM n LEFT JOIN whole ON whole.cluster_id = n.cluster_id LEFT JOIN eye ON eye.cluster_id = n.cluster_id""")
def d7(spark, folder):
    p = clu.profiles(faces(spark, folder, "cluster_id", "image_path", "embedding", "eye_embedding"))
    return p.select("cluster_id", "size", "photos", F.round("eye_coverage", 3).alias("eye_coverage"), "eye_faces", *marks(F.col("centroid")), *marks(F.col("eye_centroid"), "eye_mark_1", "eye_mark_2"))


@R.add("sv_p3_large_clusters", f"WITH {FACE}, n AS (SELECT cluster_id FROM face WHERE cluster_id >= 0 GROUP BY 1 HAVING count(*) >= 10) SELECT face_id, CASE WHEN n.cluster_id IS NOT NULL THEN face.cluster_id END AS cluster_id FROM face LEFT JOIN n USING (cluster_id)")
def p3(spark, folder):
    """Every face; those of clusters of fewer than ten faces lose their cluster."""
    f = faces(spark, folder, "cluster_id")
    large = f.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("cluster_id", F.col("cluster_id").alias("kept"))
    return f.join(large, "cluster_id", "left").select("face_id", F.col("kept").alias("cluster_id"))


@R.add("v7_first_faces", f"WITH {FACE} SELECT cluster_id, rank, face_id FROM (SELECT cluster_id, face_id, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS rank FROM face WHERE cluster_id >= 0) WHERE rank <= 6")
def v7(spark, folder):
    """The first six faces of every cluster."""
    return clu.first_members(faces(spark, folder, "cluster_id").where("cluster_id >= 0"), "cluster_id", "face_id", ["face_id"], 6)


_MATCH = f"""{_ELEMENTS}, {_EYE_ELEMENTS},
both_cen AS (SELECT c.library_id, c.cluster_id, c.centroid, e.eye FROM cen c LEFT JOIN ecen e USING (library_id, cluster_id)),
parts AS (SELECT c.library_id, c.cluster_id, p.person_name, 1 - list_cosine_similarity(c.centroid, CAST(p.embedding AS DOUBLE[])) AS full_distance,
  CASE WHEN c.eye IS NOT NULL AND len(p.eye_embedding) = 64 AND {OK.format('p.eye_embedding')} THEN 1 - list_cosine_similarity(c.eye, CAST(p.eye_embedding AS DOUBLE[])) END AS eye_distance
  FROM both_cen c JOIN persons p ON c.library_id = p.library_id AND len(p.embedding) = 64 WHERE {OK.format('p.embedding')}),
cand AS (SELECT *, coalesce(0.4 * full_distance + 0.6 * eye_distance, full_distance) AS distance FROM parts),
near AS (SELECT * FROM cand WHERE distance <= 0.5)"""
_NAME_KEY = "translate(person_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _queries(spark, folder, key="query_id"):
    """The clusters with both their centroids."""
    c = _centroids(spark, folder).select("library_id", "cluster_id", F.col("centroid").alias("full"))
    e = _centroids(spark, folder, "eye_embedding").select("library_id", "cluster_id", F.col("centroid").alias("eye"))
    return c.join(e, ["library_id", "cluster_id"], "left").withColumnRenamed("cluster_id", key)


def _near(spark, folder):
    return identity.candidates(_queries(spark, folder), table(spark, folder, "persons"), 0.5, ["library_id"])


_RATED_SQL = "eye_distance IS NOT NULL AS used_eye, round(distance, 4) AS distance, round(full_distance, 4) AS full_distance, round(eye_distance, 4) AS eye_distance"


def _rated() -> list:
    return ["used_eye", *[F.round(c, 4).alias(c) for c in ("distance", "full_distance", "eye_distance")]]


@R.add("i1_best_match", f"WITH {_MATCH}, r AS (SELECT *, row_number() OVER (PARTITION BY library_id, cluster_id ORDER BY distance, {_NAME_KEY}) AS rank FROM near) SELECT library_id, cluster_id, person_name, {_RATED_SQL} FROM r WHERE rank = 1")
def i1(spark, folder):
    """The known person of the library that each cluster is closest to by both signals, within tolerance."""
    best = identity.best_match(_near(spark, folder), ["query_id", "library_id"])
    return best.select("library_id", F.col("query_id").alias("cluster_id"), "person_name", *_rated())


@R.add("j3_candidates", f"WITH {_MATCH} SELECT library_id, cluster_id, person_name, {_RATED_SQL} FROM near")
def j3(spark, folder):
    return _near(spark, folder).select("library_id", F.col("query_id").alias("cluster_id"), "person_name", *_rated())


@R.add("w6_match_and_runner_up", f"""
WITH {_MATCH}, r AS (SELECT library_id, cluster_id, person_name, round(distance, 4) AS distance, row_number() OVER (PARTITION BY library_id, cluster_id ORDER BY distance, translate(person_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS rank FROM near)
SELECT library_id, cluster_id, rank, person_name, distance FROM r WHERE rank <= 2""")
def w6(spark, folder):
    two = identity.with_runner_up(_near(spark, folder), ["query_id", "library_id"])
    return two.select("library_id", F.col("query_id").alias("cluster_id"), "rank", "person_name", F.round("distance", 4).alias("distance"))


@R.add("i4_auto_labels", f"""
WITH {_MATCH}, best AS (SELECT library_id, cluster_id, arg_min(person_name, (distance, translate(person_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS label FROM near GROUP BY ALL)
SELECT library_id, cluster_id, label FROM cen LEFT JOIN best USING (library_id, cluster_id)""")
def i4(spark, folder):
    """Every cluster with its match's name, or null."""
    return identity.auto_labels(_queries(spark, folder, "cluster_id"), table(spark, folder, "persons"), 0.5, ["library_id"]).select("library_id", "cluster_id", "label")


@R.add("i5_fused_clusters", f"""
WITH {FACE}, l AS (SELECT cluster_id, min(person_name) AS label FROM face WHERE cluster_id >= 0 GROUP BY 1),
k AS (SELECT cluster_id, label, CASE WHEN label IS NULL THEN cluster_id ELSE min(cluster_id) OVER (PARTITION BY label) END AS leader FROM l)
SELECT cluster_id, CAST(dense_rank() OVER (ORDER BY leader) - 1 AS BIGINT) AS new_id, label FROM k""")
def i5(spark, folder):
    """Clusters with the same name as one, numbered anew."""
    labels = faces(spark, folder, "cluster_id", "person_name").where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("person_name").alias("label"))
    return identity.fused_clusters(labels)


@R.add("i6_merged_clusters", f"""
WITH {FACE}, l AS (SELECT DISTINCT cluster_id FROM face WHERE cluster_id >= 0),
t AS (SELECT min(cluster_id) AS a, max(cluster_id) AS b FROM l)
SELECT cluster_id, CAST(dense_rank() OVER (ORDER BY CASE WHEN cluster_id = t.b THEN t.a ELSE cluster_id END) - 1 AS BIGINT) AS new_id FROM l, t""")
def i6(spark, folder):
    """The first and the last cluster as one."""
    ids = faces(spark, folder, "cluster_id").where("cluster_id >= 0").select("cluster_id").distinct()
    ends = ids.agg(F.min("cluster_id").alias("a"), F.max("cluster_id").alias("b")).first()
    return identity.merged_clusters(ids, ends.b, ends.a)


@R.add("i7_split_cluster", f"""
WITH {FACE}, n AS (SELECT cluster_id FROM face WHERE cluster_id >= 0 GROUP BY 1 ORDER BY count(*) DESC, cluster_id LIMIT 1), m AS (SELECT max(cluster_id) AS m FROM face),
o AS (SELECT face_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS r FROM face)
SELECT face_id, CASE WHEN cluster_id = (SELECT cluster_id FROM n) AND r IN (1, 3) THEN (SELECT m FROM m) + 1 ELSE cluster_id END AS cluster_id FROM o""")
def i7(spark, folder):
    """Two faces of the largest cluster in one of their own."""
    f = faces(spark, folder, "cluster_id")
    largest = f.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").first()
    return identity.split_cluster(f, largest.cluster_id, [1, 3, 3]).select("face_id", "cluster_id")


_CLEAN = "CASE WHEN lower(trim(name)) IN ('', 'skip', 'unknown') THEN NULL ELSE trim(name) END"


@R.add("v4_clusters_by_size", f"WITH {FACE} SELECT cluster_id, count(*) AS size FROM face WHERE cluster_id >= 0 GROUP BY 1 ORDER BY size DESC, cluster_id")
def v4(spark, folder):
    c = faces(spark, folder, "cluster_id").where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return c.orderBy(*views.cluster_order("size"))


_CARDS = f"{FACE}, c AS (SELECT cluster_id, min(person_name) AS name, count(*) AS size, count(DISTINCT image_path) AS photos FROM face WHERE cluster_id >= 0 GROUP BY 1)"


def _cards(spark, folder):
    f = faces(spark, folder, "cluster_id", "person_name", "image_path").where("cluster_id >= 0")
    return f.groupBy("cluster_id").agg(F.min("person_name").alias("name"), F.count(F.lit(1)).alias("size"), F.count_distinct("image_path").alias("photos"))


@R.add("v3_clusters_filter", f"WITH {_CARDS} SELECT cluster_id, name FROM c WHERE contains(lower(coalesce(name, '')), 'an') OR contains('group ' || (cluster_id + 1), 'an')")
def v3(spark, folder):
    return views.clusters_matching(_cards(spark, folder), "an").select("cluster_id", "name")


@R.add("v9_named_and_unnamed", f"WITH {_CARDS} SELECT count(*) AS clusters, count(name) AS named, count(*) - count(name) AS unnamed, CAST(sum(photos) AS BIGINT) AS photos FROM c")
def v9(spark, folder):
    return views.named_and_not(_cards(spark, folder))


@R.add("a11_status_counts", f"WITH {_CARDS} SELECT count(name) AS named, count(*) - count(name) AS unnamed FROM c")
def a11(spark, folder):
    return views.named_and_not(_cards(spark, folder)).select("named", "unnamed")


@R.add("a16_photos_of_clusters", f"WITH {_CARDS} SELECT cluster_id, photos FROM c")
def a16(spark, folder):
    return _cards(spark, folder).select("cluster_id", "photos")


@R.add("t4_first_face_of_photo", f"WITH {FACE} SELECT cluster_id, image_path, min(face_id) AS first_face FROM face WHERE cluster_id >= 0 GROUP BY ALL")
def t4(spark, folder):
    """Distinct photos of a cluster, in the order of their first face."""
    f = faces(spark, folder, "cluster_id", "image_path").where("cluster_id >= 0")
    return f.groupBy("cluster_id", "image_path").agg(F.min("face_id").alias("first_face"))


@R.add("a15_dominant_name", f"""
WITH {FACE}, n AS (SELECT cluster_id, person_name, count(*) AS c, min(face_id) AS seen FROM face WHERE cluster_id >= 0 AND person_name IS NOT NULL GROUP BY ALL)
SELECT cluster_id, arg_max(person_name, (c, -seen)) AS person_name FROM n GROUP BY cluster_id""")
def a15(spark, folder):
    """The most frequent name of each cluster, of equals the one seen first."""
    f = faces(spark, folder, "cluster_id", "person_name").where("cluster_id >= 0 and person_name is not null")
    n = f.groupBy("cluster_id", "person_name").agg(F.count(F.lit(1)).alias("c"), F.min("face_id").alias("seen"))
    return n.groupBy("cluster_id").agg(F.max_by("person_name", F.struct("c", (-F.col("seen")).alias("s"))).alias("person_name"))


@R.add("k8_montage_grid", f"WITH {_CARDS} SELECT cluster_id, CAST(least(5, ceil(sqrt(least(size, 36)))) AS INTEGER) AS columns, greatest(size - 36, 0) AS more FROM c")
def k8(spark, folder):
    """Columns of a cluster's montage of 36 faces at most, and how many are left out."""
    shown = F.least("size", F.lit(36))
    return _cards(spark, folder).select("cluster_id", geo.grid_columns(shown).alias("columns"), F.greatest(F.col("size") - 36, F.lit(0)).alias("more"))


_D6 = f"""{_nms_sql(f"({_IOU} >= 0.5 OR {_NEAR})").replace(chr(10) + "SELECT face_id FROM stay", ", once AS (SELECT face_id FROM stay")}),
size_of AS (SELECT len(eye_embedding) AS d FROM face JOIN once USING (face_id) WHERE {OK.format('embedding')} AND {OK.format('eye_embedding')} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT face_id AS id, library_id AS lib, CAST(embedding AS DOUBLE[]) AS full, CASE WHEN {OK.format('eye_embedding')} AND len(eye_embedding) = (SELECT d FROM size_of) THEN CAST(eye_embedding AS DOUBLE[]) END AS eye,
  {OK.format('eye_embedding')} IS TRUE AS seen FROM face JOIN once USING (face_id) WHERE {OK.format('embedding')} AND library_id IS NOT NULL),
counts AS (SELECT lib, count(*) AS n, count(*) FILTER (seen) AS eyes FROM f GROUP BY lib),
fe AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.lib = b.lib AND a.id < b.id AND len(a.full) = len(b.full) WHERE {DIST_FULL} <= 0.2),
ee AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.lib = b.lib AND a.id < b.id AND len(a.full) = len(b.full) WHERE a.seen AND b.seen AND {DIST_FUSED} <= 0.2),
{components_sql('eg', 'ee', 'SELECT id FROM f WHERE seen')}, {components_sql('fl', 'fe')},
j AS (SELECT f.id, f.lib, fl.label AS fl, CASE WHEN c.eyes >= 2 THEN g.label END AS g, c.eyes = c.n AND c.eyes >= 2 AS every, CAST(f.seen AS DOUBLE) AS cov FROM f JOIN fl USING (id) JOIN counts c USING (lib) LEFT JOIN eg g USING (id)),
hits AS (SELECT g, fl, count(*) AS h FROM j WHERE g IS NOT NULL GROUP BY g, fl), top AS (SELECT g, max(h) AS h FROM hits GROUP BY g),
kept AS (SELECT j.g FROM j JOIN top USING (g) GROUP BY j.g HAVING any_value(top.h) / count(*) >= 0.6 OR (avg(cov) >= 0.999 AND any_value(top.h) / count(*) >= 0.4)),
lab AS (SELECT id, lib, CASE WHEN every THEN 'e' || g WHEN k.g IS NOT NULL THEN 'e' || k.g ELSE 'f' || fl END AS label FROM j LEFT JOIN kept k USING (g)),
num AS (SELECT lib, label, row_number() OVER (PARTITION BY lib ORDER BY min(id)) - 1 AS cluster_id FROM lab GROUP BY lib, label HAVING count(*) >= 2)
SELECT id AS face_id, CAST(lib AS INTEGER) AS library_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM lab JOIN num USING (lib, label)"""


@R.add("d6_cluster_faces", _D6)
def d6(spark, folder):
    """The whole way from detections to the numbered clusters of each library."""
    f = faces(spark, folder, "library_id", *_BOX, "embedding", "eye_embedding")
    return clu.cluster_faces(f, tolerance=0.2, scope="library_id").select("face_id", "library_id", "cluster_id")


@R.add("w5_progress", "SELECT image_path, row_number() OVER (ORDER BY image_path) AS done, count(*) OVER () AS total FROM images")
def w5(spark, folder):
    """A running number over all images and their total, by range partitions."""
    images = table(spark, folder, "images").select("image_path")
    numbered = clu._dense(images, "image_path")
    total = images.agg(F.count(F.lit(1)).alias("total"))
    return numbered.select("image_path", (F.col("position") + 1).alias("done")).join(F.broadcast(total))
