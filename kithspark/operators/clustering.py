"""From detections to clusters of faces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kithspark.functions.geometry import box, centre, diagonal, same_face
from kithspark.functions.vectors import finite, unit, usable
from kithspark.operators.graph import Metric, close_pairs, density_clusters
from kithspark.schemas import AGREEMENT, COVERED_AGREEMENT, EYE_WEIGHT, FULL_COVERAGE, FULL_WEIGHT, IOU, MIN_EYE_FACES, MIN_FACES, NOISE, PROXIMITY, TOLERANCE
from kithspark.session import Scratch


def deduplicated(faces: DataFrame, image: str = "image_path", order: list[str] = ["face_id"], overlap: float = IOU, proximity: float | None = PROXIMITY) -> DataFrame:  # noqa: B006
    """Boxes of an image without those that show the same face as one with a higher score.

    Best score first, a box stays unless it shows the same face as one that
    stayed; ties go by ``order``. ``proximity`` None compares overlap only. Null
    and NaN scores come last, boxes with a null side and rows without an image
    always stay. An image's boxes are first cut into islands that can't touch,
    by a running maximum, so only an island's boxes come together in one array.
    """
    columns = faces.columns
    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    whole = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull() & F.col(image).isNotNull()
    b = box(*sides)
    reach = (proximity or 0.0) * diagonal(b)
    boxed = faces.where(whole).withColumn("__lo", F.least(b["x1"], centre(b)[0] - reach)).withColumn("__hi", F.greatest(b["x2"], centre(b)[0] + reach))
    along = Window.partitionBy(image).orderBy("__lo", *order)
    before = F.max("__hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("__lo") <= before, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))
    entry = F.struct((-score).alias("s"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], b.alias("b"), F.struct(*columns).alias("row"))
    # Rows may hold columns that can't be ordered, such as maps, so only the keys are sorted.
    grouped = boxed.withColumn("__island", island).groupBy(image, "__island").agg(F.collect_list(entry).alias("e"))
    compare = lambda x, y: _compare(x, y, ["s", *[f"o{i}" for i in range(len(order))]])
    ordered = grouped.withColumn("e", F.array_sort("e", compare))
    kept = F.aggregate("e", F.slice("e", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: same_face(k["b"], x["b"], overlap, proximity)), kept).otherwise(F.concat(kept, F.array(x))))
    stay = ordered.select(F.explode(kept).alias("k")).select("k.row.*")
    return stay.unionByName(faces.where(~whole))


def _compare(x, y, keys: list[str]):
    out = F.lit(0)
    for k in reversed(keys):
        out = F.when(x[k] < y[k], -1).when(x[k] > y[k], 1).otherwise(out)
    return out


def _numbered(labels: DataFrame, keep: int, scope: str | None = None) -> DataFrame:
    """(id, cluster_id): clusters of at least ``keep`` faces, numbered from 0 by their smallest id, in each scope anew.

    The numbers go over the table of clusters, not of faces. Faces of smaller
    clusters have none and are left out.
    """
    inside = [scope] if scope else []
    sizes = labels.groupBy(*inside, "label").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= keep)
    numbered = _dense(sizes.withColumn("__at", F.struct(*inside, "first")), "__at").select(*inside, "label", F.col("position").alias("cluster_id"))
    if scope:
        begin = numbered.groupBy(scope).agg(F.min("cluster_id").alias("begin"))
        numbered = numbered.join(begin, scope).select(scope, "label", (F.col("cluster_id") - F.col("begin")).alias("cluster_id"))
    return labels.join(numbered, [*inside, "label"]).select("id", *inside, "cluster_id")


def _dense(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``position`` from 0 in the order of the unique column ``by``.

    Counts of range partitions give each partition its start, so no task sees all
    rows.
    """
    parts = Scratch(rows.sparkSession, "order").keep(rows.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("low"))
    starts = counts.withColumn("start", F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("start", F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(by)) - 1
    return parts.join(F.broadcast(starts), "__p").withColumn("position", (F.col("start") + inside).cast("bigint")).drop("__p", "start")


def reconciled(faces: DataFrame, eye_groups: DataFrame, full_labels: DataFrame) -> DataFrame:
    """(id, label): groups by the eye region where the whole faces agree, else by whole-face label.

    ``faces`` is (id, coverage), ``eye_groups`` (id, eye_group) for the faces with
    an eye vector, ``full_labels`` (id, full_label), -1 for noise. An eye group is
    kept if its most frequent whole-face label holds at least 60 % of it, or 40 %
    where every member has an eye vector; of equally frequent labels the one seen
    first counts. Kept groups come first, by agreement, then by their first face;
    the other faces follow by whole-face label, noise one by one.
    """
    joined = full_labels.join(eye_groups, "id", "left").join(faces.select("id", "coverage"), "id")
    grouped = joined.where("eye_group is not null")
    counts = grouped.where(F.col("full_label") != NOISE).groupBy("eye_group", "full_label").agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("seen"))
    most = counts.groupBy("eye_group").agg(F.max(F.struct("hits", (-F.col("seen")).alias("s"))).alias("m"))
    size = grouped.groupBy("eye_group").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("coverage"), F.min("id").alias("first"))
    rated = size.join(most, "eye_group").withColumn("agreement", F.col("m.hits") / F.col("n"))
    kept = rated.where((F.col("agreement") >= AGREEMENT) | ((F.col("coverage") >= FULL_COVERAGE) & (F.col("agreement") >= COVERED_AGREEMENT))).select("eye_group", "agreement", "first")
    placed = joined.join(kept, "eye_group", "left")
    kind, noise = F.col("agreement").isNotNull(), F.col("full_label") == NOISE
    first = F.when(kind, 0).when(noise, 2).otherwise(1)
    second = F.when(kind, -F.col("agreement")).when(noise, 0.0).otherwise(F.col("full_label").cast("double"))
    third = F.when(kind, F.col("first")).when(noise, F.col("id")).otherwise(0)
    place = F.struct(first.alias("k"), second.alias("x"), third.alias("y"))
    keyed = placed.select("id", place.alias("place"))
    numbered = _dense(keyed.select("place").distinct(), "place")
    return keyed.join(numbered, "place").select("id", F.col("position").alias("label"))


def face_labels(faces: DataFrame, tolerance: float = TOLERANCE, min_samples: int = 1, use_eyes: bool = True, weights: tuple[float, float] = (FULL_WEIGHT, EYE_WEIGHT), scope: str | None = None, metric: Metric | None = None) -> DataFrame:
    """(id, label) for usable faces (id, full, eye[, scope]): by whole faces, by both signals, or reconciled.

    With fewer than two eye vectors whole faces decide; with an eye vector for
    every face one pass over both does; otherwise the faces with eyes are grouped
    by both, all faces by the whole face, and the two are reconciled. With a
    ``scope`` column each scope is decided and clustered by itself; the labels of
    different scopes differ. Rows of a null scope are left out.
    """
    check_tolerance(tolerance)
    inside = F.col(scope) if scope else F.lit(0)
    faces = Scratch(faces.sparkSession, "faces").keep(faces.select("id", inside.alias("scope"), "full", F.when(usable(F.col("eye")), F.col("eye")).alias("eye")).where("scope is not null"))
    pairs = lambda rows, **eye: close_pairs(rows, tolerance, weights=weights, scope="scope", metric=metric, **eye)
    whole = lambda rows: density_clusters(rows, pairs(rows), min_samples)
    if not use_eyes:
        return whole(faces)
    counts = faces.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count("eye").alias("eyes"))
    kind = F.when(F.col("eyes") < MIN_EYE_FACES, "whole").when(F.col("eyes") == F.col("n"), "both").otherwise("mixed")
    kinds = {r.kind for r in counts.select(kind.alias("kind")).distinct().collect()}  # three at most
    if kinds <= {"whole"}:
        return whole(faces)
    rated = faces.join(counts.select("scope", kind.alias("kind")), "scope")
    with_eyes = rated.where("eye is not null and kind <> 'whole'")
    by_both = density_clusters(with_eyes, pairs(with_eyes, eye="eye"), min_samples)
    if kinds == {"both"}:
        return by_both
    # A noise face is a group of its own.
    alone = by_both.select("id", F.when(F.col("label") == NOISE, F.col("id")).otherwise(F.col("label")).alias("eye_group"))
    rest = rated.where("kind <> 'both'")
    mixed = rest.select("id", F.col("eye").isNotNull().cast("double").alias("coverage"))
    settled = reconciled(mixed, alone.join(mixed.select("id"), "id", "left_semi"), whole(rest).withColumnRenamed("label", "full_label"))
    if "both" not in kinds:
        return settled
    # Labels of scopes that need no reconciling are put apart from the others'.
    return settled.unionByName(by_both.join(rated.where("kind = 'both'").select("id"), "id", "left_semi").select("id", F.when(F.col("label") == NOISE, F.lit(NOISE)).otherwise(-2 - F.col("label")).alias("label")))


def cluster_faces(faces: DataFrame, tolerance: float = TOLERANCE, min_faces: int = MIN_FACES, min_samples: int = 1, use_eyes: bool = True, weights: tuple[float, float] = (FULL_WEIGHT, EYE_WEIGHT), deduplicate: bool = True, scope: str | None = None, metric: Metric | None = None) -> DataFrame:
    """(face_id[, scope], cluster_id) of every face in a cluster of at least ``min_faces``.

    Double boxes go first, then faces without a usable vector; the rest are
    labelled by ``face_labels`` and clusters numbered from 0 by their first face.
    The order of faces is that of their ids. With a ``scope``, such as a library,
    each scope is a collection of its own: its faces meet no others, and its
    clusters are numbered from 0. An empty table gives no row.
    """
    rows = deduplicated(faces) if deduplicate else faces
    inside = [scope] if scope else []
    good = rows.where(usable(F.col("embedding"))).select(F.col("face_id").alias("id"), *inside, F.col("embedding").alias("full"), F.col("eye_embedding").alias("eye"))
    labels = face_labels(good, tolerance, min_samples, use_eyes, weights, scope, metric)
    single = labels.withColumn("label", F.when(F.col("label") == NOISE, F.lit(-(1 << 62)) - F.col("id")).otherwise(F.col("label")))
    if scope:
        single = single.join(good.select("id", scope), "id")
    return _numbered(single, min_faces, scope).withColumnRenamed("id", "face_id")


def check_vectors(rows: DataFrame, vector: str) -> int:
    """The length of all vectors of a table, 0 for an empty one; vectors that are null, not finite or of several lengths are an error."""
    v = F.col(vector)
    seen = rows.agg(F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.count_if(~F.coalesce(finite(v) & (F.size(v) > 0), F.lit(False))).alias("bad")).first()
    if seen.low is None:
        return 0
    if seen.bad or seen.low != seen.high:
        raise ValueError("the vectors must be finite and of one length")
    return seen.low


def check_tolerance(tolerance: float) -> None:
    if not 0 < tolerance <= 2:
        raise ValueError("tolerance must be above 0 and at most 2")


def _summed(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """(key struct, d, n, v) with n and v, vectors of length d, summed for each key and length."""
    for d in np.unique(t.column("d").to_numpy()):
        part = t.filter(pa.array(t.column("d").to_numpy() == d)).combine_chunks()
        key = part.column("key").combine_chunks()
        x = part.column("v").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        fields = {f"k{i}": c for i, c in enumerate(key.flatten())}
        groups = pa.table(fields | {"row": np.arange(part.num_rows)}).group_by(list(fields), use_threads=False).aggregate([("row", "list"), ("row", "min")])
        rows = groups.column("row_list").combine_chunks()
        begin, order = rows.offsets.to_numpy()[:-1] - rows.offsets[0].as_py(), rows.flatten().to_numpy()
        total, n = np.add.reduceat(x[order], begin, axis=0), np.add.reduceat(part.column("n").to_numpy()[order], begin)
        v = pa.ListArray.from_arrays(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([key.take(groups.column("row_min").combine_chunks()), pa.array(np.full(len(n), d, np.int32)), pa.array(n), v], ["key", "d", "n", "v"])


def centroids(faces: DataFrame, key: str | list[str], vector: str, out: str = "centroid") -> DataFrame:
    """(key, n, out): the mean of each group's usable vectors, scaled to length one; a zero mean stays as it is.

    Each batch of rows is summed group by group in arrays before anything moves, and
    what is left of a group, one row for a batch, is summed where its key belongs, so
    a group of any size is no load. Vectors that are not as long as the group's
    longest are left out of its mean.
    """
    keys = [key] if isinstance(key, str) else key
    rows = faces.where(usable(F.col(vector))).select(F.struct(*keys).alias("key"), F.size(vector).alias("d"), F.lit(1).cast("bigint").alias("n"), F.transform(vector, lambda x: x.cast("double")).alias("v"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _summed(pa.Table.from_batches([b]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [b for b in batches if b.num_rows]:
            yield from _summed(pa.Table.from_batches(got))

    kind = T.StructType([rows.schema["key"], T.StructField("d", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    vectors = rows.mapInArrow(each, kind).repartition("key").mapInArrow(whole, kind).withColumn("v", F.transform("v", lambda x: x / F.col("n")))
    longest = vectors.groupBy("key").agg(F.max_by(F.struct("n", "v"), "d").alias("best"))
    return longest.select("key.*", F.col("best.n").alias("n"), F.coalesce(unit(F.col("best.v")), F.col("best.v")).alias(out))


def profiles(faces: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Size, photos, eye coverage and both centroids of each cluster; faces without a cluster don't count."""
    rows = faces.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.count_distinct("image_path").alias("photos"), F.avg(usable(F.col("eye_embedding")).cast("double")).alias("eye_coverage"))
    full = centroids(rows, key, "embedding").drop("n")
    eye = centroids(rows, key, "eye_embedding", "eye_centroid").withColumnRenamed("n", "eye_faces")
    return counts.join(full, key, "left").join(eye, key, "left")


def first_members(faces: DataFrame, key: str, item: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` items of each group in ``order``, ranked; a heavy group is cut before its rows move."""
    w = Window.partitionBy(key).orderBy(*order)
    return faces.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(key, "rank", item)
