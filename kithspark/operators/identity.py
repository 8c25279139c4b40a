"""Known people: matching clusters with them, and keeping them up to date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kithspark.functions.text import folder_name, merged_samples, name_key, stripped
from kithspark.functions.vectors import dot, norm, unit, usable, validate_weights
from kithspark.operators.clustering import _dense, check_tolerance
from kithspark.operators.relations import _key
from kithspark.schemas import EYE_WEIGHT, FULL_WEIGHT, MAX_SAMPLES, PERSONS, TOLERANCE
from kithspark.session import BROADCAST_ROWS


def decoded(persons: DataFrame) -> DataFrame:
    """Persons with null in place of vectors that can't be used."""
    good = lambda c: F.when(usable(F.col(c)), F.col(c)).alias(c)
    return persons.select(*[good(c) if c in ("embedding", "eye_embedding") else F.col(c) for c in persons.columns])


def person_named(persons: DataFrame, name: str) -> DataFrame:
    return persons.where(name_key(F.col("person_name")) == name_key(F.lit(name)))


def without_person(persons: DataFrame, name: str) -> DataFrame:
    return persons.where(~F.coalesce(name_key(F.col("person_name")) == name_key(F.lit(name)), F.lit(False)))


def candidates(queries: DataFrame, persons: DataFrame, tolerance: float = TOLERANCE, scope: list[str] = [], weights: tuple[float, float] = (FULL_WEIGHT, EYE_WEIGHT)) -> DataFrame:  # noqa: B006
    """(query_id, *scope, person_name, distance, used_eye): persons within ``tolerance`` of each query.

    ``queries`` is (query_id, *scope, full, eye). The whole-face vectors must be
    equally long; eye vectors count where both are usable and equally long. With
    a ``scope`` only people of the same scope meet, through an equi-join.
    Without one every person meets every query: persons are broadcast if there are
    at most BROADCAST_ROWS of them (they are counted), else they are dealt into
    blocks, and every query goes to each block.
    """
    check_tolerance(tolerance)
    wf, we = validate_weights(*weights)
    # Unit vectors are made once for each side, so a pair costs two products.
    side = lambda df, key, full, eye, n: df.where(usable(F.col(full))).select(key, *scope, unit(F.col(full)).alias(f"{n}f"), unit(F.col(eye)).alias(f"{n}e"))
    q, p = side(queries, "query_id", "full", "eye", "q"), side(persons, "person_name", "embedding", "eye_embedding", "p")
    on = F.size("qf") == F.size("pf")
    if scope:
        near = q.join(p, scope).where(on)
    elif (n := persons.count()) <= BROADCAST_ROWS:
        near = q.join(F.broadcast(p), on)
    else:
        blocks = math.ceil(n / BROADCAST_ROWS)
        each = q.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        near = each.join(p.withColumn("__b", F.pmod(F.xxhash64("person_name"), F.lit(blocks)).cast("int")), "__b").where(on)
    both = F.coalesce(F.size("qe") == F.size("pe"), F.lit(False)) & F.col("qe").isNotNull() & F.col("pe").isNotNull()
    rated = near.select("query_id", *scope, "person_name", both.alias("used_eye"), (1 - dot(F.col("qf"), F.col("pf"))).alias("full_distance"), F.when(both, 1 - dot(F.col("qe"), F.col("pe"))).alias("eye_distance"))
    distance = F.coalesce(F.lit(wf) * F.col("full_distance") + F.lit(we) * F.col("eye_distance"), F.col("full_distance"))
    return rated.withColumn("distance", distance).where(F.col("distance") <= tolerance)


def best_match(found: DataFrame, keys: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """The closest candidate of each query; ties go to the smaller name."""
    columns = [c for c in found.columns if c not in keys]
    best = found.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("distance", name_key(F.col("person_name")))).alias("m"))
    return best.select(*keys, "m.*")


def with_runner_up(found: DataFrame, keys: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """The two closest candidates of each query, ranked."""
    w = Window.partitionBy(*keys).orderBy("distance", name_key(F.col("person_name")))
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select(*keys, "rank", "person_name", "distance")


def auto_labels(clusters: DataFrame, persons: DataFrame, tolerance: float = TOLERANCE, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Every cluster (cluster_id, *scope, full, eye) with the name of its match, or null."""
    found = best_match(candidates(clusters.withColumnRenamed("cluster_id", "query_id"), persons, tolerance, scope), ["query_id", *scope])
    names = found.select(F.col("query_id").alias("cluster_id"), *scope, F.col("person_name").alias("label"))
    return clusters.select("cluster_id", *scope).join(names, ["cluster_id", *scope], "left")


def fused_clusters(labels: DataFrame) -> DataFrame:
    """(cluster_id, new_id, label): clusters with the same label become one, numbered from 0 by first member."""
    first = labels.where("label is not null").groupBy("label").agg(F.min("cluster_id").alias("first"))
    keyed = labels.join(first, "label", "left").withColumn("leader", F.coalesce("first", "cluster_id"))
    return _renumbered(keyed).select("cluster_id", "new_id", "label")


def _renumbered(rows: DataFrame) -> DataFrame:
    numbers = _dense(rows.select("leader").distinct(), "leader").select("leader", F.col("position").alias("new_id"))
    return rows.join(numbers, "leader")


def merged_clusters(clusters: DataFrame, keep: int, other: int) -> DataFrame:
    """(cluster_id, new_id): two clusters as one, numbered from 0; names stay with their faces.

    Unknown ids and a cluster with itself are errors.
    """
    if keep == other:
        raise ValueError("a cluster can't be merged with itself")
    if clusters.where(F.col("cluster_id").isin(keep, other)).select("cluster_id").distinct().count() < 2:
        raise ValueError("no such cluster")
    leader = F.when(F.col("cluster_id").isin(keep, other), min(keep, other)).otherwise(F.col("cluster_id"))
    return _renumbered(clusters.select("cluster_id").distinct().withColumn("leader", leader)).select("cluster_id", "new_id")


def split_cluster(faces: DataFrame, cluster: int, positions: list[int], order: list[str] = ["face_id"]) -> DataFrame:  # noqa: B006
    """``faces`` with those at the 1-based ``positions`` of a cluster in a new one; at least one must stay and one go."""
    inside = F.col("cluster_id") == cluster
    size = faces.where(inside).count()
    chosen = {p for p in positions if 1 <= p <= size}
    if not chosen or len(chosen) >= size:
        raise ValueError("a split takes at least one face and leaves one")
    new = faces.agg(F.max("cluster_id")).first()[0] + 1
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    moved = faces.where(inside).withColumn("__at", place).withColumn("cluster_id", F.when(F.col("__at").isin(*chosen), F.lit(new)).otherwise(F.col("cluster_id")).cast(faces.schema["cluster_id"].dataType)).drop("__at")
    return faces.where(~F.coalesce(inside, F.lit(False))).unionByName(moved)


def named_clusters(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster_id, name) after (cluster_id, typed) was entered: cleaned, null for skip words; others as they were."""
    typed = names.select("cluster_id", folder_name(F.col("typed")).alias("typed"), F.lit(True).alias("entered"))
    return labels.join(typed, "cluster_id", "left").select("cluster_id", F.when(F.col("entered"), F.col("typed")).otherwise(F.col("name")).alias("name"))


def _blend(old: Column, old_n: Column, new: Column, new_n: Column) -> Column:
    """The mean of two vectors weighted by their faces, at length one."""
    summed = F.zip_with(old, new, lambda x, y: x.cast("double") * old_n + y.cast("double") * new_n)
    return F.transform(summed, lambda x: x / norm(summed))


def upserted(persons: DataFrame, batch: DataFrame, now: Column, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Persons after a batch: new names are added, known ones blended by their numbers of faces.

    ``batch`` has the columns of persons without the times, one row for each name
    of the batch. A vector of another length replaces the old one; a batch
    without an eye vector leaves the old one as it is. The spelling is the
    batch's, sample paths are merged. Rows of the batch without a name or a
    usable vector change nothing.
    """
    old = persons.select(*[F.col(c).alias(f"o_{c}") for c in persons.columns], name_key(F.col("person_name")).alias("k"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)])
    b = batch.where((stripped(F.col("person_name")) != "") & usable(F.col("embedding")))
    faces = F.greatest(F.lit(1), F.coalesce("faces_seen", F.lit(1)))
    eye = F.when(usable(F.col("eye_embedding")), unit(F.col("eye_embedding")))
    b = b.select(stripped(F.col("person_name")).alias("n_name"), unit(F.col("embedding")).alias("n_full"), faces.alias("n_faces"), eye.alias("n_eye"), F.when(eye.isNull(), 0).otherwise(F.greatest(F.lit(1), F.coalesce("eye_faces_seen", F.lit(1)))).alias("n_eyes"), F.col("sample_image_paths").alias("n_samples"), name_key(stripped(F.col("person_name"))).alias("k"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)])
    j = old.join(b, ["k", *[f"s{i}" for i in range(len(scope))]], "full_outer")
    is_new, same = F.col("o_person_name").isNull(), F.col("n_name").isNull()
    old_faces = F.greatest(F.lit(1), F.coalesce("o_faces_seen", F.lit(1)))
    old_eyes = F.greatest(F.lit(0), F.coalesce("o_eye_faces_seen", F.lit(0)))
    old_eye = F.when(usable(F.col("o_eye_embedding")), F.col("o_eye_embedding"))
    match_full = F.coalesce(usable(F.col("o_embedding")) & (F.size("o_embedding") == F.size("n_full")), F.lit(False))
    match_eye = F.coalesce(F.size(old_eye) == F.size("n_eye"), F.lit(False))
    floats = lambda c: c.cast("array<float>")
    values = {
        "person_name": F.coalesce("n_name", "o_person_name"),
        "embedding": F.when(same, F.col("o_embedding")).when(match_full, floats(_blend(F.col("o_embedding"), old_faces, F.col("n_full"), F.col("n_faces")))).otherwise(floats(F.col("n_full"))),
        "sample_image_paths": F.when(same, F.col("o_sample_image_paths")).otherwise(merged_samples(F.col("o_sample_image_paths"), F.col("n_samples"), MAX_SAMPLES)),
        "faces_seen": F.when(same, F.col("o_faces_seen")).when(is_new, F.col("n_faces")).otherwise(old_faces + F.col("n_faces")).cast("int"),
        "eye_embedding": F.when(same, F.col("o_eye_embedding")).when(F.col("n_eye").isNull(), old_eye).when(match_eye, floats(_blend(old_eye, old_eyes, F.col("n_eye"), F.col("n_eyes")))).otherwise(floats(F.col("n_eye"))),
        "eye_faces_seen": F.when(same, F.col("o_eye_faces_seen")).when(F.col("n_eye").isNull(), old_eyes).when(match_eye, old_eyes + F.col("n_eyes")).otherwise(F.col("n_eyes")).cast("int"),
        "created_at": F.when(is_new, now).otherwise(F.col("o_created_at")),
        "updated_at": F.when(same, F.col("o_updated_at")).otherwise(now),
    }
    values |= {c: F.col(f"s{i}") for i, c in enumerate(scope)}
    return j.select(*[values[c].alias(c) if c in values else F.col(f"o_{c}").alias(c) for c in persons.columns])


def merged_persons(persons: DataFrame, keep: str, other: str, now: Column) -> DataFrame:
    """Persons with ``other`` folded into ``keep``: blended vectors, summed faces, merged samples.

    The number of eye faces becomes that of all faces if there is an eye vector,
    else 0. Equal or blank names and vectors of different lengths are errors; an
    unknown name changes nothing.
    """
    keep, other = str(keep or "").strip(), str(other or "").strip()
    if not keep or not other or _key(keep) == _key(other):
        raise ValueError("two different names are needed")
    k = name_key(F.col("person_name"))
    two = persons.where(k.isin(_key(keep), _key(other))).withColumn("__k", k).collect()  # two rows at most
    rows = {r["__k"]: r for r in two}
    if len(rows) < 2:
        return persons
    a, b = rows[_key(keep)], rows[_key(other)]
    if len(a.embedding or []) != len(b.embedding or []):
        raise ValueError("the vectors differ in length")
    pair = persons.where(k == _key(keep)).join(F.broadcast(persons.where(k == _key(other)).select(*[F.col(c).alias(f"b_{c}") for c in persons.columns])))
    n = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1)))
    eye_a, eye_b = F.when(usable(F.col("eye_embedding")), F.col("eye_embedding")), F.when(usable(F.col("b_eye_embedding")), F.col("b_eye_embedding"))
    blended = _blend(eye_a, n("eye_faces_seen"), eye_b, n("b_eye_faces_seen")).cast("array<float>")
    eye = F.when(eye_a.isNull(), eye_b).when(eye_b.isNull() | (F.size(eye_a) != F.size(eye_b)), eye_a).otherwise(blended)
    faces = n("faces_seen") + n("b_faces_seen")
    values = {
        "embedding": _blend(F.col("embedding"), n("faces_seen"), F.col("b_embedding"), n("b_faces_seen")).cast("array<float>"),
        "sample_image_paths": merged_samples(F.col("sample_image_paths"), F.col("b_sample_image_paths"), MAX_SAMPLES),
        "faces_seen": faces.cast("int"),
        "eye_embedding": eye,
        "eye_faces_seen": F.when(eye.isNull(), 0).otherwise(faces).cast("int"),
        "updated_at": now,
    }
    merged = pair.select(*[values.get(c, F.col(c)).alias(c) for c in persons.columns])
    return persons.where(~F.coalesce(k.isin(_key(keep), _key(other)), F.lit(False))).unionByName(merged)


def no_persons(spark) -> DataFrame:
    """The persons of a missing store."""
    return spark.createDataFrame([], PERSONS)

