"""Who is in which photo: a table of (person_name, image_path, faces, seen_at) and its queries.

Names are compared without regard to the case of ASCII letters. ``scope`` names
columns within which names have a meaning, such as a library; there are none by
default. Rows whose name or path is null or blank don't count. The spelling that
is given for a name is the smallest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kithspark.functions.text import name_key, stripped


def keyed(occ: DataFrame) -> DataFrame:
    """Occurrences with a name and a path, and ``name_key``; a table that has the key, as a stored one can, keeps it, so
    that filters on it reach the scan."""
    if "name_key" in occ.columns:
        return occ.where(F.col("name_key").isNotNull() & (F.col("image_path") != ""))
    return occ.where((stripped(F.col("person_name")) != "") & (stripped(F.col("image_path")) != "")).withColumn("name_key", name_key(F.col("person_name")))


def record(old: DataFrame | None, batch: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Old occurrences with a batch added: faces of a name and photo are summed, its latest seen_at stays.

    A null number of faces counts as 1. Reduced before the shuffle, so repeats of
    one row are no load.
    """
    rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
    return keyed(rows).groupBy(*scope, "name_key", "image_path").agg(F.min("person_name").alias("person_name"), F.sum(F.coalesce("faces", F.lit(1))).alias("faces"), F.max("seen_at").alias("seen_at")).select(*scope, "person_name", "image_path", "faces", "seen_at")


def forget(occ: DataFrame, name: str) -> DataFrame:
    """Occurrences without those of a name."""
    return occ.where(~F.coalesce(name_key(F.col("person_name")) == name_key(F.lit(name)), F.lit(False)))


def people(occ: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Each person with photos, faces and last time seen; needs one row for each name and photo."""
    return keyed(occ).groupBy(*scope, "name_key").agg(F.min("person_name").alias("person_name"), F.count(F.lit(1)).alias("photos"), F.sum("faces").alias("faces"), F.max("seen_at").alias("last_seen")).drop("name_key")


def known_names(occ: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    return keyed(occ).groupBy(*scope, "name_key").agg(F.min("person_name").alias("person_name")).drop("name_key")


def photos_of(occ: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Distinct photos of a person in order of their path; the first ``limit`` if it is positive."""
    rows = keyed(occ).where(F.col("name_key") == name_key(F.lit(name))).select("image_path").distinct().orderBy("image_path")
    return rows.limit(limit) if limit and limit > 0 else rows


def people_in(occ: DataFrame, path: str) -> DataFrame:
    return known_names(occ.where(F.col("image_path") == path)).orderBy(name_key(F.col("person_name")))


def request(names: list[str]) -> list[str]:
    """Names to look for: trimmed, without blanks, each once by its key, in their order."""
    seen: dict[str, str] = {}
    for n in names or ():
        n = str(n or "").strip()
        if n:
            seen.setdefault("".join(c.lower() if c.isascii() else c for c in n), n)
    return list(seen.values())


def intersection(occ: DataFrame, names: list[str], scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Photos that hold all of the names; none for no names.

    One pass: only rows of the wanted names are shuffled, grouped by photo. An
    unknown name can't reach the count, so then there is none either.
    """
    wanted = request(names)
    hit = keyed(occ).where(F.col("name_key").isin([_key(n) for n in wanted]) if wanted else F.lit(False))
    return hit.groupBy(*scope, "image_path").agg(F.count_distinct("name_key").alias("n")).where(F.col("n") == len(wanted)).select(*scope, "image_path")


def intersections(occ: DataFrame, requests: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(request_id, *scope, image_path) for a table of requests (request_id, *scope, person_name), one row for each wanted name."""
    want = requests.where(stripped(F.col("person_name")) != "").select("request_id", *scope, name_key(F.col("person_name")).alias("name_key")).distinct()
    size = want.groupBy("request_id", *scope).agg(F.count(F.lit(1)).alias("size"))
    pairs = keyed(occ).select(*scope, "name_key", "image_path").distinct()
    hits = want.join(pairs, [*scope, "name_key"]).groupBy("request_id", *scope, "image_path").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(size, ["request_id", *scope]).where("n = size").select("request_id", *scope, "image_path")


def _key(name: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in name)


def resolve(occ: DataFrame, names: list[str]) -> DataFrame:
    """(position, requested, person_name): the spelling of each requested name, null if it is unknown.

    A name equal but for case wins; else the smallest of the names it begins.
    Wanted names are few and given by the caller, so they are sent to the names.
    """
    wanted = request(names)
    spark = occ.sparkSession
    asked = spark.createDataFrame([(i, n, _key(n)) for i, n in enumerate(wanted)], "position int, requested string, k string")
    known = keyed(occ).groupBy("name_key").agg(F.min("person_name").alias("person_name"))
    hits = known.join(F.broadcast(asked), F.col("name_key").startswith(F.col("k"))).groupBy("position", "requested").agg(F.min(F.struct(F.col("name_key") != F.col("k"), "person_name")).alias("best"))
    found = hits.select("position", F.col("best.person_name").alias("person_name"))
    return asked.join(found, "position", "left").select("position", "requested", "person_name")


def resolved(occ: DataFrame, names: list[str]) -> tuple[list[str], list[str]]:
    """(matched, unknown) in the order of the request, matched names once each."""
    rows = resolve(occ, names).orderBy("position").collect()  # as many as were asked for
    return request([r.person_name for r in rows if r.person_name is not None]), [r.requested for r in rows if r.person_name is None]


def intersection_summary(occ: DataFrame, names: list[str]) -> DataFrame:
    """One row: how many photos hold all matched names, and the sum of the photos of each."""
    matched, _ = resolved(occ, names)
    rows = keyed(occ).where(F.col("name_key").isin([_key(n) for n in matched]) if matched else F.lit(False)).select("name_key", "image_path").distinct()
    per = rows.groupBy("image_path").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("n") == len(matched)).alias("count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def intersection_per_person(occ: DataFrame, names: list[str]) -> DataFrame:
    """(person_name, photos) of each matched name."""
    matched, _ = resolved(occ, names)
    return people(occ.where(name_key(F.col("person_name")).isin([_key(n) for n in matched])) if matched else occ.limit(0)).select("person_name", "photos")


def axis(occ: DataFrame) -> DataFrame:
    """(name_key, person_name, position): the names in the order of their keys, from 0."""
    from kithspark.operators.clustering import _dense

    return _dense(keyed(occ).groupBy("name_key").agg(F.min("person_name").alias("person_name")), "name_key")


def matrix(occ: DataFrame) -> DataFrame:
    """(i, j, person_a, person_b, photos): pairs that share a photo, with their places on the axis."""
    names = axis(occ)
    of = lambda at, name: names.select(F.col("position").alias(at), F.col("person_name").alias(name))
    return co_occurrence(occ).join(of("i", "person_a"), "person_a").join(of("j", "person_b"), "person_b").select("i", "j", "person_a", "person_b", "photos")


def co_occurrence(occ: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(*scope, person_a, person_b, photos) of each pair that shares a photo, a before b.

    Photos are matched by an equi-join with the order of names as its residue, and
    pair counts are reduced before their shuffle; the spellings are joined to the
    counts.
    """
    rows = keyed(occ).select(*scope, F.col("name_key"), "image_path").distinct()
    a = rows.select(*scope, "image_path", F.col("name_key").alias("ka"))
    b = rows.select(*scope, "image_path", F.col("name_key").alias("kb"))
    counts = a.join(b, [*scope, "image_path"]).where("ka < kb").groupBy(*scope, "ka", "kb").agg(F.count(F.lit(1)).alias("photos"))
    names = keyed(occ).groupBy(*scope, "name_key").agg(F.min("person_name").alias("person_name"))
    of = lambda key, name: names.select(*scope, F.col("name_key").alias(key), F.col("person_name").alias(name))
    return counts.join(of("ka", "person_a"), [*scope, "ka"]).join(of("kb", "person_b"), [*scope, "kb"]).select(*scope, "person_a", "person_b", "photos")


def ranked_pairs(pairs: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs by photos, most first; with ``top``, the first ones and a bar's width in percent, 8 at least."""
    order = [F.desc("photos"), name_key(F.col("person_a")), name_key(F.col("person_b"))]
    if top is None:
        return pairs.orderBy(*order)
    most = pairs.agg(F.coalesce(F.max("photos"), F.lit(0)).alias("most"))
    best = pairs.where("photos > 0").orderBy(*order).limit(top)
    return best.join(F.broadcast(most)).select("person_a", "person_b", "photos", F.greatest(F.lit(8.0), F.round(F.col("photos") / F.col("most") * 100, 1)).alias("weight"))


def merged(occ: DataFrame, keep: str, other: str) -> DataFrame:
    """Occurrences with those of ``other`` moved to ``keep``; faces of shared photos are summed.

    Equal or blank names, and an unknown ``other``, change nothing.
    """
    keep, other = str(keep or "").strip(), str(other or "").strip()
    if not keep or not other or _key(keep) == _key(other):
        return occ
    rows = keyed(occ)
    kept = rows.where(F.col("name_key") == _key(keep)).agg(F.coalesce(F.min("person_name"), F.lit(keep)).alias("__name"))
    renamed = F.when(F.col("name_key") == _key(other), F.col("__name")).when(F.col("name_key") == _key(keep), F.col("__name")).otherwise(F.col("person_name"))
    return record(None, rows.join(F.broadcast(kept)).withColumn("person_name", renamed).drop("__name", "name_key"))


def gallery_selection(occ: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(person_name, image_path) of everyone, or of the names; an unknown name is an error."""
    rows = keyed(occ).select("name_key", "image_path").distinct()
    spelling = keyed(occ).groupBy("name_key").agg(F.min("person_name").alias("person_name"))
    if names is not None:
        matched, unknown = resolved(occ, names)
        if unknown:
            raise ValueError("not among the known people: " + ", ".join(unknown))
        spelling = spelling.where(F.col("name_key").isin([_key(n) for n in matched]))
    return rows.join(spelling, "name_key").select("person_name", "image_path")


def neighbours_in_order(rows: DataFrame, group: str, order: list[Column], item: str) -> DataFrame:
    """Each item with its position from 1 and the one before and after it in its group; the ends meet.

    All rows are numbered over range partitions, and neighbours are found by their
    numbers, so a group of any size is no load. ``order`` with ``item`` should tell
    the rows of a group apart.
    """
    from kithspark.operators.clustering import _dense

    at = _dense(rows.where(F.col(group).isNotNull()).select(group, item, F.struct(F.col(group).alias("g"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(item).alias("i")).alias("__by")), "__by").drop("__by")
    ends = at.groupBy(group).agg(F.min("position").alias("low"), F.max("position").alias("high"))
    placed = at.join(ends, group)
    before = F.when(F.col("position") > F.col("low"), F.col("position") - 1).otherwise(F.col("high"))
    after = F.when(F.col("position") < F.col("high"), F.col("position") + 1).otherwise(F.col("low"))
    of = lambda key, name: at.select(F.col("position").alias(key), F.col(item).alias(name))
    both = placed.withColumn("__b", before).withColumn("__a", after).join(of("__b", "previous"), "__b").join(of("__a", "following"), "__a")
    return both.select(group, item, (F.col("position") - F.col("low") + 1).cast("int").alias("position"), "previous", "following")


def empty_occurrences(spark: SparkSession) -> DataFrame:
    from kithspark.schemas import OCCURRENCES

    return spark.createDataFrame([], OCCURRENCES)
