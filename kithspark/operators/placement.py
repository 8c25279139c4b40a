"""Which photo goes to which folder, and under which name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kithspark.functions.text import basename, folder_name, gallery_name, resolved_path, stem, suffix
from kithspark.operators.clustering import _dense
from kithspark.schemas import GALLERY_STEM, NOT_IN_GALLERY, UNKNOWN_FOLDER


#: Numbers at the end of a stem as they are given to names that are taken; there must be something before them.
_NUMBERS = r"(?<=.)((?:_[1-9]\d*)+)$"


def _families(names: DataFrame, folder: str) -> DataFrame:
    """(folder, __low, __family) for names (folder, __low, rows, old): of names that can stand in each other's way the shortest.

    ``a_1.jpg`` can meet what ``a.jpg`` is turned into, if that is there more than
    once, or can itself be turned into something for the same reason.
    """
    head, tail = stem(F.col("__low")), suffix(F.col("__low"))
    end = F.regexp_extract(head, _NUMBERS, 1)
    numbered = names.withColumn("end", end).where("end <> ''").select(folder, "__low", F.expr("substring(end, 2)").alias("end"), F.substring(head, F.lit(1), F.length(head) - F.length("end")).alias("base"), tail.alias("tail"))
    parts = numbered.withColumn("part", F.split("end", "_"))
    up = parts.select(folder, "__low", F.posexplode(F.expr("transform(sequence(1, size(part)), k -> concat(base, concat_ws('', transform(slice(part, 1, size(part) - k), x -> concat('_', x))), tail))")).alias("k", "above"))
    source = names.where("rows > 0").select(F.col(folder), F.col("__low").alias("above"), (F.col("rows") + F.col("old") > 1).alias("again"))
    steps = up.join(source, [folder, "above"], "left").groupBy(folder, "__low").agg(F.array_sort(F.collect_list(F.struct("k", "above", "again"))).alias("s"))
    # From the shortest on: a name is turned into others if it is there twice, or if a shorter one may take it.
    turned = F.expr("aggregate(reverse(s), cast(array() as array<boolean>), (have, x) -> array_append(have, coalesce(x.again, false) or (x.again is not null and coalesce(try_element_at(have, -1), false))))")
    linked = steps.withColumn("turned", F.reverse(turned)).withColumn("far", F.expr("aggregate(turned, struct(true as on, 0 as n), (a, t) -> struct(a.on and t as on, a.n + if(a.on and t, 1, 0) as n), a -> a.n)"))
    return linked.where("far > 0").select(folder, "__low", F.expr("element_at(s, far).above").alias("__family"))


def free_names(rows: DataFrame, folder: str, name: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``target``: the name, or stem_1, stem_2 and so on, the first that is free in its folder.

    Names are taken in ``order`` and compared without case; ``existing`` (folder,
    name) are taken from the start. A name that is there once, and that no other
    can be turned into, stays as it is and moves nowhere. Repeats of one name that
    meet no other are numbered over range partitions, so a name that very many
    files have is no load. Only names that can really stand in each other's way,
    as ``a_1.jpg`` and a repeated ``a.jpg`` can, are gone through in order, a
    family at a time.
    """
    keyed = rows.withColumn("__low", F.lower(name))
    here = keyed.groupBy(folder, "__low").agg(F.count(F.lit(1)).alias("rows")).withColumn("old", F.lit(0))
    if existing is not None:
        held = existing.select(F.col(folder), F.lower("name").alias("__low")).where("__low is not null").distinct()
        here = here.unionByName(held.withColumn("rows", F.lit(0).cast("bigint")).withColumn("old", F.lit(1))).groupBy(folder, "__low").agg(F.sum("rows").alias("rows"), F.max("old").alias("old"))
    names = here.join(_families(here, folder), [folder, "__low"], "left").withColumn("__family", F.coalesce("__family", "__low"))
    shape = names.groupBy(folder, "__family").agg(F.count(F.lit(1)).alias("__names"), F.sum("rows").alias("__rows"), F.max("old").alias("__old"))
    # What isn't alone in its family, or is there more than once.
    crowded = names.join(shape.where("__rows > 0 and (__names > 1 or __rows > 1 or __old > 0)"), [folder, "__family"])
    known = crowded.where("rows > 0").select(folder, "__low", "__family", (F.col("__names") + F.col("__old") > 1).alias("__hard"))
    marked = keyed.join(known, [folder, "__low"], "left")
    alone = marked.where("__family is null").select(*rows.columns, F.col(name).alias("target"))

    again = marked.where("not __hard")
    at = _dense(again.select(*rows.columns, "__low", F.struct(folder, "__low", *order).alias("__by")), "__by")
    first = at.groupBy(folder, "__low").agg(F.min("position").alias("__first"))
    place = F.col("position") - F.col("__first")
    numbered = F.concat(stem(F.col(name)), F.lit("_"), place.cast("string"), suffix(F.col(name)))
    repeats = at.join(first, [folder, "__low"]).select(*rows.columns, F.when(place == 0, F.col(name)).otherwise(numbered).alias("target"))

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    given = [*rows.columns, "target"]

    def go(every: pd.DataFrame) -> pd.DataFrame:
        b = every[~every["__is_old"]]
        taken, following, out = set(every["__low"][every["__is_old"]]), {}, []
        b = b.sort_values(order, kind="stable") if order else b
        for n in b[name]:
            dot = n.rfind(".")
            head, tail = (n[:dot], n[dot:]) if dot > 0 else (n, "")
            candidate, i = n, 0
            if n.lower() in taken:
                i = following.get(n.lower(), 0)
                while True:
                    i += 1
                    candidate = f"{head}_{i}{tail}"
                    if candidate.lower() not in taken:
                        break
                following[n.lower()] = i
            taken.add(candidate.lower())
            out.append(candidate)
        return b.assign(target=out)[given]

    taken = crowded.where("old > 0").select(folder, "__family", "__low", F.lit(True).alias("__is_old"))
    inside = marked.where("__hard").drop("__hard").withColumn("__is_old", F.lit(False)).unionByName(taken, allowMissingColumns=True)
    hard = inside.groupBy(folder, "__family").applyInPandas(go, f"{fields}, target string")
    return alone.unionByName(repeats).unionByName(hard)


def organized(assignments: DataFrame, order: list[str], existing: DataFrame | None = None, unknown: str = UNKNOWN_FOLDER) -> DataFrame:
    """(source, folder, target) for (person_name, image_path, *order): each photo once in every folder it belongs to.

    A name that names nobody sends the photo to the folder of unknowns. Photos
    without a path aren't placed.
    """
    placed = assignments.where(F.col("image_path").isNotNull()).withColumn("folder", F.coalesce(folder_name(F.col("person_name")), F.lit(unknown)))
    by = placed.groupBy("image_path", "folder")
    once = by.agg(*[F.min(c).alias(c) for c in order]) if order else placed.select("image_path", "folder").distinct()
    rows = once.select(F.col("image_path").alias("source"), "folder", basename(F.col("image_path")).alias("name"), *order)
    return free_names(rows, "folder", "name", [*order, "source"], existing).select("source", "folder", "target")


def organize_totals(manifest: DataFrame) -> DataFrame:
    """One row: folders, photos placed and copies written."""
    return manifest.agg(F.count_distinct("folder").alias("folders"), F.count_distinct("source").alias("files_placed"), F.count(F.lit(1)).alias("copies_written"))


def folder_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("folder").agg(F.count(F.lit(1)).alias("photos"))


def copied(manifest: DataFrame, target_root: str, move: bool = False) -> DataFrame:
    """Copies the files of a manifest and gives (source, folder, target, error), error null where it worked.

    Runs where the files can be reached from the tasks. A copy is written under
    another name and then takes its own in one step, so a task that is tried again
    finds whole copies or none; one that equals its source is taken for done, and
    any other file in its place is never replaced. With ``move`` a source is
    removed once all its copies are there.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        import filecmp
        import os
        import shutil
        import uuid

        source, errors = b.source.iloc[0], []
        targets = [os.path.join(target_root, f, t) for f, t in zip(b.folder, b.target)]
        gone = not os.path.exists(source) and move and all(map(os.path.exists, targets))  # moved by an earlier try
        for to in targets:
            part = f"{to}.{uuid.uuid4().hex}.part"
            try:
                if not gone and not (os.path.exists(to) and os.path.exists(source) and filecmp.cmp(source, to, shallow=False)):
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    shutil.copy2(source, part)
                    os.link(part, to)  # fails if there is one
                errors.append(None)
            except OSError as e:
                errors.append(type(e).__name__)
            finally:
                if os.path.exists(part):
                    os.unlink(part)
        if move and not gone and not any(errors):
            os.unlink(source)
        return b.assign(error=errors)

    return manifest.select("source", "folder", "target").groupBy("source").applyInPandas(run, "source string, folder string, target string, error string")


def intersection_manifest(photos: DataFrame, existing: DataFrame | None = None, root: str = "") -> DataFrame:
    """(source, target) for the photos of an intersection, into one folder."""
    rows = photos.select(resolved_path(F.col("image_path"), F.lit(root)).alias("source"), F.lit(".").alias("folder"), basename(F.col("image_path")).alias("name"))
    return free_names(rows, "folder", "name", ["source"], existing).select("source", "target")


def gallery_folders(people: DataFrame) -> DataFrame:
    """(person_name, folder): a folder for each person; people with the same one get (2), (3) in the order of names."""
    base = people.select("person_name").distinct().withColumn("base", gallery_name(F.col("person_name")))
    at = F.row_number().over(Window.partitionBy("base").orderBy("person_name"))
    later = F.concat(F.substring("base", 1, GALLERY_STEM), F.lit(" ("), at.cast("string"), F.lit(")"))
    return base.select("person_name", F.when(at == 1, F.col("base")).otherwise(later).alias("folder"))


def gallery(photos: DataFrame, listing: DataFrame | None = None, root: str = "") -> DataFrame:
    """(person_name, folder, source, target, status, position, bytes) for each person's photos in order of their path.

    ``listing`` (path[, bytes]) holds the files that exist, with their sizes; a photo
    that isn't in it is missing, one that is no picture is skipped, and only the
    others get a target.
    """
    rows = photos.join(gallery_folders(photos), "person_name").withColumn("source", resolved_path(F.col("image_path"), F.lit(root)))
    if listing is not None:
        size = F.max("bytes") if "bytes" in listing.columns else F.lit(None)
        rows = rows.join(listing.groupBy(F.col("path").alias("source")).agg(size.cast("bigint").alias("bytes"), F.lit(True).alias("there")), "source", "left")
    else:
        rows = rows.withColumn("there", F.lit(True)).withColumn("bytes", F.lit(None).cast("bigint"))
    status = F.when(F.col("there").isNull(), "missing").when(F.lower(suffix(F.col("source"))).isin(*NOT_IN_GALLERY), "skipped").otherwise("ok")
    rows = rows.select("person_name", "folder", "source", F.concat(stem(F.col("source")), F.lit(".jpg")).alias("name"), status.alias("status"), "bytes")
    shown = free_names(rows.where("status = 'ok'"), "folder", "name", ["source"])
    at = F.row_number().over(Window.partitionBy("folder").orderBy("source"))
    shown = shown.withColumn("position", at).select("person_name", "folder", "source", "target", "status", "position", "bytes")
    rest = rows.where("status <> 'ok'").select("person_name", "folder", "source", F.lit(None).cast("string").alias("target"), "status", F.lit(None).cast("int").alias("position"), "bytes")
    return shown.unionByName(rest)


def gallery_people(manifest: DataFrame) -> DataFrame:
    """Each person with at least one shown photo: folder, number of photos and cover."""
    return manifest.where("status = 'ok'").groupBy("person_name", "folder").agg(F.count(F.lit(1)).alias("photos"), F.min_by("target", "position").alias("cover"))


def gallery_totals(manifest: DataFrame) -> DataFrame:
    shown = F.col("status") == "ok"
    return manifest.agg(F.count_if(shown).alias("photos"), F.count_distinct(F.when(shown, F.col("person_name"))).alias("people"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "missing").alias("missing"), F.coalesce(F.sum(F.when(shown, F.col("bytes"))), F.lit(0)).alias("bytes"))
