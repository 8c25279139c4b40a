"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithspark.operators.latest import latest_rows, latest_wide
from kithspark.plans.registry import Registry, table

R = Registry()


@R.add("p3_found", """
WITH latest AS (
  SELECT face_id, arg_max(r, r) AS r FROM (
    SELECT face_id, {'at': arrived_at, 'c': cluster_id, 's': score} AS r FROM face_records WHERE face_id IS NOT NULL)
  GROUP BY face_id),
f AS (SELECT face_id, CAST(r.c AS BIGINT) AS cluster_id, r.s AS s FROM latest WHERE r.c >= 0 AND r.s >= 0 AND r.s <= 1 AND NOT isnan(r.s))
SELECT cluster_id, face_id FROM f QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, face_id) <= 5""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best faces of every cluster_id."""
    from kithspark.llm.topn import top_n

    faces = latest_rows(table(spark, folder, "face_records"), "face_id", "arrived_at", ["cluster_id", "score"])
    best = top_n(faces.where("cluster_id >= 0 and score >= 0 and score <= 1"), "cluster_id", "score", "face_id", 5)
    return best.select(F.col("group").alias("cluster_id"), F.col("item").alias("face_id"))


@R.add("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    from kithspark.llm.bpe import encode_corpus, vocabulary_path

    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text", vocabulary_path(spark))


def _face_vectors(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """(id, vec) of each face whose latest row has a usable vector in ``column``."""
    from kithspark.llm.vectors import usable

    faces = latest_wide(table(spark, folder, "face_records"), "face_id", "arrived_at", [column])
    return faces.where(usable(column)).select(F.col("face_id").alias("id"), F.col(column).alias("vec"))


@R.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members of every group of close faces, but for its smallest face_id, which names it."""
    from kithspark.llm.mixture import linked_groups

    groups, _ = linked_groups(_face_vectors(spark, folder, "embedding"), 0.8)
    return groups.where("id <> group_id").select(F.col("group_id").alias("group_face_id"), F.col("id").alias("face_id"))


@R.add("p1_groups")
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each group of close faces with its size and its three most typical faces."""
    from kithspark.llm.mixture import linked_groups, typical_members

    groups, densities = linked_groups(_face_vectors(spark, folder, "embedding"), 0.8)
    return typical_members(groups, densities).withColumnRenamed("group_id", "group_face_id")


@R.add("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs where one is among the other's five most similar, for each kind of vector."""
    from kithspark.llm.neighbours import nearest, neighbour_pairs
    from kithspark.llm.vectors import usable

    signals = ["embedding", "eye_embedding"]
    latest = latest_wide(table(spark, folder, "face_records"), "face_id", "arrived_at", signals)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.when(usable(s), F.col(s)).alias("vec")) for s in signals]))
    faces = latest.select(F.col("face_id").alias("id"), each.alias("v")).select("v.signal", "id", "v.vec").where("vec is not null")
    persons = table(spark, folder, "persons").where(usable("embedding")).select(F.lit("person").alias("signal"), F.col("person_id").alias("id"), F.col("embedding").alias("vec"))
    return neighbour_pairs(nearest(faces.unionByName(persons), 5, 0.8))


@R.add("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of persons of a library whose names look the same but are stored differently."""
    from kithspark.llm.lookalike import look_alike_pairs

    pairs = look_alike_pairs(table(spark, folder, "persons"), "person_id", "library_id", "person_name")
    return pairs.select(F.col("a").alias("person_id_a"), F.col("b").alias("person_id_b"))


@R.add("p4_names")
def p4_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every person with one form for all names of the library that look the same."""
    from kithspark.llm.lookalike import chosen_names

    return chosen_names(table(spark, folder, "persons"), "person_id", "library_id", "person_name").select("person_id", "person_name", F.col("chosen").alias("name_form"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """(lib, kind, id, name) of all persons and of each request by its latest row."""
    persons = table(spark, folder, "persons").select(F.col("library_id").cast("bigint").alias("lib"), F.lit("person").alias("kind"), F.col("person_id").alias("id"), F.col("person_name").alias("name"))
    latest = latest_rows(table(spark, folder, "name_requests"), "request_id", "arrived_at", ["library_id", "name"])
    return persons.unionByName(latest.select(F.col("library_id").cast("bigint").alias("lib"), F.lit("request").alias("kind"), F.col("request_id").alias("id"), "name"))


@R.add("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of differently stored names of a library that mean the same person or organisation."""
    from kithspark.llm.names import name_entities, same_entity_pairs

    return same_entity_pairs(name_entities(_names(spark, folder)))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    from kithspark.llm.leaks import find_leaks

    return find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


@R.add("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of a test item, and the item."""
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


@R.add("p8_items")
def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with the number of documents, and its longest passage in words."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def _harm(spark: SparkSession, folder: str, carry: list[str]) -> DataFrame:
    from kithspark.llm.harm import fit_harm, harm_scores

    model = fit_harm(table(spark, folder, "moderation_samples"), "text", "label")
    return harm_scores(table(spark, folder, "documents"), "doc_id", "text", model, carry)


@R.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _harm(spark, folder, []).where("kind is not null").select("doc_id")


@R.add("p9_scores")
def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score and, if it is harmful, the kind."""
    return _harm(spark, folder, []).select("doc_id", F.round("score", 4).alias("score"), "kind")


@R.add("p9_sources")
def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of harmful documents for each source."""
    from kithspark.llm.harm import source_rates

    return source_rates(_harm(spark, folder, ["source"]), "source")
