"""Occurrences from a stream of landing files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kithspark.functions.text import name_key
from kithspark.operators.relations import keyed, record
from kithspark.schemas import OCCURRENCES
from kithspark.sources.store import Store


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences that arrive as Parquet files in a folder."""
    return spark.readStream.schema(OCCURRENCES).parquet(folder)


def occurrence_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """A store of occurrences, dealt out by person, so a batch replaces only the parts of people in it."""
    return Store(spark, path, OCCURRENCES, name_key(F.col("person_name")), buckets)


def maintain(stream: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep ``store`` up to date with a stream of occurrences.

    Each batch is added to the current version; only the parts of the store that
    it has rows of are read and written. With a version is noted which batch of
    which stream was the last in it, so a batch that is tried again after a failure
    isn't counted twice, and a stream that begins anew with another checkpoint is
    counted from its first batch on.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        # The id lies in the checkpoint and outlives restarts.
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
        note = store.note()
        if note.get(stream_id, -1) >= number:
            return
        rows = keyed(batch).drop("name_key")
        parts = store.touched(rows)
        store.write(record(store.read(parts), rows), note | {stream_id: number}, parts)
        store.drop_old()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recent_counts(stream: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Faces of each window of time; rows later than ``late`` are left out."""
    return stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", window)).agg(F.sum("faces").alias("faces")).select(F.col("window.start").alias("from"), "faces")
