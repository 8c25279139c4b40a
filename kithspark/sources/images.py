"""Folders of images, and the stage that turns images into faces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kithspark.functions.text import suffix, throughput
from kithspark.schemas import IMAGE_SUFFIXES

FACE = "struct<x1:int,y1:int,x2:int,y2:int,score:double,embedding:array<float>,eye_embedding:array<float>>"


def is_supported(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*IMAGE_SUFFIXES)


def is_readable(content: Column) -> Column:
    """Whether the first bytes are those of a JPEG, PNG, BMP or WebP file."""
    head = F.hex(F.substring(content, 1, 12))
    kinds = head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | head.startswith("424D") | head.rlike("^52494646.{8}57454250")
    return F.coalesce(kinds, F.lit(False))


def scanned(spark: SparkSession, folder: str, recursive: bool = True, validate: bool = True) -> DataFrame:
    """(path, content) of the supported images in a folder; unreadable files are left out with ``validate``.

    A missing folder is an error. Files that can't be opened, and empty ones, are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).load(folder)
    files = files.where(is_supported(F.col("path"))).select("path", "content")
    return files.where(is_readable(F.col("content"))) if validate else files


def in_order(images: DataFrame) -> DataFrame:
    return images.orderBy(F.lower("path"), "path")


def processed(images: DataFrame, model: Callable[[], Callable[[bytes], list[dict]]], partitions: int | None = None) -> DataFrame:
    """(path, status, faces_detected, embedded, faces, error) of each image (path, content).

    ``model`` makes, once for each task, a function from an image's bytes to its
    faces (the fields of FACE). An error of one image becomes its status: it is
    ``unreadable`` for a ValueError, ``failed`` for any other; the job goes on.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = None
        for b in batches:
            detect = detect or model()
            out = []
            for path, content in zip(b.path, b.content):
                try:
                    faces = [f for f in detect(content)]
                    out.append((path, "ok", len(faces), sum(f.get("embedding") is not None for f in faces), faces, None))
                except ValueError as e:
                    out.append((path, "unreadable", 0, 0, [], str(e)))
                except Exception as e:
                    out.append((path, "failed", 0, 0, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "status", "faces_detected", "embedded", "faces", "error"])

    rows = images.repartition(partitions) if partitions else images
    return rows.mapInPandas(run, f"path string, status string, faces_detected int, embedded int, faces array<{FACE}>, error string")


def face_rows(images: DataFrame) -> DataFrame:
    """One row for each face with a vector, with its place in the image."""
    return images.select(F.col("path").alias("image_path"), F.posexplode("faces").alias("position", "face")).select("image_path", "position", "face.*").where("embedding is not null")


def scan_totals(images: DataFrame) -> DataFrame:
    """One row of counters over (status, faces_detected, embedded); null counts are 0."""
    none = (F.col("status") == "failed") | ((F.col("status") == "ok") & (F.coalesce("faces_detected", F.lit(0)) == 0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return images.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status") == "unreadable").alias("unreadable"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(none).alias("without_faces"), total("faces_detected"), total("embedded"))


def with_rate(totals: DataFrame, seconds: float) -> DataFrame:
    return totals.withColumn("images_per_second", F.round(throughput(F.col("scanned"), F.lit(float(seconds))), 3))
