"""Schemas of the engine's relations and the defaults of its operators."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

FACES = T.StructType([
    T.StructField("face_id", T.LongType(), False),
    T.StructField("image_path", T.StringType()),
    *[T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")],
    T.StructField("embedding", VECTOR),
    T.StructField("eye_embedding", VECTOR),
    T.StructField("score", T.DoubleType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("person_name", T.StringType()),
])

PERSONS = T.StructType([
    T.StructField("person_name", T.StringType(), False),
    T.StructField("embedding", VECTOR),
    T.StructField("sample_image_paths", T.ArrayType(T.StringType())),
    T.StructField("faces_seen", T.IntegerType()),
    T.StructField("eye_embedding", VECTOR),
    T.StructField("eye_faces_seen", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

OCCURRENCES = T.StructType([
    T.StructField("person_name", T.StringType(), False),
    T.StructField("image_path", T.StringType(), False),
    T.StructField("faces", T.LongType()),
    T.StructField("seen_at", T.TimestampType()),
])

# The defaults that results depend on.
TOLERANCE = 0.5
MIN_FACES = 2
FULL_WEIGHT, EYE_WEIGHT = 0.4, 0.6
IOU, PROXIMITY = 0.5, 0.35
MIN_EYE_FACES = 2
NOISE = -1
MAX_SAMPLES = 8
UNKNOWN_FOLDER = "_unknown"
NAME_LENGTH, GALLERY_LENGTH, GALLERY_STEM = 64, 80, 76
SPREAD, MIN_EYE_PIXELS = 0.55, 24
TEMPLATE_EDGE, TEMPLATE_GAP, TEMPLATE_TOP, TEMPLATE_BOTTOM = 112.0, 35.2, 51.6, 60.4
CROP_MARGIN = 0.12
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
NOT_IN_GALLERY = (".db", ".sqlite", ".sqlite3", ".json", ".html", ".htm", ".xml")
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
AGREEMENT, FULL_COVERAGE, COVERED_AGREEMENT = 0.6, 0.999, 0.4
