"""Small tables with everything that can be wrong in them, and the same tables without rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

NAN, INF = float("nan"), float("inf")
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
GOOD = [1.0] + [0.0] * 63
NEAR = [1.0, 0.1] + [0.0] * 62
FAR = [0.0] * 63 + [5.0]
BAD = [None, [], [0.0] * 64, [NAN] + [1.0] * 63, [INF] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3]

FACES = "face_id bigint, library_id int, scan_id bigint, image_path string, x1 int, y1 int, x2 int, y2 int, embedding array<float>, eye_embedding array<float>, score double, cluster_id int, person_name string, detected_at timestamp, arrived_at timestamp"
PERSONS = "person_id bigint, library_id int, person_name string, embedding array<float>, eye_embedding array<float>, sample_image_paths array<string>, faces_seen int, eye_faces_seen int, created_at timestamp, updated_at timestamp"
SCHEMAS = {
    "face_records": FACES,
    "persons": PERSONS,
    "face_clusters": "scan_id bigint, cluster_id int, faces array<bigint>, built_at timestamp",
    "images": "image_path string, library_id int, status string, faces_detected int, embedded int, taken_at timestamp",
    "face_occurrences": "occurrence_id bigint, library_id int, person_name string, image_path string, faces int, seen_at timestamp",
    "name_requests": "request_id bigint, library_id int, cluster_id int, name string, requested_at timestamp, arrived_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars int, thread_id bigint, library_id int, posted_at timestamp, arrived_at timestamp",
    "eval_items": "item_id bigint, lang string, skill string, text string",
    "moderation_samples": "sample_id bigint, lang string, text string, label string",
}

ITEM = " ".join(f"word{i} of{i} item{i}" for i in range(8))


def face(i, e=GOOD, eye=None, score=0.5, cluster=1, name=None, at=T1):
    return (i, 1, 1, "/a.jpg", 0, 0, 9, 9, e, eye, score, cluster, name, T1, at)


def rows() -> dict[str, list[tuple]]:
    faces = [face(1), face(2, NEAR, GOOD), face(3, [x * 3 for x in GOOD], NEAR, NAN), face(4, FAR, None, 2.0, -1), face(5, FAR, None, None, None)]
    faces += [face(1, GOOD, None, 0.9, 7, "Ann", T2), face(1, GOOD, None, 0.9, 7, "Ann", T2), face(None), face(6, GOOD, None, 0.1, 7, " ", None)]
    faces += [face(10 + i, b, b, 0.3, 1) for i, b in enumerate(BAD)] + [(20, *[None] * 14)]
    person = lambda i, lib, name, e=GOOD, n=1: (i, lib, name, e, None, None, n, None, None, None)
    persons = [person(1, 1, "Ann Sorel", n=96), person(2, 1, "Аnn Sorel"), person(3, 1, "Anna Sorel​", NEAR, -1), person(4, 1, None), person(5, None, "Ann Sorel"), person(None, 1, "Ann Sorel"), person(6, 1, ""), person(7, 1, "x" * 20_000, None, 0), person(8, 1, "​", FAR, None)]
    persons += [person(10 + i, 2, f"P{i} Q{i}", b) for i, b in enumerate(BAD)]
    requests = [(1, 1, 1, "Sorel, Ann", T1, T1), (1, 1, 1, "Sorel, Ann", T1, T1), (2, 1, None, None, None, None), (3, None, 1, "Ann", T1, T1), (None, 1, 1, "Ann", T1, T1), (4, 1, 1, "  ", T1, T1), (5, 1, 1, "unknown", T1, T1), (6, 9, 1, "y" * 20_000, T1, None)]
    text = lambda i, t, s="Mail": (i, t, None, s, None, None, None, None, None)
    documents = [text(1, None), text(2, ""), text(3, "  \n\t"), text(4, "You are a stupid idiot.", None), text(5, f"Hello. {ITEM.upper()} Bye.", "MAIL "), text(None, ITEM), text(6, "long text without end " * 20_000), text(7, "x" * 200_000), text(8, "퟿￿​"), text(9, "<" * 5000)]
    return {
        "face_records": faces,
        "persons": persons,
        "face_clusters": [(1, 1, [1, None, 99], T1), (1, None, None, None), (None, 7, [], None)],
        "images": [("/a.jpg", 1, "ok", 1, 1, T1), (None, None, None, None, None, None), ("", 1, "failed", None, None, None)],
        "face_occurrences": [(1, 1, "Ann", "/a.jpg", 1, T1), (2, 1, "ANN", "/a.jpg", None, None), (3, None, "Ann", "/a.jpg", 1, T1), (4, 1, None, None, None, None), (None, 1, " ", "/b.jpg", 1, T1)],
        "name_requests": requests,
        "documents": documents,
        "eval_items": [(1, "en", "s", ITEM), (1, "en", "s", ITEM), (2, None, None, None), (None, "en", "s", ITEM), (3, "en", "s", "")],
        "moderation_samples": [(1, "en", "You moron.", "abusive"), (2, None, None, None), (3, "en", "", "ok"), (4, "en", "Fine.", "other"), (None, "en", "Fine.", "ok")],
    }


def write(spark: SparkSession, folder: str, empty: bool = False) -> str:
    """The tables as Parquet under ``folder``, each with columns of its own whose names clash with those in use."""
    for name, schema in SCHEMAS.items():
        data = [] if empty else rows()[name]
        df = spark.createDataFrame(data, schema)
        for extra in ("id", "vec", "signal", "key", "form", "rank", "t", "b"):
            df = df.withColumn(extra, df[df.columns[0]].cast("string"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder
