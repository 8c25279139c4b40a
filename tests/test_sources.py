"""Images, settings, stores, SQLite files and streams."""

from __future__ import annotations

import array
import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kithspark.operators.relations import people
from kithspark.schemas import OCCURRENCES, PERSONS
from kithspark.sources import images as img
from kithspark.sources.config import load_config
from kithspark.sources.sqlite import register
from kithspark.sources.store import Store, open_store
from kithspark.streaming.occurrences import landed, maintain, occurrence_store, recent_counts

JPEG, PNG = b"\xff\xd8\xff\xe0" + b"0" * 20, b"\x89PNG\r\n\x1a\n" + b"0" * 20


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("b.JPG", JPEG), ("A.png", PNG), ("sub/c.webp", b"RIFF\x01\x00\x00\x00WEBP" + b"0"), ("bad.jpg", b"no image"), ("note.txt", JPEG), ("empty.png", b"0")):
        (tmp_path / name).write_bytes(content)
    return tmp_path


def names(df):
    return [r.path.rsplit("/", 1)[1] for r in df.collect()]


def test_scan(spark, folder):
    assert names(img.in_order(img.scanned(spark, str(folder)))) == ["A.png", "b.JPG", "c.webp"]
    assert sorted(names(img.scanned(spark, str(folder), recursive=False))) == ["A.png", "b.JPG"]
    assert len(names(img.scanned(spark, str(folder), validate=False))) == 5
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        img.scanned(spark, str(folder / "missing")).count()


def test_processing_with_a_model_of_ones_own(spark, folder):
    def model():
        def detect(content):
            if content.startswith(b"no"):
                raise ValueError("no image")
            if content == b"0":
                raise RuntimeError("empty")
            n = 2 if content.startswith(b"\xff") else 0
            return [{"x1": i, "y1": 0, "x2": 9, "y2": 9, "score": 0.5, "embedding": [1.0, float(i)] if i == 0 else None, "eye_embedding": None} for i in range(n)]

        return detect

    out = img.processed(img.scanned(spark, str(folder), validate=False), model, 3)
    assert tuple(img.with_rate(img.scan_totals(out), 2.0).first()) == (5, 1, 1, 3, 2, 1, 2.5)
    rows = img.face_rows(out).collect()
    assert [(r.position, r.x2, r.embedding) for r in rows] == [(0, 9, [1.0, 0.0])]


def test_counters(spark):
    df = spark.createDataFrame([("ok", 2, 2), ("unreadable", 0, 0), ("failed", 0, 0), ("ok", 0, 0)], "status string, faces_detected int, embedded int")
    assert tuple(img.scan_totals(df).first()) == (4, 1, 1, 2, 2, 2)
    assert tuple(img.scan_totals(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("tolerance: 0.7\nextra: 1\nweight_full_face: 3\nweight_eye_region: 1\nworkers: 2\n")
    got = load_config(str(f), {"min_faces_per_cluster": 3, "mode": None})
    assert (got["tolerance"], got["min_faces_per_cluster"], got["mode"], got["extra"]) == (0.7, 3, "copy", 1)
    assert (got["weight_full_face"], got["weight_eye_region"], got["workers"], got["names_db"]) == (3, 1, 2, None)
    for text in ("- 1\n", "tolerance: 0\n", "tolerance: 3\n", "weight_full_face: -1\n", "full_weight: 0.5\n", "weight_eyes: 1\n"):
        f.write_text(text)
        with pytest.raises(ValueError):
            load_config(str(f))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))


def test_store(spark, tmp_path):
    store = open_store(spark, f"file://{tmp_path}/occ", OCCURRENCES)
    assert store.read().count() == 0
    one = spark.createDataFrame([("A", "a", 1, None)], OCCURRENCES)
    store.write(one)
    old = store.read()
    store.write(old.unionByName(spark.createDataFrame([("B", "b", 1, None)], OCCURRENCES)))
    assert store.read().count() == 2 and old.count() == 1
    store.write(store.read())
    store.drop_old(1)
    assert store.read().count() == 2
    assert all(open_store(spark, x, OCCURRENCES) is None for x in (None, "", "none", "FALSE", "off"))


def test_store_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/p", OCCURRENCES, F.col("person_name"), 8)
    rows = lambda *names: spark.createDataFrame([(n, "a", 1, None) for n in names], OCCURRENCES)
    every = [f"P{i}" for i in range(40)]
    store.write(rows(*every), {"x": 1})
    before = {f.name for f in (tmp_path / "p").rglob("*.parquet")}
    parts = store.touched(rows("P3", "P4"))
    assert 1 <= len(parts) <= 2 and {"P3", "P4"} <= {r.person_name for r in store.read(parts).collect()} < set(every)
    store.write(store.read(parts).where("person_name <> 'P3'").unionByName(rows("P4")), None, parts)
    assert sorted(r.person_name for r in store.read().collect()) == sorted([*[e for e in every if e != "P3"], "P4"]) and store.note() == {"x": 1}
    store.drop_old(1)
    assert before & {f.name for f in (tmp_path / "p").rglob("*.parquet")} and store.read().count() == 40 and len(store.versions()) == 1
    store.write(store.read([]), None, list(range(8)))
    assert store.read().count() == 0


@pytest.mark.parametrize("broken", ["_names", "_finish", "_publish"])
def test_store_survives_a_stop_between_any_two_steps(spark, tmp_path, broken, monkeypatch):
    one = spark.createDataFrame([("A", "a", 1, None)], OCCURRENCES)
    for first in (True, False):
        store = Store(spark, f"file://{tmp_path}/{first}", OCCURRENCES)
        if not first:
            store.write(one, {"n": 1})
        with monkeypatch.context() as m:
            real, calls = getattr(Store, broken), []

            def stop(self, *a):
                calls.append(a)
                if broken != "_names" or "data-" in str(a[0]):
                    raise OSError("stopped")
                return real(self, *a)

            m.setattr(Store, broken, stop)
            with pytest.raises(OSError):
                store.write(one.unionByName(one), {"n": 2})
        again = Store(spark, f"file://{tmp_path}/{first}", OCCURRENCES)
        assert again.read().count() == (0 if first else 1) and again.note() == ({} if first else {"n": 1})
        again.drop_old()
        assert again.read().count() == (0 if first else 1)
        again.write(one.unionByName(one), {"n": 2})
        again.drop_old(1)
        assert again.read().count() == 2 and again.note() == {"n": 2} and len(list((tmp_path / str(first)).glob("data-*"))) == 1


def test_store_refuses_a_second_writer(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/s", OCCURRENCES) for _ in range(2))
    one = spark.createDataFrame([("A", "a", 1, None)], OCCURRENCES)
    a.write(one)
    state = b._current()[1]
    a.write(one.unionByName(one))
    with pytest.raises(RuntimeError):
        b._finish(2, state)
    assert b.read().count() == 2


def test_store_reads_tables_without_newer_columns(spark, tmp_path):
    Store(spark, f"file://{tmp_path}/p", PERSONS).write(spark.createDataFrame([("A", [1.0], 3)], "person_name string, embedding array<float>, faces_seen int"))
    row = Store(spark, f"file://{tmp_path}/p", PERSONS).read().first()
    assert row.person_name == "A" and row.eye_embedding is None and row.faces_seen == 3


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "n.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE persons (id INTEGER PRIMARY KEY, person_name TEXT, embedding BLOB, dims INTEGER, sample_image_paths TEXT, updated_at TEXT)")
        for i in range(25):
            c.execute("INSERT INTO persons VALUES (?, ?, ?, 2, ?, ?)", (i * 3 + 1, f"P{i}", array.array("f", [i, 0.5]).tobytes() if i else None, json.dumps([f"{i}.jpg"]) if i % 2 else "{bad", "2024-01-02T03:04:05+00:00" if i else "x"))
        c.execute("CREATE TABLE empty (id INTEGER, name TEXT)")
    register(spark)
    read = lambda t: spark.read.format("kith_sqlite").option("path", path).option("table", t).option("partitions", "4").load()
    got = {r.person_name: r for r in read("persons").collect()}
    assert len(got) == 25 and got["P3"].embedding == [3.0, 0.5] and got["P0"].embedding is None and got["P3"].sample_image_paths == ["3.jpg"] and got["P2"].sample_image_paths == []
    assert got["P3"].updated_at == datetime(2024, 1, 2, 3, 4, 5) and got["P0"].updated_at is None
    assert read("persons").rdd.getNumPartitions() == 4 and read("empty").count() == 0


def test_stream(spark, tmp_path):
    land, store = f"file://{tmp_path}/in", occurrence_store(spark, f"file://{tmp_path}/occ", 4)
    at = datetime(2024, 1, 1, 10, 30)
    batch = lambda *rows: spark.createDataFrame([(*r, at) for r in rows], OCCURRENCES).coalesce(1).write.mode("append").parquet(land)
    run = lambda check="check": maintain(landed(spark, land), store, f"file://{tmp_path}/{check}").awaitTermination(120)
    batch(("Ann", "a", 1), ("ANN", "a", 2), ("Bob", "a", 1))
    run()
    batch(("ann", "b", 4))
    run()
    run()
    assert {r.person_name: (r.photos, r.faces) for r in people(store.read()).collect()} == {"ANN": (1, 3), "Bob": (1, 1), "ann": (1, 4)} or {r.person_name.lower(): (r.photos, r.faces) for r in people(store.read()).collect()} == {"ann": (2, 7), "bob": (1, 1)}
    noted = store.note()
    run("another")  # a stream that begins anew is counted from its first batch
    assert {r.person_name.lower(): (r.photos, r.faces) for r in people(store.read()).collect()} == {"ann": (2, 14), "bob": (1, 2)} and len(store.note()) == 2 and noted.items() <= store.note().items()
    windows = recent_counts(landed(spark, land)).writeStream.format("memory").queryName("recent").outputMode("complete").trigger(availableNow=True).start()
    windows.awaitTermination(120)
    assert [r.faces for r in spark.table("recent").where(F.col("faces").isNotNull()).collect()] == [8]
