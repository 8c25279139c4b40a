"""Known people, and where photos go."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithspark.operators import identity as idn, placement as plc
from kithspark.schemas import PERSONS

OLD, NOW = datetime(2024, 1, 1), datetime(2025, 1, 1)
ALICE, BOB, OPPOSITE = [1.0, 0, 0, 0], [0, 1.0, 0, 0], [-1.0, 0, 0, 0]


def person(name, v, faces=1, eye=None, eyes=0, samples=()):
    return (name, [float(x) for x in v] if v is not None else None, list(samples), faces, [float(x) for x in eye] if eye is not None else None, eyes, OLD, OLD)


def people(spark, *rows):
    return spark.createDataFrame(list(rows), PERSONS)


def after(spark, old, *batch):
    b = spark.createDataFrame(list(batch), PERSONS).drop("created_at", "updated_at")
    return {r.person_name: r for r in idn.upserted(old, b, F.lit(NOW).cast("timestamp")).collect()}


def query(spark, rows):
    return spark.createDataFrame(rows, "query_id int, full array<double>, eye array<double>")


def test_match(spark):
    known = people(spark, person("Alice", ALICE), person("Bob", BOB), person("Short", [1.0]), person("None", None))
    q = query(spark, [(1, [1.0, 0.4, 0.0, 0.0], None), (2, [0.0, 0.0, 1.0, 0.0], None), (3, [0.0] * 4, None), (4, [-1.0, 0.0, 0.0, 0.0], None)])
    best = {r.query_id: r.person_name for r in idn.best_match(idn.candidates(q, known, 1.5)).collect()}
    assert best == {1: "Alice", 2: "Alice", 4: "Bob"}
    assert idn.best_match(idn.candidates(q, known, 0.5)).count() == 1
    two = [(r.rank, r.person_name) for r in idn.with_runner_up(idn.candidates(q, known, 1.5)).where("query_id = 1").orderBy("rank").collect()]
    assert two == [(1, "Alice"), (2, "Bob")]
    with pytest.raises(ValueError):
        idn.candidates(q, known, 0)


def test_the_eye_signal_decides_a_conflict(spark):
    known = people(spark, person("A", ALICE, eye=[1, 0], eyes=1), person("B", BOB, eye=[0, 1], eyes=1))
    best = idn.best_match(idn.candidates(query(spark, [(1, [1.0, 0.0, 0.0, 0.0], [0.0, 1.0])]), known, 0.9)).first()
    assert best.person_name == "B" and best.used_eye and abs(best.distance - 0.4) < 1e-6 and abs(best.full_distance - 1) < 1e-6


def test_upsert(spark):
    old = people(spark, person("Alice", ALICE, 1, samples=["a.jpg"]), person("Carl", OPPOSITE))
    got = after(spark, old, person("ALICE", BOB, 5, samples=["A.JPG", *[f"{i}.jpg" for i in range(13)]]), person(" Dora ", [0, 2.0, 0, 0]), person(" ", BOB), person("Zero", [0, 0, 0, 0]))
    assert set(got) == {"ALICE", "Carl", "Dora"}
    a = got["ALICE"]
    assert a.faces_seen == 6 and len(a.sample_image_paths) == 8 and a.sample_image_paths[0] == "a.jpg" and np.dot(a.embedding, BOB) > np.dot(a.embedding, ALICE) > 0
    assert (a.created_at, a.updated_at) == (OLD, NOW) and got["Carl"].updated_at == OLD and got["Dora"].embedding == BOB and got["Dora"].created_at == NOW


def test_upsert_of_eyes_and_other_sizes(spark):
    old = people(spark, person("A", ALICE, 2, eye=[1, 0], eyes=3), person("B", ALICE), person("C", ALICE, eye=[1, 0], eyes=2))
    got = after(spark, old, person("a", ALICE), person("b", BOB, eye=[0, 2], eyes=4), person("c", [1.0, 0], 3, eye=[0, 1], eyes=2))
    assert got["a"].eye_embedding == [1, 0] and got["a"].eye_faces_seen == 3
    assert got["b"].eye_embedding == [0, 1] and got["b"].eye_faces_seen == 4
    assert got["c"].embedding == [1, 0] and got["c"].faces_seen == 4 and np.allclose(got["c"].eye_embedding, [2**-0.5] * 2) and got["c"].eye_faces_seen == 4


def test_merge(spark):
    old = people(spark, person("A", ALICE, 3, eye=[1, 0], eyes=1, samples=["x"]), person("B", BOB, 1, samples=["X", "y"]), person("C", [1.0]))
    now = F.lit(NOW).cast("timestamp")
    got = {r.person_name: r for r in idn.merged_persons(old, "a", "B", now).collect()}
    assert set(got) == {"A", "C"} and got["A"].faces_seen == 4 and got["A"].eye_faces_seen == 4 and got["A"].sample_image_paths == ["x", "y"]
    assert np.allclose(got["A"].embedding, np.array([3, 1, 0, 0]) / 10**0.5)
    assert idn.merged_persons(old, "A", "Ghost", now).count() == 3
    for bad in (("A", "a"), ("", "B"), ("A", "C")):
        with pytest.raises(ValueError):
            idn.merged_persons(old, *bad, now)


def test_clusters_are_fused_merged_split_and_named(spark):
    labels = spark.createDataFrame([(0, "A"), (1, None), (2, "B"), (3, "A"), (4, None)], "cluster_id int, label string")
    assert {r.cluster_id: r.new_id for r in idn.fused_clusters(labels).collect()} == {0: 0, 3: 0, 1: 1, 2: 2, 4: 3}
    assert {r.cluster_id: r.new_id for r in idn.merged_clusters(labels, 4, 1).collect()} == {0: 0, 1: 1, 4: 1, 2: 2, 3: 3}
    faces = spark.createDataFrame([(10 + i, 0 if i < 4 else 1) for i in range(6)] + [(99, None)], "face_id int, cluster_id int")
    assert {r.face_id for r in idn.split_cluster(faces, 0, [2, 4, 9]).where("cluster_id = 2").collect()} == {11, 13} and idn.split_cluster(faces, 0, [1]).count() == 7
    named = idn.named_clusters(labels.select("cluster_id", F.col("label").alias("name")), spark.createDataFrame([(0, " Eve. "), (2, "skip")], "cluster_id int, typed string"))
    assert {r.cluster_id: r.name for r in named.collect()} == {0: "Eve", 1: None, 2: None, 3: "A", 4: None}
    for bad in ((0, 0), (0, 77)):
        with pytest.raises(ValueError):
            idn.merged_clusters(labels, *bad)
    for bad in ([], [1, 2, 3, 4], [9]):
        with pytest.raises(ValueError):
            idn.split_cluster(faces, 0, bad)


def placed(spark, rows, existing=None):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "person_name string, image_path string, n int")
    return {(r.source, r.folder): r.target for r in plc.organized(df, ["n"], existing).collect()}


def test_placement(spark):
    got = placed(spark, [("Ann", "/a/img.jpg"), ("Bob", "/a/img.jpg"), ("Ann", "/b/IMG.jpg"), ("skip", "/c.jpg"), ("", "/c.jpg"), (None, "/c.jpg"), ("Ann", "/a/img.jpg"), ("X", None)])
    assert got == {("/a/img.jpg", "Ann"): "img.jpg", ("/a/img.jpg", "Bob"): "img.jpg", ("/b/IMG.jpg", "Ann"): "IMG_1.jpg", ("/c.jpg", "_unknown"): "c.jpg"}
    old = spark.createDataFrame([("Ann", "img.jpg"), ("Ann", "img_1.jpg")], "folder string, name string")
    assert placed(spark, [("Ann", "/a/img.jpg")], old) == {("/a/img.jpg", "Ann"): "img_2.jpg"}


def test_free_names_match_a_plain_pass(spark):
    import random

    r = random.Random(5)
    names = [r.choice(["a.jpg", "A.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "b", "b_1", "c.x.png", ".h", "d.jpg"]) for _ in range(120)]
    taken, want = {}, []
    for i, n in enumerate(names):
        have = taken.setdefault(i % 3, set())
        dot = n.rfind(".")
        stem, ext = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        c, k = n, 0
        while c.lower() in have:
            k += 1
            c = f"{stem}_{k}{ext}"
        have.add(c.lower())
        want.append(c)
    df = spark.createDataFrame([(i % 3, n, i) for i, n in enumerate(names)], "folder int, name string, n int")
    assert [x.target for x in sorted(plc.free_names(df, "folder", "name", ["n"]).collect(), key=lambda x: x.n)] == want


def test_camera_names_stay_where_they_are(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit("f").alias("folder"), F.format_string("IMG_%d.jpg", F.col("id") + 1).alias("name"), F.col("id").cast("int").alias("n"))
    names = rows.groupBy("folder", F.lower("name").alias("__low")).agg(F.count(F.lit(1)).alias("rows")).withColumn("old", F.lit(0))
    assert plc._families(names, "folder").count() == 0
    assert plc.free_names(rows, "folder", "name", ["n"]).where("target = name").count() == 3000
    extra = spark.createDataFrame([("f", "img.jpg", 5000), ("f", "IMG.jpg", 5001), ("f", "img_2.jpg", 5002)], rows.schema)
    got = {r.n: r.target for r in plc.free_names(rows.unionByName(extra), "folder", "name", ["n"]).where("n >= 5000").collect()}
    assert got == {5000: "img.jpg", 5001: "IMG_3001.jpg", 5002: "img_2_1.jpg"}
    same = spark.range(500).select(F.lit("f").alias("folder"), F.lit("a.jpg").alias("name"), F.col("id").cast("int").alias("n"))
    assert {r.n: r.target for r in plc.free_names(same, "folder", "name", ["n"]).collect()} == {i: f"a_{i}.jpg" if i else "a.jpg" for i in range(500)}


def test_gallery(spark):
    rows = [("John", "/a.jpg"), ("John.", "/a.png"), ("John", "/b.png"), ("John", "/a.PNG"), ("John", "/x.db"), ("John", "/gone.jpg"), ("...", "/a.jpg")]
    photos = spark.createDataFrame(rows, "person_name string, image_path string")
    there = spark.createDataFrame([(p, 10) for _, p in rows if "gone" not in p], "path string, bytes int")
    m = plc.gallery(photos, there)
    got = {(r.person_name, r.source): (r.folder, r.target, r.status) for r in m.collect()}
    assert got["John", "/a.PNG"] == ("John", "a.jpg", "ok") and got["John", "/a.jpg"] == ("John", "a_1.jpg", "ok") and got["John.", "/a.png"][0] == "John (2)" and got["...", "/a.jpg"][0] == "unnamed"
    assert got["John", "/x.db"][1:] == (None, "skipped") and got["John", "/gone.jpg"][2] == "missing"
    assert tuple(plc.gallery_totals(m).first()) == (5, 3, 1, 1, 50)
    assert {r.person_name: (r.photos, r.cover) for r in plc.gallery_people(m).collect()}["John"] == (3, "a.jpg")


def test_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(b"1")
    src = str(tmp_path / "in/a.jpg")
    m = spark.createDataFrame([(src, "Ann", "a.jpg"), (src, "Bob", "a.jpg"), (str(tmp_path / "gone.jpg"), "Ann", "g.jpg")], "source string, folder string, target string")
    got = {(r.folder, r.target): r.error for r in plc.copied(m, str(tmp_path / "out"), move=True).collect()}
    assert got == {("Ann", "a.jpg"): None, ("Bob", "a.jpg"): None, ("Ann", "g.jpg"): "FileNotFoundError"}
    assert (tmp_path / "out/Bob/a.jpg").exists() and not (tmp_path / "in/a.jpg").exists()
    assert {(r.folder, r.target): r.error for r in plc.copied(m.limit(2), str(tmp_path / "out"), move=True).collect()} == {("Ann", "a.jpg"): None, ("Bob", "a.jpg"): None}  # tried again
    (tmp_path / "in/a.jpg").write_bytes(b"2")
    (tmp_path / "out/Ann/a.jpg").unlink()
    got = {r.folder: r.error for r in plc.copied(m.limit(2), str(tmp_path / "out"), move=True).collect()}
    assert got == {"Ann": None, "Bob": "FileExistsError"} and (tmp_path / "in/a.jpg").exists() and (tmp_path / "out/Bob/a.jpg").read_bytes() == b"1"
    assert not list((tmp_path / "out").rglob("*.part"))
