"""Column functions: vectors, boxes, names, paths and values to show."""

from __future__ import annotations

import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithspark.functions import geometry as geo, text as tx, vectors as vec

NAN, INF = float("nan"), float("inf")


def value(spark, **columns):
    return lambda c: spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{k} {t}" for k, (_, t) in columns.items())).select(c).first()[0]


def on_vectors(spark, a, b, f):
    return value(spark, a=(a, "array<float>"), b=(b, "array<float>"))(f(F.col("a"), F.col("b")))


@pytest.mark.parametrize("a, b, want", [([1.0, 0], [2.0, 0], 1), ([1.0, 0], [0, 1.0], 0), ([1.0], [-1.0], -1), (None, [1.0], None), ([], [], None), ([1.0, 2.0], [1.0], None), ([NAN, 1], [1.0, 1], None), ([0.0, 0], [1.0, 1], None), ([INF, 1], [1.0, 1], None), ([None, 1.0], [1.0, 1], None)])
def test_cosine_similarity(spark, a, b, want):
    a, b = ([None if x is None else float(x) for x in v] if v is not None else None for v in (a, b))
    got = on_vectors(spark, a, b, vec.cosine_similarity)
    assert got is None if want is None else abs(got - want) < 1e-9


def test_cosine_distance(spark):
    d = lambda a, b: on_vectors(spark, a, b, vec.cosine_distance)
    assert [d(a, b) for a, b in (([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], []), (None, [1.0]), ([NAN, 1.0], [1.0, 0.0]), ([INF, 1.0], [1.0, 0.0]))] == [0, 1, 2, 2, 2, 2, 2, 2]
    for sizes in (([1.0, 2.0], [1.0]), ([], [1.0])):  # sizes are looked at before anything else
        with pytest.raises(Exception, match="differ in size"):
            d(*sizes)


def test_fused_rules(spark):
    run = lambda fa, fb, ea, eb, w=(0.4, 0.6): value(spark, fa=(fa, "array<float>"), fb=(fb, "array<float>"), ea=(ea, "array<float>"), eb=(eb, "array<float>"))(vec.fused_distance(*map(F.col, ("fa", "fb", "ea", "eb")), weights=w))
    x, y = [1.0, 0.0], [0.0, 1.0]
    assert run(x, x, y, y) == 0 and run(x, y, x, None) == 1 and run(x, y, x, [1.0]) == 1 and run(x, y, x, [0.0, 0.0]) == 1
    assert abs(run(x, y, x, x) - 0.4) < 1e-12 and abs(run(x, y, x, x, (2, 3)) - 0.4) < 1e-12 and run(None, y, x, x) == 0 and run(None, y, None, x) is None
    assert vec.validate_weights(2, 3) == (0.4, 0.6)
    for bad in ((-1, 1), (0, 0), (NAN, 1), ("x", 1), (INF, 1)):
        with pytest.raises(ValueError):
            vec.validate_weights(*bad)


def test_unit_and_usable(spark):
    assert on_vectors(spark, [3.0, 4.0], None, lambda a, _: vec.unit(a)) == [0.6, 0.8]
    assert on_vectors(spark, [0.0], None, lambda a, _: vec.unit(a)) is None
    assert value(spark, a=(None, "double"))(vec.metric_or_far(F.col("a"))) == 2


def boxes(spark, a, b, f):
    s = "struct<x1:double,y1:double,x2:double,y2:double>"
    return value(spark, a=(tuple(map(float, a)), s), b=(tuple(map(float, b)), s))(f(F.col("a"), F.col("b")))


def test_overlap_and_same_face(spark):
    assert boxes(spark, (0, 0, 10, 10), (5, 0, 15, 10), geo.iou) == 50 / 150
    assert boxes(spark, (0, 0, 10, 10), (50, 50, 60, 60), geo.iou) == 0 == boxes(spark, (0, 0, 0, 10), (0, 0, 10, 10), geo.iou)
    assert boxes(spark, (0, 0, 100, 100), (35, 35, 65, 65), geo.same_face) and not boxes(spark, (0, 0, 10, 10), (20, 0, 30, 10), geo.same_face)


@pytest.mark.parametrize("b, want", [((-20, -20, 10, 10), (0, 0, 10, 10)), ((500, 500, 600, 600), None), ((90, 90, 95, 95), (90, 90, 95, 95)), ((0, 0, 0, 10), None)])
def test_clip(spark, b, want):
    got = boxes(spark, b, b, lambda a, _: geo.clipped(a, F.lit(100), F.lit(100)))
    assert got is None if want is None else tuple(got) == want


def test_crops_and_grid(spark):
    assert tuple(boxes(spark, (10, 10, 60, 60), (0, 0, 0, 0), lambda a, _: geo.crop_box(a, F.lit(100), F.lit(100)))) == (4, 4, 66, 66)
    assert tuple(boxes(spark, (200, 200, 210, 210), (0, 0, 0, 0), lambda a, _: geo.crop_box(a, F.lit(100), F.lit(100)))) == (0, 0, 100, 100)
    n = [r[0] for r in spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 5, 9, 10, 36, 900)], "n int").select(geo.grid_columns(F.col("n"))).collect()]
    assert n == [1, 1, 2, 2, 3, 3, 4, 5, 5]


def test_landmarks(spark):
    eyes = [[30.0, 40.0], [65.2, 40.0], [50.0, 60.0], [35.0, 80.0], [62.0, 80.0]]
    at = value(spark, p=(eyes, "array<array<double>>"))
    assert abs(at(geo.eye_span(F.col("p"))) - 35.2) < 1e-9
    moved = at(geo.expanded_landmarks(F.col("p"), 0.5))
    assert moved[:2] == eyes[:2] and np.allclose(moved[2], [48.8, 50.0])
    assert tuple(at(geo.periocular_box(F.col("p"), 1.0))) == (np.floor(47.6 - 56), np.floor(40 - 51.6), np.ceil(47.6 + 56), np.ceil(40 + 60.4))
    for bad in (eyes[:4], [[NAN, 1.0], *eyes[1:]], [[1.0], *eyes[1:]], None, [eyes[0], eyes[0], *eyes[2:]]):
        assert value(spark, p=(bad, "array<array<double>>"))(geo.periocular_box(F.col("p"))) is None
    with pytest.raises(ValueError):
        geo.expanded_landmarks(F.col("p"), 0)


def text(spark, s, f):
    return value(spark, s=(s, "string"))(f(F.col("s")))


@pytest.mark.parametrize("name, want", [("  Bob  ", "Bob"), ("skip", None), ("Unknown", None), ("", None), ("   ", None), (None, None), ("Ann.", "Ann"), ("CON", "_CON"), ("com1", "_com1"), ("a/b:c", "a_b_c"), ("x" * 90, "x" * 64), ("...", None), ("a\x00b", "a_b"), ("\tEve\n", "Eve"), ("y" * 63 + ". z", "y" * 63)])
def test_folder_names(spark, name, want):
    assert text(spark, name, tx.folder_name) == want


@pytest.mark.parametrize("name, want", [("...", "unnamed"), ("John. ", "John"), ("a\x1fb", "a_b"), (None, "unnamed"), ("NUL", "NUL_"), ("x" * 99, "x" * 80), ("skip", "skip")])
def test_gallery_names(spark, name, want):
    assert text(spark, name, tx.gallery_name) == want


def test_keys_and_paths(spark):
    assert text(spark, "ÄAßZ", tx.name_key) == "ÄaßZ".replace("Z", "z") and text(spark, None, tx.name_key) is None
    for p, parts in (("/a/b/C.JPG", ("C.JPG", ".JPG", "C")), ("x\\y.tar.gz", ("y.tar.gz", ".gz", "y.tar")), (".hidden", (".hidden", "", ".hidden")), ("noext", ("noext", "", "noext")), ("/d/", ("", "", ""))):
        assert tuple(text(spark, p, f) for f in (tx.basename, tx.suffix, tx.stem)) == parts
    assert text(spark, "a.jpg", lambda c: tx.resolved_path(c, F.lit("/r/"))) == "/r/a.jpg" and text(spark, "/a.jpg", lambda c: tx.resolved_path(c, F.lit("/r"))) == "/a.jpg"


@pytest.mark.parametrize("s, want", [("1,3 5", [1, 3, 5]), ("3,3,1", [1, 3]), ("", None), ("0", None), ("a", None), ("1,x", None), ("-1", None), (None, None), (" 2 ", [2])])
def test_index_lists(spark, s, want):
    assert text(spark, s, tx.index_list) == want


def test_lists_and_commands(spark):
    assert text(spark, " Ann, ann ,Bob,, ", tx.name_list) == ["Ann", "Bob"] and text(spark, None, tx.name_list) == []
    assert text(spark, "  MERGE 1 2", lambda c: tx.command(c, ["merge"])) == "merge" and text(spark, "x", lambda c: tx.command(c, ["merge"])) is None
    assert text(spark, '["a","b"]', tx.decoded_list) == ["a", "b"] and text(spark, "{bad", tx.decoded_list) == [] and text(spark, None, tx.decoded_list) == []
    merged = value(spark, a=(["x.jpg", "Y.jpg"], "array<string>"), b=(["y.JPG", "z.jpg", "Z.JPG"] + [f"{i}" for i in range(20)], "array<string>"))(tx.merged_samples(F.col("a"), F.col("b"), 8))
    assert merged == ["x.jpg", "Y.jpg", "z.jpg", "0", "1", "2", "3", "4"]


def test_long_name_lists(spark):
    names = [f" {'Name' if i % 3 else 'NAME'} {i * 7919 % 15000}" for i in range(16000)] + ["", " ", "Ärn", "ärn"]
    first = {}
    for n in names:
        first.setdefault(n.strip().lower(), n.strip())
    del first[""]
    assert text(spark, "b,B,a", tx.name_list) == ["b", "a"]
    began = time.monotonic()
    assert text(spark, ",".join(names), tx.name_list) == list(first.values())
    assert time.monotonic() - began < 30  # comparing each name with all before it takes minutes


def test_values_to_show(spark):
    show = lambda v, t, f: value(spark, v=(v, t))(f(F.col("v")))
    assert [show(n, "double", tx.bytes_text) for n in (None, 0.0, 1023.0, 1024.0, 1536.0, 10 * 1024.0, 5e6, 3e12, 9e15)] == ["0 B", "0 B", "1023 B", "1.0 KB", "1.5 KB", "10 KB", "4.8 MB", "2.7 TB", "8185 TB"]
    assert [show(n, "double", tx.duration_text) for n in (None, 3.25, 45.0, 60.0, 95.0, 3600.0, 3725.0)] == ["0.0s", "3.3s", "45s", "1m", "1m 35s", "1h 0m", "1h 2m"]
    assert [show(n, "bigint", lambda c: tx.plural(c, "photo")) for n in (1, 0, 1234)] == ["1 photo", "0 photos", "1,234 photos"]
    assert show(2, "bigint", lambda c: tx.plural(c, "person", "people")) == "2 people"
    now = F.lit(datetime(2024, 5, 10, 12)).cast("timestamp")
    when = [show(d, "timestamp", lambda c: tx.when_text(c, now)) for d in (None, datetime(2024, 5, 10, 11, 59, 30), datetime(2024, 5, 10, 11, 50), datetime(2024, 5, 10, 9), datetime(2024, 5, 8, 12), datetime(2024, 1, 2))]
    assert when == ["", "just now", "10 min ago", "3 h ago", "2 d ago", "Jan 2"]
    assert show("<a&'\">", "string", tx.html_escaped) == "&lt;a&amp;&#x27;&quot;&gt;"
    assert show(b"\x01\x02", "binary", tx.data_url) == "data:image/jpeg;base64,AQI=" and show("x", "string", lambda c: tx.cast_or(c, "int", 7)) == 7
    assert show(datetime(2024, 1, 2, 3, 4, 5), "timestamp", tx.iso_seconds) == "2024-01-02T03:04:05+00:00"
    assert [show(n, "double", lambda c: tx.throughput(F.lit(6), c)) for n in (0.0, 3.0)] == [0, 2]


@pytest.mark.parametrize("wanted, cores, want", [(0, 8, 4), (-1, 2, 1), (3, 8, 3), (99, 8, 8), ("x", 6, 3), (None, 1, 1)])
def test_workers(wanted, cores, want):
    assert tx.workers(wanted, cores) == want
