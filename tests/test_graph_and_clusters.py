"""Components, density clusters, de-duplication, reconciliation and whole clustering."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithspark.operators import clustering as clu
from kithspark.operators.graph import close_pairs, connected_components, density_clusters

FACE = "face_id bigint, image_path string, x1 int, y1 int, x2 int, y2 int, embedding array<float>, eye_embedding array<float>, score double"


def union(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    for n, m in ((60, 40), (400, 380), (50, 300)):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == union({x for e in edges for x in e}, edges)


def test_components_of_a_path_a_star_loops_and_nulls(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(500)] + [(5000, 5000), (None, 3), (4, None), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[2499] == 1000 and got[5000] == 5000
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors(spark, n=120, d=8, missing=0.3, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d))
    full = centre[rng.integers(0, 12, n)] + rng.normal(scale=0.35, size=(n, d))
    eye = [None if rng.random() < missing else (full[i, :4] + rng.normal(scale=0.2, size=4)).tolist() for i in range(n)]
    rows = [(i, full[i].tolist(), eye[i]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, full array<float>, eye array<float>")


def distance(a, b):
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    f = cos(np.float32(a[1]).astype(float), np.float32(b[1]).astype(float))
    if a[2] is None or b[2] is None:
        return 1 - f
    return 1 - (0.4 * f + 0.6 * cos(np.float32(a[2]).astype(float), np.float32(b[2]).astype(float)))


@pytest.mark.parametrize("block", [17, 5000])
def test_close_pairs_are_all_pairs(spark, block):
    rows, df = vectors(spark)
    want = {(a[0], b[0]): distance(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if distance(a, b) <= 0.3}
    got = {(r.a, r.b): r.distance for r in close_pairs(df, 0.3, eye="eye", block=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("m", [1, 3, 5])
def test_density_clusters(spark, m):
    rows, df = vectors(spark, missing=1.0)
    pairs = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if distance(a, b) <= 0.08]
    near = {r[0]: {r[0]} for r in rows}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    core = {x for x in near if len(near[x]) >= m}
    label = union(core, [(a, b) for a, b in pairs if a in core and b in core])
    want = {x: label[x] if x in core else min((label[y] for y in near[x] & core), default=-1) for x in near}
    got = {r.id: r.label for r in density_clusters(df, close_pairs(df, 0.08), m).collect()}
    assert got == want
    with pytest.raises(ValueError):
        density_clusters(df, close_pairs(df, 0.08), 0)


def boxes(spark, rows):
    return spark.createDataFrame([(i, p, *b, [1.0], None, s) for i, (p, b, s) in enumerate(rows)], FACE)


def kept(df):
    return sorted(r.face_id for r in df.collect())


def test_double_boxes(spark):
    rows = [("p", (10, 10, 60, 60), 0.98), ("p", (14, 12, 62, 58), 0.7), ("p", (200, 10, 250, 60), 0.95), ("q", (10, 10, 60, 60), 0.5)]
    assert kept(clu.deduplicated(boxes(spark, rows))) == [0, 2, 3]
    assert kept(clu.deduplicated(boxes(spark, [("p", (0, 0, 100, 100), 0.6), ("p", (35, 35, 65, 65), 0.9)]))) == [1]
    overlap = [("p", (0, 0, 10, 10), 0.9), ("p", (5, 0, 15, 10), 0.8), ("p", (1, 1, 11, 11), 0.7), ("p", (50, 50, 60, 60), 0.6)]
    assert kept(clu.deduplicated(boxes(spark, overlap), proximity=None)) == [0, 1, 3]


def test_double_boxes_with_nulls_ties_and_extra_columns(spark):
    rows = [("p", (0, 0, 10, 10), None), ("p", (0, 0, 10, 10), float("nan")), ("p", (0, 0, 10, 10), 0.2), (None, (0, 0, 10, 10), 0.1), (None, (0, 0, 10, 10), 0.1), ("p", (0, None, 10, 10), 0.9), ("t", (0, 0, 9, 9), 0.5), ("t", (0, 0, 9, 9), 0.5)]
    df = boxes(spark, rows).withColumn("b", F.create_map(F.lit("a"), F.lit(1))).withColumn("e", F.lit(1)).withColumn("row", F.lit("x"))
    out = clu.deduplicated(df)
    assert kept(out) == [2, 3, 4, 5, 6] and out.columns == df.columns
    assert clu.deduplicated(df.limit(0)).count() == 0


def test_double_boxes_match_a_plain_greedy_pass(spark):
    import random

    r = random.Random(2)
    rows = []
    for i in range(400):
        x, y = r.randint(0, 120), r.randint(0, 120)
        rows.append((f"p{i % 9}", (x, y, x + r.randint(1, 50), y + r.randint(1, 50)), r.choice([0.1, 0.5, 0.9, r.random()])))

    def same(a, b):
        w = max(0, min(a[2], b[2]) - max(a[0], b[0]))
        h = max(0, min(a[3], b[3]) - max(a[1], b[1]))
        area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
        if w * h and w * h / (area(a) + area(b) - w * h) >= 0.5:
            return True
        diag = min(np.hypot(c[2] - c[0], c[3] - c[1]) for c in (a, b))
        return np.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) <= 0.35 * diag

    stay: dict = {}
    for i in sorted(range(400), key=lambda i: (-rows[i][2], i)):
        mine = stay.setdefault(rows[i][0], [])
        if not any(same(rows[i][1], rows[k][1]) for k in mine):
            mine.append(i)
    assert kept(clu.deduplicated(boxes(spark, rows))) == sorted(i for v in stay.values() for i in v)


@pytest.mark.parametrize(
    "groups, labels, coverage, want",
    [
        ([[0, 1], [2, 3]], [0, 0, 1, 1], [1] * 4, [{0, 1}, {2, 3}]),
        ([[0, 1]], [0, 1, 2, 3], [1] * 4, [{0, 1}, {2}, {3}]),
        ([[0], [1, 2]], [0, 1, 1, -1], [1, 1, 1, 0], [{0}, {1, 2}, {3}]),
        ([[0]], [5, 5, 5], [1, 0, 0], [{0}, {1, 2}]),  # a lone eye face leaves its cluster
        ([[0, 1, 2]], [0, 1, 2, 2], [1, 1, 0, 0], [{0}, {1}, {2, 3}]),  # contradicted: dropped
    ],
)
def test_reconciliation(spark, groups, labels, coverage, want):
    faces = spark.createDataFrame([(i, float(c)) for i, c in enumerate(coverage)], "id bigint, coverage double")
    eye = spark.createDataFrame([(i, g) for g, m in enumerate(groups) for i in m], "id bigint, eye_group int")
    full = spark.createDataFrame(list(enumerate(labels)), "id bigint, full_label bigint")
    got: dict = {}
    for r in clu.reconciled(faces, eye, full).collect():
        got.setdefault(r.label, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and sorted(got) == list(range(len(want)))


def face_rows(spark, groups, d=64, noise=0.01, eye=None, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(groups):
        for _ in range(n):
            v = np.eye(d)[g] + rng.normal(scale=noise, size=d)
            i = len(rows)
            rows.append((i, f"{i}.jpg", 0, 0, 10, 10, v.tolist(), eye(i) if eye else None, 0.9))
    return rows, spark.createDataFrame(rows, FACE)


def clusters(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.face_id)
    return out


def test_clusters_and_minimum_size(spark):
    _, df = face_rows(spark, [4, 3, 1])
    assert clusters(clu.cluster_faces(df)) == {0: {0, 1, 2, 3}, 1: {4, 5, 6}}
    _, one = face_rows(spark, [1])
    assert clusters(clu.cluster_faces(one)) == {} and clusters(clu.cluster_faces(one, min_faces=1)) == {0: {0}}
    assert clusters(clu.cluster_faces(df.limit(0))) == {}
    for bad in (0, -1, 2.5):
        with pytest.raises(ValueError):
            clu.cluster_faces(df, tolerance=bad)


def test_unusable_vectors_are_left_out(spark):
    rows, _ = face_rows(spark, [3])
    rows += [(10, "x", 0, 0, 1, 1, [float("nan")] * 64, None, 1.0), (11, "y", 0, 0, 1, 1, [0.0] * 64, None, 1.0), (12, "z", 0, 0, 1, 1, None, None, 1.0), (13, "w", 0, 0, 1, 1, [1.0, None], None, 1.0)]
    assert clusters(clu.cluster_faces(spark.createDataFrame(rows, FACE))) == {0: {0, 1, 2}}


def test_one_radian_apart(spark):
    rows = [(0, "a", 0, 0, 9, 9, [1.0, 0.0], None, 1.0), (1, "b", 0, 0, 9, 9, [float(np.cos(1)), float(np.sin(1))], None, 1.0)]
    df = spark.createDataFrame(rows, FACE)
    assert clusters(clu.cluster_faces(df)) == {0: {0, 1}} and clusters(clu.cluster_faces(df, tolerance=0.05)) == {}


def test_equal_eyes_join_faces_that_differ(spark):
    _, df = face_rows(spark, [1, 1, 1, 1], eye=lambda i: [1.0, 0.0, 0.0])
    assert clusters(clu.cluster_faces(df)) == {0: {0, 1, 2, 3}}
    assert len(clusters(clu.cluster_faces(df, weights=(1, 0), min_faces=1))) == 4
    assert len(clusters(clu.cluster_faces(df, use_eyes=False, min_faces=1))) == 4


def test_every_face_lands_once_however_rows_are_spread(spark):
    rng = np.random.default_rng(9)
    _, df = face_rows(spark, [6, 5, 4, 3], noise=0.05, eye=lambda i: None if i % 3 == 0 else (np.eye(8)[i % 4] + rng.normal(scale=0.1, size=8)).tolist())
    one, two = (clusters(clu.cluster_faces(df.repartition(n), min_faces=1)) for n in (1, 7))
    assert one == two and sorted(x for m in one.values() for x in m) == list(range(18)) and sorted(one) == list(range(len(one)))


def test_centroids_and_profiles(spark):
    rows = [(0, "a", 0, 0, 1, 1, [3.0, 0.0], [0.0, 2.0], 1.0), (1, "a", 0, 0, 1, 1, [0.0, 3.0], None, 1.0), (2, "b", 0, 0, 1, 1, [1.0, 0.0], None, 1.0), (3, "c", 0, 0, 1, 1, [-1.0, 0.0], None, 1.0)]
    df = spark.createDataFrame(rows, FACE).withColumn("cluster_id", F.when(F.col("face_id") < 2, 0).otherwise(1))
    p = {r.cluster_id: r for r in clu.profiles(df).collect()}
    assert np.allclose(p[0].centroid, [2**-0.5] * 2) and p[0].size == 2 and p[0].photos == 1 and p[0].eye_coverage == 0.5 and p[0].eye_centroid == [0.0, 1.0]
    assert p[1].centroid == [0.0, 0.0] and p[1].eye_centroid is None


def test_components_of_many_edges_in_rounds(spark, monkeypatch):
    from kithspark.operators import graph

    monkeypatch.setattr(graph, "EDGES", 40)
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (400, 2))] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 2000 + i) for i in range(120)] + [(9, 9), (9000, 9000)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == union({x for e in edges for x in e}, edges)


@pytest.mark.parametrize("block", [3, 4, 100])
def test_one_eye_length_counts_for_the_whole_table(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), rng.normal(size=3 if i % 5 < 3 else 4).tolist()) for i in range(15)]
    df = spark.createDataFrame(rows, "id bigint, full array<float>, eye array<float>")
    plain = [(i, f, e if len(e) == 3 else None) for i, f, e in rows]
    want = {(a[0], b[0]) for k, a in enumerate(plain) for b in plain[k + 1 :] if distance(a, b) <= 0.9}
    assert {(r.a, r.b) for r in close_pairs(df, 0.9, eye="eye", block=block).collect()} == want


def test_pairs_within_a_scope_and_by_another_metric(spark):
    rows = [(i, [1.0, i / 10], None if i == 5 else i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "id bigint, full array<float>, lib int")
    got = {(r.a, r.b) for r in close_pairs(df, 0.5, scope="lib", block=2).collect()}
    assert got == {(a, b) for a in range(8) for b in range(a + 1, 8) if a % 2 == b % 2 and 5 not in (a, b)}
    one = lambda x, y: 1 - np.abs(x[:, 1][:, None] - y[:, 1][None, :])
    near = {(r.a, r.b) for r in close_pairs(df, 0.11, metric=one).where("a = 0").collect()}
    assert near == {(0, 1)}


def test_vectors_are_checked(spark):
    df = lambda *rows: spark.createDataFrame([(r,) for r in rows], "v array<float>")
    assert clu.check_vectors(df([1.0, 2.0], [0.0, 3.0]), "v") == 2 and clu.check_vectors(df(), "v") == 0
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None], [[float("nan")]], [[]], [[None]]):
        with pytest.raises(ValueError):
            clu.check_vectors(df(*bad), "v")


def test_clusters_of_each_scope(spark):
    rows = [(i, "p%d" % i, 0, 0, 9, 9, v, e, 0.9, lib) for i, (v, e, lib) in enumerate([([1, 0], None, 1), ([1, 0.1], None, 1), ([0, 1], None, 1), ([1, 0], [1, 0], 2), ([1, 0.1], [1, 0], 2), ([1, 0], [1, 0], 3), ([1, 0.05], [0, 1], 3), ([1, 0.1], [1, 0.1], 3), ([1, 0.02], None, 3), ([1, 0], None, None)])]
    df = spark.createDataFrame([(*r[:6], [float(x) for x in r[6]], r[7] and [float(x) for x in r[7]], *r[8:]) for r in rows], FACE + ", library_id int")
    got = {(r.library_id, r.face_id): r.cluster_id for r in clu.cluster_faces(df, 0.2, scope="library_id").collect()}
    for lib in (1, 2, 3):  # as if each were the only one
        alone = {r.face_id: r.cluster_id for r in clu.cluster_faces(df.where(F.col("library_id") == lib), 0.2).collect()}
        assert {k[1]: v for k, v in got.items() if k[0] == lib} == alone and alone
    assert {k[0] for k in got} == {1, 2, 3}
