"""Groups of close vectors and nearest vectors, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from kithspark.llm import mixture as mix, neighbours as nbr
from kithspark.llm.vectors import cosines, unit, usable

SCHEMA = "id bigint, vec array<float>"


def faces(n=1500, seed=0, hot=0):
    """Tight groups, a drifting chain, single vectors, copies, and a group that holds ``hot`` of the rows."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n - 80 - hot:
        c = rng.normal(size=64)
        out += [c + rng.normal(scale=rng.uniform(0.2, 0.45), size=64) for _ in range(rng.integers(1, 30))]
    a, b = rng.normal(size=(2, 64))
    out += [np.cos(t) * a / np.linalg.norm(a) + np.sin(t) * b / np.linalg.norm(b) for t in np.linspace(0, 1.5, 60)]
    out += [out[3] * 2.5, out[3], out[3]] + [rng.normal(size=64) for _ in range(17)]
    c = rng.normal(size=64)
    out += [c + rng.normal(scale=0.3, size=64) for _ in range(hot)]
    x = np.array(out[:n] if not hot else out, dtype=np.float32)
    return rng.permutation(len(x) * 3)[: len(x)], x


def cos_matrix(x):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return np.round(y @ y.T, 6)


def true_groups(ids, x, least):
    c = cos_matrix(x) >= least
    root = np.arange(len(ids))
    while True:
        new = np.array([root[c[i]].min() for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    out = {}
    for r in set(root):
        members = ids[root == r]
        if len(members) > 1:
            out |= {int(m): int(members.min()) for m in members}
    return out


@pytest.mark.parametrize("hot", [0, 700])
def test_groups_match_brute_force(spark, hot):
    ids, x = faces(hot=hot)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA).repartition(5)
    groups, density = mix.linked_groups(df, 0.8)
    got, want = {r.id: r.group_id for r in groups.collect()}, true_groups(ids, x, 0.8)
    same = sum(got.get(k) == v for k, v in want.items())
    assert same >= 0.995 * len(want) and not set(got) - set(want)
    typical = {r.group_id: r for r in mix.typical_members(groups, density, 2).collect()}
    assert sum(r["size"] for r in typical.values()) == len(got)
    for g, r in typical.items():
        assert 1 <= len(r.members) <= 2 and all(got[m] == g for m in r.members)


def test_groups_of_few_rows_and_none(spark):
    e = np.eye(64)
    rows = [(5, e[0].tolist()), (9, (e[0] * 3).tolist()), (2, (e[0] + 0.1 * e[1]).tolist()), (4, e[2].tolist())]
    groups, _ = mix.linked_groups(spark.createDataFrame(rows, SCHEMA), 0.8)
    assert {(r.id, r.group_id) for r in groups.collect()} == {(2, 2), (5, 2), (9, 2)}
    groups, density = mix.linked_groups(spark.createDataFrame([], SCHEMA), 0.8)
    assert groups.count() == 0 and density.count() == 0
    groups, _ = mix.linked_groups(spark.createDataFrame([(i, e[0].tolist()) for i in range(40)], SCHEMA), 0.8)
    assert {(r.id, r.group_id) for r in groups.collect()} == {(i, 0) for i in range(40)}


def test_copies_are_typical_members_too(spark):
    e = np.eye(64)
    rows = [(i, (e[0] * i).tolist()) for i in (4, 1, 3, 2, 5)] + [(7, e[3].tolist()), (6, (e[3] + 0.3 * e[4]).tolist()), (8, e[3].tolist())]
    groups, density = mix.linked_groups(spark.createDataFrame(rows, SCHEMA), 0.8)
    assert {r.id for r in density.collect()} == set(range(1, 9)) and density.count() == 8
    got = {r.group_id: (r["size"], list(r.members)) for r in mix.typical_members(groups, density).collect()}
    assert got[1] == (5, [1, 2, 3]) and got[6][0] == 3 and sorted(got[6][1]) == [6, 7, 8]


def test_link_at_the_threshold(spark):
    a, b = np.zeros(64), np.zeros(64)
    a[0], b[0], b[1] = 1, 0.8, 0.6
    rows = [(1, a.tolist()), (2, b.tolist()), (3, (-a).tolist())]
    groups, _ = mix.linked_groups(spark.createDataFrame(rows, SCHEMA), 0.8)
    assert {r.id for r in groups.collect()} == {1, 2}


@pytest.mark.parametrize("local", [10_000, 150])
def test_a_cell_is_linked_exactly_enough(local, monkeypatch):
    monkeypatch.setattr(mix, "LOCAL", local)
    ids, x = faces(900, 3)
    root = mix.link_cell(ids.astype(np.int64), unit(x), np.ones(len(ids), bool), 0.8)
    got = {int(i): int(r) for i, r in zip(ids, root)}
    want = true_groups(ids, x, 0.8)
    assert sum(got[i] == v for i, v in want.items()) >= (1 if local > 900 else 0.99) * len(want)
    assert all(got[i] == i for i in got if i not in want)


def test_an_oversize_cell_is_linked_as_a_whole(monkeypatch):
    # Each fifth row is at home; the groups drift, so that parts of a cell would share few of their links.
    rng = np.random.default_rng(2)
    base = rng.normal(size=64) * 0.5
    x = unit((np.repeat(rng.normal(size=(400, 64)) + base, 10, 0) + rng.normal(scale=0.4, size=(4000, 64))).astype(np.float32))
    ids, home = rng.permutation(4000).astype(np.int64), np.arange(4000) % 5 == 0
    want = mix.link_cell(ids, x, home, 0.8)
    monkeypatch.setattr(mix, "LOCAL", 300)
    monkeypatch.setattr(mix, "BLOCK", 128)
    assert (mix.link_cell(ids, x, home, 0.8) == want).all() and (want != ids).sum() > 1000


def test_information_criterion_and_regularised_covariance():
    rng = np.random.default_rng(1)
    y = np.repeat(rng.normal(size=(4, 8)), 50, axis=0).astype(np.float32)
    m = mix.fit(y, 200, 8.0)
    assert (m.var > 0).all() and np.isfinite(m.log_density(y)).all() and abs(m.weight.sum() - 1) < 1e-6
    spread = (rng.normal(size=(6, 8)) * 3).astype(np.float32)
    y = (np.repeat(spread, 200, axis=0) + rng.normal(scale=0.05, size=(1200, 8))).astype(np.float32)
    few, many = mix.fit(y, 1200, 2.0), mix.fit(y, 1200, 10.0)
    assert len(few) <= 3 and len(many) >= 6  # the likelihood asks for more, the criterion has the last word
    noise = rng.normal(size=(400, 8)).astype(np.float32)
    assert len(mix.fit(noise, 400, 10.0)) == 6  # nothing to tell apart: the fewest of the candidates


def test_components_divide_the_table(spark):
    ids, x = faces(4000, 11)
    df = spark.createDataFrame([(int(i), bytearray(v.tobytes())) for i, v in zip(ids, unit(x))], "id bigint, vec binary")
    n, m = mix.fit_mixture(df)
    assert n == len(ids) and len(m.fine) >= 2 and m.fine.mean.shape[1] == mix.REDUCED
    best, value = m.weigh(m.reduced(unit(x)))
    row, cell, own = mix._visits(best, value, m.margin)
    assert len(row) <= mix.VISITS * n * 1.2 and set(row) == set(range(n))
    assert np.bincount(own, minlength=len(m.fine)).max() < 0.6 * n


def test_every_home_row_meets_every_visitor_once_components_are_dealt_out():
    rng = np.random.default_rng(5)
    ids = rng.permutation(1000)[:200].astype(np.int64)
    own = rng.integers(0, 3, 200)
    row, cell = np.nonzero(rng.random((200, 3)) < 0.6)
    extra = np.setdiff1d(np.arange(200) * 3 + own, row * 3 + cell)
    row, cell = np.r_[row, extra // 3], np.r_[cell, extra % 3]
    for homes, visitors in (([1, 1, 1], [1, 1, 1]), ([1, 3, 2], [4, 1, 3])):
        r, c, h, v, home, first = mix.dealt(ids, row, cell, own, np.array(homes), np.array(visitors))
        met = set()
        for key in set(zip(c.tolist(), h.tolist(), v.tolist())):
            here = (c == key[0]) & (h == key[1]) & (v == key[2])
            assert len(set(r[here])) == here.sum()
            met |= {(key[0], a, b) for a in r[here & home] for b in r[here]}
        assert met == {(k, a, b) for k in range(3) for a in np.flatnonzero(own == k) for b in row[cell == k]}
        assert sorted(r[first]) == list(range(200))


def test_groups_are_the_same_with_large_components_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mix, "HOMES", 40)
    monkeypatch.setattr(mix, "VISITORS", 90)
    ids, x = faces(900, 12, hot=300)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    groups, density = mix.linked_groups(df, 0.8)
    got, want = {r.id: r.group_id for r in groups.collect()}, true_groups(ids, x, 0.8)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.995 * len(want) and not set(got) - set(want)
    assert density.count() == len(ids) == density.select("id").distinct().count()


def true_best(ids, x, k, least):
    c = cos_matrix(x)
    np.fill_diagonal(c, -2)
    out = {}
    for i in range(len(ids)):
        j = np.flatnonzero(c[i] >= least)
        out[int(ids[i])] = [int(ids[q]) for q in j[np.lexsort((ids[j], -c[i, j]))][:k]]
    return out


def found(df, k=5, least=0.8):
    return {(r.signal, r.id): [p.id for p in r.partners] for r in nbr.nearest(df, k, least).collect()}


def test_nearest_recall(spark):
    ids, x = faces(2500, 4, hot=900)
    df = spark.createDataFrame([("a", int(i), v.tolist()) for i, v in zip(ids, x)], "signal string, id bigint, vec array<float>")
    got, want = found(df), true_best(ids, x, 5, 0.8)
    pairs = {(i, j) for i, p in want.items() for j in p}
    have = {(i, j) for (_, i), p in got.items() for j in p}
    assert len(pairs & have) >= 0.9 * len(pairs)


@pytest.mark.parametrize("again", [10_000, 60])
def test_search_in_a_bucket(again, monkeypatch):
    monkeypatch.setattr(nbr, "AGAIN", again)
    ids, x = faces(900, 5)
    u = unit(x)
    i, j, c = nbr.search_bucket(ids.astype(np.int64), u, 5, 0.8)
    want = {(a, b) for a, p in true_best(ids, x, 5, 0.8).items() for b in p}
    got = {(int(ids[a]), int(ids[b])) for a, b in zip(i, j)}
    assert got == want if again > 900 else len(got & want) >= 0.95 * len(want)
    assert (np.bincount(i) <= 5).all() and (c >= 0.8).all()


def test_search_in_a_large_bucket_is_exact(monkeypatch):
    monkeypatch.setattr(nbr, "AGAIN", 60)
    monkeypatch.setattr(nbr, "AREA", 6_000)
    ids, x = faces(1500, 7, hot=300)
    want = true_best(ids, x, 5, 0.8)
    i, j, _ = nbr.search_bucket(ids.astype(np.int64), unit(x), 5, 0.8)
    assert [(int(ids[a]), int(ids[b])) for a, b in zip(i, j)] == [(int(a), b) for a in ids for b in want[int(a)]]


def test_hot_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(nbr, "BUCKET", 60)
    monkeypatch.setattr(nbr, "_axes", lambda n, *_: (64,))
    ids, x = faces(2000, 6, hot=800)
    df = spark.createDataFrame([("a", int(i), v.tolist()) for i, v in zip(ids, x)], "signal string, id bigint, vec array<float>")
    monkeypatch.setattr(nbr, "HOT", 180)
    monkeypatch.setattr(nbr, "LOOKED_AT", 1)
    looked = spark.createDataFrame([("a", int(i), bytearray(v.tobytes())) for i, v in zip(ids, unit(x))], "signal string, id bigint, looked binary")
    hot = nbr._hot_buckets(looked, {"a": len(ids)}, {"a": (64,)})["a"]
    assert hot and all(m.shape == (64,) for m, _ in hot.values())
    row, key = nbr._placed(unit(x), 0, (64,), 4, hot)
    assert set(row) == set(range(len(x))) and (key < 0).any() and not set(key) & set(hot)
    before = np.unique(nbr._placed(unit(x), 0, (64,), 4, {})[1], return_counts=True)[1].max()
    assert np.unique(key, return_counts=True)[1].max() < before
    want = {(i, j) for i, p in true_best(ids, x, 5, 0.8).items() for j in p}
    # Within the hot group all are about equally far, the hardest case there is.
    got = {(i, j) for (_, i), p in found(df).items() for j in p}
    assert len(got & want) >= 0.6 * len(want) and len({i for i, _ in got}) >= 0.98 * len({i for i, _ in want})


def test_many_copies_and_ties_go_to_the_smaller_id(spark):
    e = np.eye(64)
    rows = [("a", i, e[0].tolist()) for i in range(20)] + [("b", i, (e[0] * 2).tolist()) for i in (1, 2)] + [("a", 100, (e[0] + 0.2 * e[1]).tolist()), ("a", 200, e[5].tolist())]
    got = found(spark.createDataFrame(rows, "signal string, id bigint, vec array<float>"))
    assert got["a", 0] == [1, 2, 3, 4, 5] and got["a", 3] == [0, 1, 2, 4, 5] and got["a", 19] == [0, 1, 2, 3, 4] and got["a", 100] == [0, 1, 2, 3, 4]
    assert got["b", 1] == [2] and ("a", 200) not in got
    assert found(spark.createDataFrame([], "signal string, id bigint, vec array<float>")) == {}


def test_hadamard_keeps_lengths_and_hash_is_the_nearest_axis():
    x = np.random.default_rng(0).normal(size=(50, 64)).astype(np.float32)
    y = nbr.rotate(x, 3)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-4)
    axis, _ = nbr.nearest_axes(y, 2)
    assert (axis[:, 0] // 2 == np.abs(y).argmax(1)).all()
    assert [nbr._axes(n) for n in (10, 10**6, 10**7, 10**8, 10**10)] == [(64,), (64,), (64, 1), (64, 8), (64, 64, 7)]


@pytest.mark.parametrize("axes", [(64,), (64, 1), (64, 2), (64, 16), (64, 64, 3)])
def test_a_vector_is_put_into_equally_many_buckets_at_every_size(axes):
    x = unit(np.random.default_rng(0).normal(size=(500, 64)).astype(np.float32))
    keys = nbr.buckets(x, 0, axes, nbr.PROBES)
    assert keys.shape == (500, nbr.PROBES) and all(len(set(k)) == nbr.PROBES for k in keys.tolist())
    own = nbr.buckets(x, 0, axes, 1)
    assert (keys[:, 0] == own[:, 0]).all()


@pytest.mark.parametrize("n", [10**6, 10**7, 4 * 10**7])
def test_recall_with_the_buckets_of_larger_tables(spark, monkeypatch, n):
    axes = nbr._axes(n)
    monkeypatch.setattr(nbr, "_axes", lambda n, *_: axes)
    ids, x = faces(2500, 14)
    df = spark.createDataFrame([("a", int(i), v.tolist()) for i, v in zip(ids, x)], "signal string, id bigint, vec array<float>")
    got, want = found(df), true_best(ids, x, 5, 0.8)
    pairs = {(min(i, j), max(i, j)) for i, p in want.items() for j in p}
    have = {(min(i, j), max(i, j)) for (_, i), p in got.items() for j in p}
    assert len(pairs & have) >= 0.9 * len(pairs)


def test_search_of_a_large_bucket_by_an_inner_hash(monkeypatch):
    monkeypatch.setattr(nbr, "INNER", 500)
    monkeypatch.setattr(nbr, "PAIRS", 900)
    ids, x = faces(1500, 9)
    i, j, c = nbr.search_bucket(ids.astype(np.int64), unit(x), 5, 0.8)
    want = {(a, b) for a, p in true_best(ids, x, 5, 0.8).items() for b in p}
    got = {(int(ids[a]), int(ids[b])) for a, b in zip(i, j)}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(i) and (np.bincount(i) <= 5).all()


def test_usable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [None, [], [1.0] * 64, [0.0] * 64, [nan] + [1.0] * 63, [inf] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 63]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<float>")
    assert [r.i for r in df.where(usable("v")).collect()] == [2]


def test_extreme_lengths_do_not_overflow():
    x = np.array([[1e38] * 64, [1e-38] * 64], dtype=np.float32)
    assert np.allclose(np.linalg.norm(unit(x), axis=1), 1) and cosines(unit(x)[:1], unit(x)[1:])[0] == 1
