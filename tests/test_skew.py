"""Per-key work under skew, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kithspark.operators import skew
from kithspark.operators.latest import latest_rows, latest_wide


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(r.choice([1, 1, 1, 2, *range(3, 400), None]) if r.random() < 0.5 else 7, r.choice([None, 0.0, -1.0, 5.0, float("nan")]), f"v{r.randint(0, 60)}") for _ in range(6000)]
    return data, spark.createDataFrame(data, "k int, w double, v string")


def test_heavy_hitters_are_exact(rows):
    data, df = rows
    counts = Counter(k for k, _, _ in data if k is not None)
    total = sum(counts.values())
    for share in (0.3, 0.04, 0.01):
        got = {r.key: r.weight for r in skew.heavy_hitters(df, "k", share).collect()}
        assert got == {k: n for k, n in counts.items() if n >= share * total}


def test_weights_that_are_null_nan_or_not_positive_do_not_count(rows):
    data, df = rows
    sums = Counter()
    for k, w, _ in data:
        if k is not None and w is not None and w > 0:
            sums[k] += w
    got = {r.key: r.weight for r in skew.heavy_hitters(df, "k", 0.05, "w").collect()}
    assert got == {k: n for k, n in sums.items() if n >= 0.05 * sum(sums.values())}


def test_a_key_exactly_at_the_share_counts(spark):
    df = spark.createDataFrame([(1,)] * 4 + [(i,) for i in range(2, 98)], "k int")
    assert [r.key for r in skew.heavy_hitters(df, "k", 0.04).collect()] == [1]


def test_sketch_keeps_heavy_keys_among_many(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, 5).otherwise(F.col("id")).alias("k"))
    assert [r.key for r in skew.heavy_hitters(df, "k", 0.04).collect()] == [5]


def test_empty_table_and_bad_share(spark):
    empty = spark.createDataFrame([], "k int, v string")
    assert skew.heavy_hitters(empty, "k", 0.04).count() == 0
    assert skew.skew_group(empty, "k", "v").count() == 0
    assert skew.skew_join(empty, spark.createDataFrame([], "k int, v string"), "k").columns == ["k", "v", "v_other"]
    with pytest.raises(ValueError):
        skew.heavy_hitters(empty, "k", 0.0001)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_a_plain_join(spark, rows, how):
    data, df = rows
    other = spark.createDataFrame([(k, f"n{k}") for k in [*range(0, 300), None]], "k int, v string")
    got = skew.skew_join(df.select("k", "v"), other, "k", how=how)
    want = df.select("k", "v").join(other.withColumnRenamed("v", "v_other"), "k", how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(got.columns).collect()))


def test_join_with_a_large_heavy_side_is_salted(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    _, df = rows
    other = spark.createDataFrame([(k, i) for k in (1, 7) for i in range(3)], "k int, n int")
    got = skew.skew_join(df.select("k"), other, "k")
    assert got.count() == df.join(other, "k").count()


def test_group_counts(rows):
    data, df = rows
    want = {}
    for k, _, v in data:
        n, s = want.get(k, (0, set()))
        want[k] = (n + 1, s | {v})
    got = {r.k: (r.rows, r.distinct_values) for r in skew.skew_group(df, "k", "v").collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}


def test_latest_row_wins_and_equal_rows_count_once(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 20, "b"), (2, None, "c"), (2, 5, "d"), (3, None, "e"), (None, 9, "x"), (4, 7, "p"), (4, 7, "q")], "id int, at int, v string")
    want = {(1, "b"), (2, "d"), (3, "e"), (4, "q")}
    assert {tuple(r) for r in latest_rows(df, "id", "at", ["v"]).collect()} == want
    assert {tuple(r) for r in latest_wide(df, "id", "at", ["v"]).collect()} == want
