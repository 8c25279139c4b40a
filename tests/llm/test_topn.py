"""The best items of every group, against sorting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kithspark.llm.topn import LoserTree, merge_top, top_n


@given(st.lists(st.lists(st.integers(0, 30)), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    at = [0] * len(runs)
    tree, out = LoserTree([r[0] if r else None for r in runs]), []
    while tree.heads[w := tree.winner] is not None:
        out.append(tree.heads[w])
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == sorted(x for r in runs for x in r)


@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([0.1, 0.5, 0.9]), st.integers(0, 40))), max_size=6), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_merge_seeks_to_the_next_group(runs, n):
    runs = [sorted(r, key=lambda x: (x[0], -x[1], x[2])) for r in runs if r]
    flat = [x for r in runs for x in r]
    g, s, i = (np.array([x[k] for x in flat]) for k in range(3))
    starts = np.cumsum([0, *map(len, runs)])[:-1].tolist()
    got = [flat[p] for p in merge_top(g, s, i, starts, n)]
    want = []
    for key in sorted({x[0] for x in flat}):
        want += sorted((x for x in flat if x[0] == key), key=lambda x: (-x[1], x[2]))[:n]
    assert got == want


@pytest.mark.parametrize("parts", [1, 6])
def test_top_n_with_a_hot_group_ties_nulls_and_repeats(spark, parts):
    r = random.Random(8)
    rows = [(7 if r.random() < 0.4 else r.choice([None, *range(300)]), r.choice([None, float("nan"), 0.5, 0.5, r.random()]), r.choice([None, r.randint(0, 900)])) for _ in range(5000)]
    df = spark.createDataFrame([(*x, "x", i) for i, x in enumerate(rows)], "g int, s double, i bigint, run string, item int").repartition(parts)
    good = [x for x in rows if x[0] is not None and x[2] is not None and x[1] is not None and x[1] == x[1]]
    want = []
    for key in {x[0] for x in good}:
        best = sorted((x for x in good if x[0] == key), key=lambda x: (-x[1], x[2]))[:5]
        want += [(key, k + 1, x[2], x[1]) for k, x in enumerate(best)]
    assert sorted(map(tuple, top_n(df, "g", "s", "i", 5).collect())) == sorted(want)


def test_empty_and_bad_n(spark):
    empty = spark.createDataFrame([], "g int, s double, i bigint")
    assert top_n(empty, "g", "s", "i", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(empty, "g", "s", "i", 0)
