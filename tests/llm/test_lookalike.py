"""Texts that look the same."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from kithspark.llm.lookalike import Classes, confusable, consistent, chosen_names, look_alike_pairs

SAME = [
    ("Harriet Nadílmark", "Harriet Nad‌ílmark"),
    ("Ingeborg", "Ιngebοrg"),
    ("Isabella", "IsabeIla"),
    ("Sommer", "Ｓｏｍｍｅｒ"),
    ("José", "José"),
    ("Tuấn", "Tuấn"),
    ("Tuấn", "Tuá̂n"),
    ("a b", "a b"),
    ("a b", " a　b "),
    ("Kelvin", "Kelvin"),
    ("Anna-Maria", "Anna‑Maria"),
    ("Оксана", "Okcaнa".replace("k", "к")),
    ("최가람", "최가람"),
    ("オガワ", "オガワ"),
    ("ﬁne", "fine"),
    ("ＩＩ", "ll"),
]
DIFFERENT = [("Anna", "anna"), ("José", "Jose"), ("Bern", "Bem"), ("a b", "a  b"), ("a b", "ab"), ("x²", "x2"), ("Müller", "Mueller"), ("O", "0"), ("łucja", "lucja"), ("", "x")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert confusable([(a, b)], Counter(a + b)) == [True]


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert confusable([(a, b)], Counter(a + b)) == [False]


def test_classes_are_transitive():
    c = Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        c.union(a, b)
    assert len({c.find(x) for x in "abcd"}) == 1 and c.find("e") == "e"


def test_more_frequent_members_stand_for_their_class():
    from kithspark.llm.lookalike import Rewriter, rewrites

    for often, rare in (("a", "а"), ("а", "a")):
        assert Rewriter(rewrites({often: 9, rare: 1}))(often + rare) == often * 2


def test_frames(spark):
    rows = [(1, 1, "Anna"), (2, 1, "Аnna"), (3, 1, "Anna​"), (4, 2, "Аnnа"), (5, 1, None), (6, 1, ""), (7, 1, "​"), (8, None, "Anna"), (None, 1, "Annа"), (9, 1, "anna"), (10, 1, "Anna"), (11, 1, "x" * 30_000)]
    df = spark.createDataFrame([(*r, "n", "f", 0) for r in rows], "k int, g int, t string, form string, __f string, a int")
    got = {(r.a, r.b) for r in look_alike_pairs(df, "k", "g", "t").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 10), (3, 10), (6, 7)}
    out = consistent(df, "t")
    assert out.count() == len(rows) and set(out.columns) == set(df.columns)
    assert {r.k: r.form for r in out.collect()}[5] is None
    names = {r.k: r.chosen for r in chosen_names(df, "k", "g", "t").collect()}
    assert names[2] == names[3] == "Anna" and names[5] is None and names[9] == "anna"
    assert look_alike_pairs(df.limit(0), "k", "g", "t").count() == 0


def test_disguises_are_undone(spark):
    r = random.Random(3)
    swap = {"a": "а", "e": "е", "o": "ο", "p": "р", "A": "Α", "H": "Н", "i": "і"}

    def disguise(s):
        return "".join(swap.get(c, c) if r.random() < 0.5 else c + r.choice(["", "", "​", "⁠", "­"]) for c in s) + r.choice(["", " ", " "])

    names = ["".join(r.choice("aeopAHilmnrst ") for _ in range(12)).strip() for _ in range(60)]
    pairs = [(n, disguise(n)) for n in names if "  " not in n]
    assert all(confusable(pairs, Counter("".join(a + b for a, b in pairs))))
