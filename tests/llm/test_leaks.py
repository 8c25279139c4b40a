"""Test items in a corpus, against a search without an index."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kithspark.llm.leaks import Numbers, align, best_run, find_leaks, grams, number, plain_words, seeds_of

R = random.Random(6)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(400)]
ITEM = " ".join(R.choice(WORDS) for _ in range(40))


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def leaks_in(passage, item, least=18, per=8):
    """Whether the item leaked into the passage, with every second gram as a seed."""
    words = plain_words(item)
    a, where = [number(p) for w in words for p in w], [n for n, w in enumerate(words) for _ in w]
    token, own = Numbers().of(passage), grams(np.array(a, np.int64))
    seeds = seeds_of([1] * len(own))
    held = grams(np.array(token, np.int64))
    diagonals = {int(at) - k for k in seeds for at in np.flatnonzero(held == own[k])}
    return best_run(token, a, where, list(diagonals), least, per)[0] >= least


def leak(words):
    return leaks_in(f"{text(30)} {words} {text(30)}", ITEM)


def replaced(words, every):
    w = words.split()
    for i in range(every // 2, len(w), every):
        w[i] = "zzz"
    return " ".join(w)


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s,
        str.upper,
        lambda s: " ".join(s.split()[7:25]),
        lambda s: s.replace(" ", "  \n"),
        lambda s: ", ".join(s.split()),
        lambda s: "<p>" + s.replace("a", "<b>a</b>") + "</p>",
        lambda s: s.replace("e", "é").replace("o", "ő"),
        lambda s: s.replace("b", "b​").replace(" ", "&nbsp;"),
        lambda s: "> " + s.replace(" ", '" ', 3),
        lambda s: replaced(s, 8),
        lambda s: replaced(" ".join(s.split()[:18]), 9),
    ],
)
def test_found(change):
    assert leak(change(ITEM))


@pytest.mark.parametrize("change", [lambda s: " ".join(s.split()[:17]), lambda s: replaced(s, 4), lambda s: " ".join(reversed(s.split())), lambda s: "", lambda s: " x ".join([" ".join(s.split()[:9]), text(12), " ".join(s.split()[20:29])])])
def test_not_found(change):
    assert not leak(change(ITEM))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 41])
def test_every_run_of_six_words_holds_a_seed_and_the_rarest_serve(n):
    for _ in range(20):
        often = [R.randint(1, 9) for _ in range(n)]
        chosen = seeds_of(often)
        assert all(k in chosen or k + 1 in chosen for k in range(n - 1)) and sorted(set(chosen)) == chosen
        if 0 < n <= 8:
            ways = [w for w in range(1, 1 << n) if all(w >> k & 3 for k in range(n - 1))]
            assert sum(often[k] for k in chosen) == min(sum(often[k] for k in range(n) if w >> k & 1) for w in ways)
    assert seeds_of([5]) == [0]


def test_words_and_grams_as_numbers():
    numbers = Numbers()
    assert numbers.of("A-b  CÉ, ‘d’") == [number(x) for x in ("a", "b", "ce", "d")] and numbers.of(None) == numbers.of("") == []
    x = np.arange(9) * 7 - 20
    assert len(grams(x)) == 5 and grams(x)[2] == grams(x[2:7])[0] and len(grams(x[:4])) == 0 and len(set(grams(x).tolist())) == 5


def test_alignment_bridges_a_gap():
    a = "a b c d e f g h".split()
    pairs = align(a, "x a b c d q e f g h".split(), -4, 4)
    assert [i for i, _ in pairs if i >= 0] == list(range(8)) and sum(i < 0 for i, _ in pairs) == 1


def test_plain_words():
    assert plain_words("Scan-0961.JPG is <b>bo</b>ld, it's l’été") == [["scan", "0961", "jpg"], ["is"], ["bold"], ["its"], ["lete"]]
    assert plain_words("divi-\nded") == [["divided"]] and plain_words("") == [] and plain_words("— …") == []


@pytest.mark.parametrize("change", [{}, {"IN_FULL": 0, "MOST_BITS": 1 << 16}, {"BROADCAST_ROWS": 0, "ITEM_WORDS": 0}])
def test_frames_with_what_is_sent_and_what_is_joined(spark, monkeypatch, change):
    from kithspark.llm import leaks

    docs = [(i, text(40)) for i in range(30)] + [(100, f"{text(9)} {ITEM}"), (100, f"{text(9)} {ITEM}"), (101, None), (102, ""), (None, ITEM), (103, text(5000) + " " + " ".join(ITEM.split()[3:25]))]
    d = spark.createDataFrame([(*x, 5) for x in docs], "id bigint, t string, words int")
    other = text(60)
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, text(60)), (3, None), (None, ITEM), (4, ""), (1, other)], "id bigint, t string")
    d = d.unionByName(spark.createDataFrame([(104, f"so {other} then {ITEM}", 1)], d.schema))
    for name, value in change.items():
        monkeypatch.setattr(leaks, name, value)
    got = find_leaks(d, "id", "t", items, "id", "t")
    assert sorted((r.id, r.id_item) for r in got.collect()) == [(100, 1), (100, 1), (103, 1), (104, 1)]
    assert find_leaks(d.limit(0), "id", "t", items, "id", "t").count() == find_leaks(d, "id", "t", items.limit(0), "id", "t").count() == 0


def test_markup_of_any_length():
    long = "data:image/png;base64," + "Ab9+/" * 400
    for text in (f'one <img alt="a > b" src="{long}"> two', f"one <img src={long} hidden /> two", f"one [](https://x.y/?q={long}) two", f"one <!-- {'no <b>one</b> sees this ' * 40} --> two", f'o<a href="{long}">n</a>e two'):
        assert [w for w in plain_words(text) if w] == [["one"], ["two"]]
    prose = "where a <b and " + "so on and on " * 40 + "c> d"
    assert len(plain_words(prose)) > 160
    for hostile in ('<a x="' * 100_000, "<!--" * 100_000, "](a" * 100_000, "<a x=1 " * 100_000):
        plain_words(hostile)


@pytest.mark.parametrize("wrong, want", [((1, 2), True), ((15, 16), True), ((1, 16), True), ((0,), False), ((17,), False), ((1, 2, 9), False), ((14, 15, 16), False)])
def test_replaced_words_near_the_ends(wrong, want):
    words = " ".join("zzz" if i in wrong else w for i, w in enumerate(ITEM.split()[11:29]))
    assert leaks_in(words, ITEM) == want
    assert leaks_in(f"qqq {words} qqq", ITEM) == want
