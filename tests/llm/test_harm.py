"""Scores for harmful content: disguises, held-out sentences, and the fit itself."""

from __future__ import annotations

import math
import random

import pytest

from kithspark.llm import harm
from kithspark.llm.harm import Model, fit_harm, ftrl, harm_scores, plain_word, sentences, source_rates, windows, words_of
from kithspark.llm.harm_seeds import seeds


@pytest.fixture(scope="module")
def model():
    return Model(seeds())


@pytest.mark.parametrize("word, want", [("i*diot", "i*diot"), ("s.c.u.m", "scum"), ("ＩＤＩＯＴ", "idiot"), ("іdіоt", "idiot"), ("id​iot", "idiot"), ("1di0t", "idiot"), ("biiiitch", "bitch"), ("P5105", "p5105"), ("Trottel!", "trottel"), ("Сука", "сука")])
def test_words_without_disguise(word, want):
    assert plain_word(word) == want


def test_letters_set_apart_and_japanese():
    assert words_of("you i d i o t, 3 times") == ["you", "idiot", "#", "times"]
    assert words_of("馬鹿だ") == ["馬鹿", "鹿だ"] and words_of("a I") == ["a", "i"]


def test_long_sentences_come_in_windows():
    assert len(sentences(" ".join(f"w{i}" for i in range(100)))) == 1 and sentences("") == []
    for n in range(1, 120):
        parts = windows(n)
        assert all(0 < j - i <= 2 * harm.WINDOW for i, j in parts) and {k for i, j in parts for k in range(i, j)} == set(range(n))


def test_scores_of_many_texts_are_those_of_each_sentence_by_itself(model):
    r = random.Random(4)
    parts = [t for t, _ in seeds()]
    texts = [None, "", "…", "y o u are a b c", "it's a b, I a m"] + [r.choice((". ", " ", "\n")).join(r.choices(parts, k=r.randint(1, 9))) for _ in range(60)]
    harms, kinds = model.scores(texts)
    for text, got, kind in zip(texts, harms, kinds):
        worst = None
        for words in map(words_of, sentences(text)) if text else ():
            for i, j in windows(len(words)) if words else ():
                held = harm.features([model.number(w) for w in words[i:j]])
                value = sum(model.harm.get(k, 0.0) for k in held) + model.harm.get(-1, 0.0)
                worst = value if worst is None else max(worst, value)
        want = 0.0 if worst is None else 1 / (1 + math.exp(-worst))
        assert abs(got - want) < 1e-9 and (kind is None) == (worst is None)


@pytest.mark.parametrize("text", ["You are such a stupid idiot.", "The garden was nice. YOU ARE SUCH A STUPID ID*OT! Bye.", "you are such a s t u p i d idoit", "Du bist so ein dummes Ａrschloch.", "Foreigners are vermin, get rid of them all.", "I want to fuck you all night.", "you are <b>such</b> a stupid&nbsp;idiot"])
def test_harmful(model, text):
    assert model.score(text)[0] >= 0.5


@pytest.mark.parametrize("text", ["", "   ", "…", "The naked eye can see the comet.", "Kill the background process before you restart the job.", "I was such an idiot, I left the camera at home.", "The garden was nice.", "Version 2.3 of the scanner reads P5105.JPG."])
def test_harmless(model, text):
    assert model.score(text)[0] < 0.5


def test_held_out_sentences():
    rows = seeds()
    random.Random(2).shuffle(rows)
    cut = len(rows) * 4 // 5
    m = Model(rows[:cut])
    # The share of harmful rows is that of the held-out part here.
    right = sum((m.score(t)[0] >= 0.15) == (label != "ok") for t, label in rows[cut:])
    assert right >= 0.65 * (len(rows) - cut)


def test_fit_is_sparse_and_repeatable():
    r = random.Random(1)
    rows = [({1 if y else 2, *r.sample(range(100, 2000), 8)}, y) for y in [0, 1] * 200]
    w = ftrl(rows)
    assert w == ftrl(rows) and w[1] > 0.5 > 0 > w.get(2, 0) and len(w) < 0.9 * len({i for s, _ in rows for i in s})


def test_frames(spark):
    samples = spark.createDataFrame([("You moron.", "abusive"), ("Fine.", "ok"), (None, "ok"), ("x", None), ("y", "other")] * 3, "text string, label string")
    m = fit_harm(samples, "text", "label")
    rows = [(1, "You are such a stupid idiot.", "Mail"), (2, None, "MAIL"), (3, "", None), (4, "Fine weather. " * 5000, " mail "), (4, "Fine.", "a-b"), (None, "Fine.", "A B")]
    df = spark.createDataFrame(rows, "id bigint, text string, score string")
    out = harm_scores(df.withColumnRenamed("score", "source"), "id", "text", m, ["source"])
    got = {r.id: (r.score >= 0.5, r.kind) for r in out.collect()}
    assert got[1] == (True, "abusive") and not any(got[k][0] for k in (2, 3, 4, None)) and out.count() == len(rows)
    rates = {r.source: (r.documents, r.rate) for r in source_rates(out, "source").collect()}
    assert rates == {"mail": (3, 1 / 3), None: (1, 0.0), "a_b": (2, 0.0)}
    assert harm_scores(df.limit(0), "id", "text", m).count() == 0
