"""Scores of texts for abusive, hateful or sexual content.

A text is brought out of its disguises and cut into sentences; a sentence is
described by its hashed word n-grams and skip-grams. Logistic regression models
are fitted to labelled sentences with the FTRL-proximal method: each coordinate
has its own learning rate, and the L1 term keeps most weights at zero, so the
models are small enough to send to every task. A text scores as its worst
sentence. Texts are scored many at a time: words are numbers, the slots of all
their n-grams and skip-grams come from a few array operations, and only those
with a weight are assigned to the sentences that hold them.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from kithspark.llm.common import spread
from kithspark.llm.harm_seeds import seeds
from kithspark.llm.leaks import _INLINE, _TAG
from kithspark.llm.lookalike import invisible
from kithspark.llm.names import _PLAIN, _TO_LATIN, _is_cyrillic

#: Slots of the hash; labelled rows that are used at most; words of a window in a long sentence, and its step.
SLOTS, LABELLED, WINDOW, STEP = 1 << 20, 20_000, 10, 3
#: Words that a task remembers; texts that are scored at once.
REMEMBERED, TOGETHER = 300_000, 500
#: Rates and penalties of the fit, and its rounds.
ALPHA, BETA, L1, L2, ROUNDS = 0.15, 1.0, 0.12, 0.6, 12
KINDS = ("abusive", "hateful", "sexual")
#: Score from which on a text counts as harmful, and the share of harmful sentences that the score assumes:
#: the labelled ones are chosen by hand and hold far more of them than a corpus does.
THRESHOLD, ASSUMED = 0.5, 0.15

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|[\r\n]+|[。！？¡¿]|(?<=\s)[-–—•*](?=\s)")
_JOINED = re.compile(r"^\W*\w(?:[._\-*·'’]\w)+\W*$")
_REPEATED = re.compile(r"([a-zа-я])\1{2,}")
_MASK = re.compile(r"[*#%]")
_KANA = re.compile(r"[぀-ヿ一-鿿]+")
_EMOJI = re.compile(r"[☀-➿\U0001f000-\U0001faff]+")


def plain_word(w: str) -> str:
    """A word without its disguise: plain lower-case letters, with ``*`` where one is masked."""
    if w.isascii() and w.isalpha():
        return _REPEATED.sub(r"\1", w.lower())
    s = w
    if not s.isascii():
        s = unicodedata.normalize("NFKC", "".join(c for c in s if not invisible(c)))
        latin = "".join(_TO_LATIN.get(c, c) for c in s)
        if not any(_is_cyrillic(c) for c in latin):
            s = latin
        if not any(map(_is_cyrillic, s)) and not _KANA.search(s):
            s = "".join(c for c in unicodedata.normalize("NFD", "".join(_PLAIN.get(c, c) for c in s)) if not unicodedata.combining(c))
    if len(s) > 4 and _JOINED.match(s):
        s = re.sub(r"[._\-*·'’]", "", s)
    s = s.lower().strip(".,;:?\"()[]{}<>«»„“”‘’'`~…-_")
    s = s.rstrip("!")
    if any(c in "@$!€013457" for c in s) and sum(c.isalpha() for c in s) >= 2 and re.fullmatch(r"[a-z@$!€013457*#%]+", s) and not re.fullmatch(r"[a-z]{1,4}\d+|\d+[a-z]{1,3}", s):
        s = s.translate(_LEET)
    s = _MASK.sub("*", s) if any(c.isalpha() for c in s) else s
    return _REPEATED.sub(r"\1", s)


class Pieces(dict):
    """For each word as written what it comes to: (whether it is a letter by itself, plain word) of each of its parts."""

    def __missing__(self, word: str) -> tuple[tuple[bool, str], ...]:
        if len(self) > REMEMBERED:
            self.clear()
        out: list[tuple[bool, str]] = []
        for p in plain_word(word).replace("-", " ").replace("/", " ").replace("'", " ").replace("’", " ").split():
            if len(p) == 1 and p.isalpha():
                out.append((True, p))
            elif _KANA.search(p):
                out += [(False, k[i : i + 2]) for k in _KANA.findall(p) for i in range(max(1, len(k) - 1))]
            elif w := ("#" if p[:1].isdigit() else re.sub(r"[^\w*]", "", p)):
                out.append((False, w))
        got = self[word] = tuple(out)
        return got


_PIECES = Pieces()


def words_of(sentence: str) -> list[str]:
    """Plain words; letters set apart are put together; Japanese text as pairs of characters."""
    out: list[str] = []
    run: list[str] = []
    for w in sentence.split():
        for single, p in _PIECES[w]:
            if single:
                run.append(p)
                continue
            if run:
                out += ["".join(run)] if len(run) >= 3 else run
                run = []
            out.append(p)
    if run:
        out += ["".join(run)] if len(run) >= 3 else run
    return out


def sentences(text: str) -> list[str]:
    """The sentences of a text that aren't empty."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", _INLINE.sub("", html.unescape(text)))
    return [s for s in _SPLIT.split(text if text.isascii() else _EMOJI.sub(". ", text)) if s]


def windows(n: int) -> list[tuple[int, int]]:
    """Parts, from and to, of a sentence of ``n`` words that are scored: the whole and overlapping windows of a long one, as
    harmless words around a harmful part would outweigh it; of a very long one, which may lack stops, windows only."""
    out = [(0, n)] if n <= 2 * WINDOW else []
    if n > WINDOW + STEP:
        out += [(i, min(i + WINDOW, n)) for i in range(0, n - WINDOW + STEP, STEP)]
    return out


#: Words to each side that a feature is made of, from its first word on: words, pairs, triples, and pairs with one or two skipped.
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))


def slots(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(words that a feature spans, slot of the feature that begins at each word) for each of the SHAPES, of words as numbers."""
    x = numbers.astype(np.int64).view(np.uint64)
    for kind, shape in enumerate(SHAPES):
        n = len(x) - shape[-1]
        if n <= 0:
            continue
        h = np.full(n, kind + 1, np.uint64)
        for k in shape:
            h = (h ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        yield shape[-1] + 1, (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 20)).astype(np.int64)


def features(numbers: list[int]) -> set[int]:
    """Slots of all features of one sentence."""
    return {int(i) for _, slot in slots(np.array(numbers, np.int64)) for i in slot}


def ftrl(rows: list[tuple[set[int], int]], rounds: int = ROUNDS) -> dict[int, float]:
    """Weights by slot, the constant at -1; slots with a weight of zero are left out."""
    z: dict[int, float] = {}
    n: dict[int, float] = {}
    order = list(range(len(rows)))
    state = 12345

    def weight(i: int) -> float:
        v = z.get(i, 0.0)
        penalty = 0.0 if i == -1 else L1
        if abs(v) <= penalty:
            return 0.0
        return -(v - math.copysign(penalty, v)) / ((BETA + math.sqrt(n.get(i, 0.0))) / ALPHA + L2)

    for _ in range(rounds):
        for k in range(len(order) - 1, 0, -1):  # a fixed shuffle
            state = (1103515245 * state + 12345) % (1 << 31)
            j = state % (k + 1)
            order[k], order[j] = order[j], order[k]
        for k in order:
            slots, y = rows[k]
            w = {i: weight(i) for i in (*slots, -1)}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i, wi in w.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / ALPHA * wi
    return {i: w for i in z if (w := weight(i))}


class Model:
    """One model for harm at all and one for each kind, with the words that masks may stand for."""

    def __init__(self, labelled: list[tuple[str, str]]):
        rows = [(words_of(" ".join(_SPLIT.sub(" ", t).split())), label) for t, label in labelled if t]
        rows = [(w, label) for w, label in rows if w]
        self.known = {w for words, _ in rows for w in words}
        bad: dict[str, list[int]] = {}
        for words, label in rows:
            for w in set(words):
                bad.setdefault(w, [0, 0])[label != "ok"] += 1
        self.bad = sorted(w for w, (ok, harm) in bad.items() if harm > 2 * ok and len(w) >= 4 and "*" not in w)
        self.swapped = {w[:i] + w[i + 1] + w[i] + w[i + 2 :]: w for w in self.bad if len(w) >= 5 for i in range(1, len(w) - 1)}
        self._numbers: dict[str, tuple[tuple[int, ...], int]] = {}
        data = [(features([self.number(x) for x in w]), label) for w, label in rows]
        self.harm = ftrl([(f, int(label != "ok")) for f, label in data])
        harmful = sum(label != "ok" for _, label in rows)
        odds = max(1, harmful) / max(1, len(rows) - harmful)
        self.harm[-1] = self.harm.get(-1, 0.0) + math.log(ASSUMED / (1 - ASSUMED)) - math.log(odds)
        kinds = [ftrl([(f, int(label == k)) for f, label in data]) for k in KINDS]
        models = [self.harm, *kinds]
        self.constant = np.array([m.get(-1, 0.0) for m in models])
        used = np.array(sorted({i for m in models for i in m if i >= 0}), dtype=np.int64)
        self.place = np.zeros(SLOTS, np.int32)  # of each slot the row of its weights, 0 for none
        self.place[used] = np.arange(1, len(used) + 1)
        self.weight = np.array([[0.0] * len(models), *([m.get(int(i), 0.0) for m in models] for i in used)])

    def settled(self, w: str) -> str:
        """A masked word, or one with two letters swapped, as the known word that it stands for."""
        if "*" in w:
            shape = re.compile(re.sub(r"\*+", lambda m: "." * len(m[0]), re.sub(r"[^\w*]", "", w)) + "$")
            return next((b for b in self.bad if len(b) == len(w) and shape.match(b)), w.replace("*", ""))
        return self.swapped[w] if w not in self.known and w in self.swapped else w

    def number(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(self.settled(word).encode("utf-8", "surrogatepass")) - (1 << 63)

    def numbers(self, sentence: str) -> list[int]:
        """The words of a sentence as numbers."""
        out: list[int] = []
        run = 0
        for w in sentence.split():
            got = self._numbers.get(w)
            if got is None:
                if len(self._numbers) > REMEMBERED:
                    self._numbers.clear()
                parts = _PIECES[w]
                got = self._numbers[w] = tuple(self.number(p) for _, p in parts), sum(single for single, _ in parts)
            out += got[0]
            run = run + got[1] if got[1] else 0
            if run >= 3:  # letters set apart may have to be put together
                return [self.number(x) for x in words_of(sentence)]
        return out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """(harm from 0 to 1, kind) of each text's worst sentence; 0 and None without words."""
        flat: list[int] = []
        begin, end, owner = [], [], []
        for t, text in enumerate(texts):
            for sentence in sentences(text) if isinstance(text, str) and text else ():
                at = len(flat)
                flat += self.numbers(sentence)
                for i, j in windows(len(flat) - at) if len(flat) > at else ():
                    begin.append(at + i)
                    end.append(at + j)
                    owner.append(t)
        harm, kind = np.zeros(len(texts)), [None] * len(texts)
        if not begin:
            return harm, kind
        x, b, e, o = np.array(flat, np.int64), np.array(begin), np.array(end), np.array(owner)
        order = np.lexsort((e, b))
        b, e, o = b[order], e[order], o[order]
        found = [(at, np.full(len(at), span), row[at]) for span, row in ((span, self.place[slot]) for span, slot in slots(x)) for at in [np.flatnonzero(row)]]
        at, span, row = (np.concatenate(f) for f in zip(*found))
        order = np.lexsort((at, row))
        at, span, row = at[order], span[order], row[order]
        before = np.r_[-1, np.where(row[1:] == row[:-1], at[:-1], -1)] if len(at) else at  # the last time that a feature occurred
        low, high = np.searchsorted(b, at + span - 2 * WINDOW), np.searchsorted(b, at, side="right")
        times = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(at)), times)
        window = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        inside = (e[window] >= (at + span)[which]) & (before[which] < b[window])  # a feature counts once in a sentence
        window, row = window[inside], row[which[inside]]
        total = np.stack([np.bincount(window, self.weight[row, m], minlength=len(b)) for m in range(len(self.constant))], axis=1)
        first = np.lexsort((b, -total[:, 0], o))
        first = first[np.r_[True, o[first][1:] != o[first][:-1]]]  # of each text with words the worst sentence
        worst = total[first] + self.constant
        harm[o[first]] = 1 / (1 + np.exp(-np.clip(worst[:, 0], -35, 35)))
        for t, k in zip(o[first].tolist(), worst[:, 1:].argmax(1).tolist()):
            kind[t] = KINDS[k]
        return harm, kind

    def score(self, text: str | None) -> tuple[float, str | None]:
        harm, kind = self.scores([text])
        return float(harm[0]), kind[0]


def fit_harm(samples: DataFrame, text: str, label: str, limit: int = LABELLED) -> Model:
    """A model of the labelled rows, at most ``limit`` of them, and the built-in sentences."""
    rows = samples.where(F.col(text).isNotNull() & F.col(label).isin("ok", *KINDS)).select(text, label)
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64(text), F.lit(n)) < limit)
    held = sorted({(r[0], r[1]) for r in rows.limit(2 * limit).collect()})
    return Model(held + seeds())


def harm_scores(docs: DataFrame, key: str, text: str, model: Model, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(key, *carry, score double, kind string) for every row.

    ``kind`` is null below the threshold. Null, empty and blank texts score 0.
    Whole texts are read, in time that grows with their length; repeated rows are
    each scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the labelled rows
    rows = spread(docs.select(F.col(key), *carry, F.col(text).alias("__text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                b = batch.iloc[at : at + TOGETHER]
                harm, kind = shared.value.scores(b["__text"].tolist())
                yield b.drop(columns="__text").assign(score=harm, kind=[k if h >= THRESHOLD else None for h, k in zip(harm, kind)])

    fields = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in (key, *carry))
    return rows.mapInPandas(run, f"{fields}, score double, kind string")


def source_rates(scores: DataFrame, source: str) -> DataFrame:
    """(source, documents, abusive, hateful, sexual, rate): sources written in another case or with blanks are one; null is one of its own."""
    name = F.lower(F.regexp_replace(F.trim(source), r"[\s_-]+", "_")).alias("source")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    return scores.groupBy(name).agg(F.count(F.lit(1)).alias("documents"), *counts, F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("rate"))
