"""Test items whose passages occur in a corpus, also with words replaced.

Words are numbers, hashes of their plain form, and five of them in a row make a
gram. One scan of the corpus finds the grams that the items have, of however many
items: a bitmap of bounded size, sent to the tasks, lets through what may be one.
How often a gram occurs in the corpus and among the items says how rare it is,
and of each item the rarest grams serve as seeds: as many as it takes for every
run of six words to hold one. Seeds are joined with the grams of the corpus, and
a document is aligned with an item around its seeds by the method of Smith and
Waterman in a band; the aligned item words are searched for a long enough run
with few enough errors. Only documents that hold a gram of an item move.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kithspark.llm.common import spread
from kithspark.llm.lookalike import invisible
from kithspark.session import BROADCAST_ROWS, Scratch

#: Words of a seed; half the width of the alignment's band; words that a task remembers.
SEED, BAND, REMEMBERED = 5, 8, 500_000
#: Bits of the bitmap for each gram of the items, and at most in all: eight megabytes. Grams that are sent along in full besides.
BITS, MOST_BITS, IN_FULL = 64, 1 << 26, 1_000_000
#: Words of all items together that are sent to every task that aligns; more are joined.
ITEM_WORDS = 4_000_000
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -2

# A tag of more than 300 characters has to look like one, as text between < and > may be a passage.
_LONG = r"""(?:\s++(?:[\w:@.-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++)|(?:async|autoplay|checked|controls|crossorigin|defer|disabled|download|hidden|loop|muted|open)\b))++\s*+/?>"""
_NAMES = "a|b|i|u|em|strong|span|font|mark|code|small|sup|sub|q|s|wbr"
_INLINE = re.compile(rf"</?(?:{_NAMES})(?:{_LONG}|(?:\s[^<>]{{0,300}})?/?>)", re.I)
_TAG = re.compile(rf"<!--(?:(?!-->|<!--).)*+-->|<[a-z][\w:-]*+{_LONG}|</?[a-z!][^<>]{{0,300}}>", re.I | re.S)
_LINK = re.compile(r"\]\([^()\s]*+\)")
_WORD = re.compile(r"[^\W_]+")
_OTHER = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})


class _Fold(dict):
    """For each character what it counts as: without case, accents and width, white space kept, nothing for what isn't seen."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if c.isspace():
            out = c if c in "\n\r" else " "
        elif invisible(c):
            out = ""
        else:
            s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", c).casefold().translate(_OTHER))
            out = "".join(x for x in s if not unicodedata.combining(x))
        self[point] = out
        return out


_FOLD = _Fold()
_DIVIDED = re.compile(r"(?<=[^\W\d_])-[ \t]*[\r\n]+[ \t]*(?=[^\W\d_])")
_APOSTROPHE = re.compile(r"(?<=[^\W\d_])['’`´ʼ](?=[^\W\d_])")


def _folded(text: str) -> str:
    if "<" in text or "&" in text or "](" in text:
        text = _LINK.sub(" ", _TAG.sub(" ", _INLINE.sub("", html.unescape(text) if "&" in text else text)))
    s = text.translate(_FOLD)
    if "-" in s and ("\n" in s or "\r" in s):
        s = _DIVIDED.sub("", s)  # words divided at a line's end
    return _APOSTROPHE.sub("", s)


def plain_words(text: str) -> list[list[str]]:
    """The words of a text between spaces, each as its parts of letters and digits; nothing of looks is kept."""
    return [p for w in _folded(text).split() if (p := _WORD.findall(w))] if text else []


def number(part: str) -> int:
    """A word's part as a number of 64 bits."""
    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) - (1 << 63)


class Numbers(dict):
    """For each word between spaces the numbers of its parts; the memory is emptied when it is full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = tuple(map(number, _WORD.findall(word)))
        return got

    def of(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            for w in _folded(text).split():
                out += self[w]
        return out


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def grams(numbers: np.ndarray) -> np.ndarray:
    """The hash of every SEED numbers in a row."""
    n = len(numbers) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = numbers.astype(np.int64).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SEED):
        h = (h + x[k : k + n]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def seeds_of(often: list[int]) -> list[int]:
    """Places of the seeds among grams that occur ``often``: of each two neighbours one, and as rare ones as can be."""
    if not often:
        return []
    # Least sum of how often they occur, over all ways to take one of each two neighbours; of equal ones the first found.
    take, leave, steps = often[0], 0, []
    for v in often[1:]:
        steps.append(take <= leave)
        take, leave = min(take, leave) + v, take
    chosen, k = [], len(often) - 1
    taken = take <= leave or len(often) == 1
    while k >= 0:
        if taken:
            chosen.append(k)
            taken = steps[k - 1] if k else False
        else:
            taken = True
        k -= 1
    return chosen[::-1]


def align(a: list[str], b: list[str], low: int, high: int) -> list[tuple[int, int]]:
    """Best local alignment of a with b on the diagonals low to high (b's place less a's): pairs of places, -1 for a gap."""
    width = high - low + 1
    before = [0] * (width + 2)
    steps: list[bytearray] = []
    best, at = 0, None
    for i, x in enumerate(a):
        row = [0] * (width + 2)
        step = bytearray(width + 2)
        for d in range(1, width + 1):
            j = i + low + d - 1
            if j < 0 or j >= len(b):
                continue
            s, how = before[d] + (MATCH if x == b[j] else MISMATCH), 1
            if before[d + 1] + GAP > s:
                s, how = before[d + 1] + GAP, 2  # a's word has no partner
            if row[d - 1] + GAP > s:
                s, how = row[d - 1] + GAP, 3  # b's word has none
            if s > 0:
                row[d], step[d] = s, how
                if s > best:
                    best, at = s, (i, d)
        steps.append(step)
        before = row
    out = []
    while at:
        i, d = at
        how = steps[i][d] if i >= 0 and 1 <= d <= width else 0
        if not how:
            break
        j = i + low + d - 1
        out.append((i if how != 3 else -1, j if how != 2 else -1))
        at = (i - 1, d) if how == 1 else (i - 1, d + 1) if how == 2 else (i, d - 1)
    return out[::-1]


def longest_run(words: list[int], a: list[str], b: list[str], pairs: list[tuple[int, int]], per: int, sure_ends: bool = False) -> tuple[int, int]:
    """(length, errors) of the longest run of a's words with at most one error for each ``per`` words.

    A word is an error if one of its parts isn't matched; each extra part in b is
    another. With ``sure_ends`` the run begins and ends with words without one.
    """
    if not pairs:
        return 0, 0
    wrong: dict[int, int] = {}
    seen: dict[int, int] = {}
    last = None
    for i, j in pairs:
        if i >= 0:
            last = words[i]
            seen[last] = seen.get(last, 0) + 1
            if j < 0 or a[i] != b[j]:
                wrong[last] = 1
        elif last is not None:
            wrong[last] = wrong.get(last, 0) + 1
    size = Counter(words)
    order = [w for w in sorted(seen) if seen[w] == size[w]]
    bad = [0]
    for w in order:
        bad.append(bad[-1] + wrong.get(w, 0))
    best = (0, 0)
    for i in range(len(order)):
        if sure_ends and order[i] in wrong:
            continue
        for j in range(len(order), i + best[0], -1):
            if sure_ends and order[j - 1] in wrong:
                continue
            n, e = j - i, bad[j] - bad[i]
            if order[j - 1] - order[i] == n - 1 and e * per <= n:
                best = n, e
                break
    return best


def extended(words: list[int], a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The alignment and, on the same diagonals beyond its ends, as many of a's tokens as it has itself, equal or not.

    An alignment ends where it scores best, so words of a run aren't in it if enough replaced ones part them from the rest.
    """
    (i, j), (k, m) = pairs[0], pairs[-1]
    before, after = [], []
    for d in range(1, len(pairs) + 1):
        if i - d >= 0 and (j - d >= 0 or words[i - d] == words[i - d + 1]):
            before.append((i - d, j - d if j - d >= 0 else -1))
        if k + d < len(a) and (m + d < len(b) or words[k + d] == words[k + d - 1]):
            after.append((k + d, m + d if m + d < len(b) else -1))
    return before[::-1] + pairs + after


def best_run(token: list[int], a: list[int], word: list[int], diagonals: list[int], least: int, per: int) -> tuple[int, int]:
    """(words, errors) of the longest run of the item ``a`` in a text's ``token``, around the diagonals of its seeds."""
    best, group = (0, 0), []
    for d in [*sorted(diagonals), None]:
        if group and (d is None or d - group[-1] > BAND):
            low, high = group[0] - BAND, group[-1] + BAND
            start = max(0, low)  # only the part of the text that these diagonals reach
            part = token[start : max(0, high + len(a) + 1)]
            pairs = align(a, part, low - start, high - start)
            run = longest_run(word, a, part, pairs, per)
            if run[0] < least <= 2 * len(pairs):
                run = max(run, longest_run(word, a, part, extended(word, a, part, pairs), per, True))
            best = max(best, run)
            group = []
        if d is not None:
            group.append(d)
    return best


def item_rows(items: DataFrame, key: str, text: str) -> DataFrame:
    """(i, item, token, word, gram) of every item with at least SEED words; one that is stored with several texts has a row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [plain_words(t) for t in b.t]
            token = [[number(part) for w in x for part in w] for x in words]
            out = pd.DataFrame({"i": b.i, "item": b.k, "token": token, "word": [[n for n, w in enumerate(x) for _ in w] for x in words], "gram": [grams(np.array(t, np.int64)) for t in token]})
            yield out[out.gram.str.len() > 0]

    held = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").distinct()
    return held.withColumn("i", F.xxhash64("k", "t")).mapInPandas(run, "i bigint, item bigint, token array<bigint>, word array<int>, gram array<bigint>")


def _bitmap(gram: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(shift, bitmap) of the distinct ``n`` grams; its size is bounded by MOST_BITS."""
    bits = min(MOST_BITS, 1 << max(16, (n * BITS).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    place = gram.select(F.shiftrightunsigned("g", shift).alias("p"))
    one = place.select(F.expr("cast(p div 8 as int) as at"), F.expr("shiftleft(1, cast(p % 8 as int)) as bit"))
    byte = one.groupBy("at").agg(F.bit_or("bit").cast("smallint").alias("byte")).toArrow()  # at most MOST_BITS / 8 rows
    out = np.zeros(bits // 8, np.uint8)
    out[byte.column("at").to_numpy()] = byte.column("byte").to_numpy().astype(np.uint8)
    return shift, out


def corpus_grams(rows: DataFrame, gram: DataFrame) -> DataFrame:
    """(k, token, at, g) of every row of (k, t) that holds grams of the items (g): its words as numbers, and the grams' places."""
    n = gram.count()
    context = rows.sparkSession.sparkContext
    shift, bitmap = _bitmap(gram, n)
    full = np.sort(gram.toArrow().column(0).to_numpy()) if n <= IN_FULL else None
    shared = context.broadcast((np.uint64(shift), bitmap, full))  # eight megabytes each at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, (shift, bitmap, full) = Numbers(), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                each = [numbers.of(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([len(x) for x in each])
                flat = np.fromiter((n for x in each for n in x), np.int64, count=int(ends[-1]))
                g = grams(flat)
                bit = g.view(np.uint64) >> shift
                at = np.flatnonzero(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(ends, at, side="right")
                inside = at + SEED <= ends[doc]
                at, doc = at[inside], doc[inside]
                if full is not None and len(at):
                    sure = full[np.minimum(np.searchsorted(full, g[at]), len(full) - 1)] == g[at]
                    at, doc = at[sure], doc[sure]
                if not len(at):
                    continue
                held, first = np.unique(doc, return_index=True)
                cuts = pa.array(np.r_[first, len(at)].astype(np.int32))
                sizes = np.array([len(each[d]) for d in held])
                begin = ends[held] - sizes
                token = np.concatenate([flat[x : x + y] for x, y in zip(begin, sizes)])
                place = at - np.repeat(begin, np.diff(np.r_[first, len(at)]))
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(token)), pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(g[at]))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held)), *lists], ["k", "token", "at", "g"])

    return rows.mapInArrow(scan, "k bigint, token array<bigint>, at array<int>, g array<bigint>")


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 18, per: int = 8) -> DataFrame:
    """(key, item, words int, errors int): documents that hold a passage of a test item.

    A passage is a run of at least ``least`` consecutive words of the item, of
    which at most one in ``per`` is another word, the first and the last being the
    item's: what lies beyond can't be told from other text. Case, accents, punctuation,
    spacing, invisible characters and markup don't matter. Null and empty texts
    on either side give no row; items shorter than ``least`` words can't be found;
    of an item with several texts each is looked for, and the longest run counts;
    repeated documents are each reported. Lossless for ``per`` >= 8 and ``least``
    >= 18: a run of six words stays whole then, and each holds a seed; up to BAND
    words more or fewer within a passage are bridged.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    rows = spread(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null and t <> ''"))
    held = scratch.keep(item_rows(items, item, item_text))
    each = held.select("i", F.posexplode("gram").alias("at", "g"))
    # Written once, so a number that a row gets there stays the same.
    found = scratch.keep(corpus_grams(rows, each.select("g").distinct()).withColumn("d", F.monotonically_increasing_id()))
    hit = found.select("d", F.explode(F.arrays_zip("at", "g")).alias("x")).select("d", "x.at", "x.g")
    often = hit.select("g").unionByName(each.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rated = each.join(often, "g").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", "g", "n"))).alias("all"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(i, x["at"], x["g"]) for i, every in zip(b.i, b["all"]) for x in (every[k] for k in seeds_of([int(e["n"]) for e in every]))]
            yield pd.DataFrame(got, columns=["i", "start", "g"]).astype({"i": "int64", "start": "int32", "g": "int64"})

    seed = scratch.keep(rated.mapInPandas(choose, "i bigint, start int, g bigint"))
    few = F.broadcast if seed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    near = hit.join(few(seed), "g").groupBy("d", "i").agg(F.collect_set((F.col("at") - F.col("start")).cast("int")).alias("diagonals"))
    size = held.agg(F.coalesce(F.sum(F.size("token")), F.lit(0)).alias("n")).first().n
    few = F.broadcast if size <= ITEM_WORDS else (lambda df: df)
    pairs = near.join(found.select("d", "k", F.col("token").alias("text")), "d").join(few(held.select("i", "item", "token", "word")), "i")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(d, k, i, *best_run(t.tolist(), a.tolist(), w.tolist(), g.tolist(), least, per)) for d, k, i, t, a, w, g in zip(b.d, b.k, b.item, b.text, b.token, b.word, b.diagonals)]
            out = pd.DataFrame(got, columns=["d", "k", "item", "words", "errors"])
            yield out[out.words >= least]

    judged = pairs.select("d", "k", "item", "text", "token", "word", "diagonals").mapInPandas(judge, "d bigint, k bigint, item bigint, words int, errors int")
    best = judged.groupBy("d", "k", "item").agg(F.max(F.struct("words", (-F.col("errors")).alias("e"))).alias("m"))
    return best.select(F.col("k").alias(key), F.col("item").alias(item if item != key else f"{item}_item"), F.col("m.words").alias("words"), (-F.col("m.e")).alias("errors"))
