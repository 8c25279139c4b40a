"""Spellings of names that mean the same person or organisation.

Every name is brought to a form of plain tokens. Forms become vectors of
character n-grams weighted by inverse document frequency; a sparse join over
shared n-grams gives the pairs of a group of names whose cosine reaches a
threshold. A pair is then compared token by token: spelled-out names with few
typing errors are close outright, short and informal ones (initials, first names,
nicknames, acronyms) only if a single entity fits. Close forms are grouped by
average linkage.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kithspark.llm.common import spread
from kithspark.llm.lookalike import LOOK_ALIKES, invisible
from kithspark.operators.graph import connected_components
from kithspark.session import Scratch, parts

#: Least cosine of a candidate pair; libraries from which on a token counts as common; least mean similarity to link two groups.
LEAST_COSINE, COMMON, LINKAGE = 0.15, 4, 0.5
#: A token is a typing error, however many libraries have it, if so many times as many have a word that it may be an
#: error of; letters from which on such words are looked for by their length.
RARER, LONG = 8, 24
#: Slots in which the frequencies of n-grams are counted.
GRAM_SLOTS = 1 << 20

# Given names and their short and informal forms.
NICKNAMES = """
adaeze ada
alexander alex sasha xander sandy lex alec
archibald archie archy
augustine gus augie
bartholomew bart barty
benjamin ben benny benji
cassandra cass cassie sandra
catherine cathy kate katie
charlotte lottie charlie lotte
cornelius neil con corny
desmond des dez
dmitri dima mitya
dorothy dottie dot dolly dora
ekaterina katya katia
elizabeth beth liz lizzie betty eliza bess
emmanuel manny manu
francisco paco pancho
frederick fred freddy freddie
friederike rike friedel
gabriel gabe
genevieve gen viv
guadalupe lupe
gwendolyn gwen
harriet hattie harry
ignacio nacho
ingeborg inge
isabella izzy bella isa
johannes hannes hans
jonathan jon jonny nate
jose pepe
josephine josie jo
katherine kate katie kathy kitty
leopold leo poldi
malgorzata gosia
margaret maggie peggy meg
mikhail misha
nadezhda nadya nadia
nathaniel nate nat
olumide olu
patrick paddy pat
padraig paddy
philippa pippa pip
priyanka priya
raghavendra raghu
ramon moncho
robert bob rob bobby
rosalind roz ros
sebastian basti seb
stanislaw staszek stas
susannah suzy sue susie
svetlana sveta lana
tadeusz tadek
theodore theo ted teddy
ulrich uli
valentina tina val
veronica ronnie vera
vladimir vova volodya
wilhelmina mina willa
william bill will billy
wolfgang wolf
zachary zack zach
zuzanna zuzia
"""

# Words that stand for no one, and titles that say nothing about who is meant.
SKIP = set("unknown;skip;no idea;someone;baby;n/a;na;none;nobody;ask grandma;ask mum;ask grandpa;?;-;tbd;anonymous;photographer;waiter;stranger;whole class;neighbour from upstairs;bus driver".split(";"))
TITLES = set("dr prof professor mr mrs ms miss sir coach cousin teacher neighbour aunt uncle grandma grandpa the herr frau señor señora senor senora monsieur madame".split())
LEGAL = set("inc ltd llc gmbh ev ag sa sl srl co corp plc eingetragener verein".split())
PARTICLES = set("van von de der den di da del al el la le du mc".split())
HONORIFICS = ("님", "씨", "さん", "様", "くん", "ちゃん")

# Latin letters for Cyrillic ones.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya i i e g".split(" ")))
CYRILLIC["ъ"] = CYRILLIC["ь"] = ""


def _nicks() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for line in NICKNAMES.split("\n"):
        full, *short = line.split() or [""]
        for s in short:
            out.setdefault(s, set()).add(full)
    return {k: frozenset(v) for k, v in out.items()}


NICKS = _nicks()
GIVEN = frozenset(x.split()[0] for x in NICKNAMES.split("\n") if x)
_TO_LATIN, _TO_CYRILLIC = {}, {}
for _line in LOOK_ALIKES.split("\n"):
    _chars = _line.split()
    _latin = next((c for c in _chars if c.isascii() and c.isalpha()), None)
    _cyr = next((c for c in _chars if "CYRILLIC" in unicodedata.name(c, "")), None)
    for _c in _chars:
        if _latin and not _c.isascii():
            _TO_LATIN[_c] = _latin
        if _cyr:
            _TO_CYRILLIC[_c] = _cyr
_TO_LATIN.update({"І": "I", "Ι": "I", "Ӏ": "I", "ӏ": "l", "ǀ": "l"})
_PLAIN = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ð": "d", "ı": "i"}


def _is_cyrillic(c: str) -> bool:
    return "\u0400" <= c <= "\u052f"


def latin(name: str) -> str:
    """``name`` in plain letters: no accents, widths, look-alikes or hidden characters; Cyrillic spelled out."""
    s = unicodedata.normalize("NFKC", "".join(" " if c.isspace() else c for c in name if c.isspace() or not invisible(c)))
    words = []
    cyrillic = any(_is_cyrillic(_TO_LATIN.get(c, c)) for c in s)  # letters without a Latin twin settle the script
    for w in s.split():
        as_latin = "".join(_TO_LATIN.get(c, c) for c in w)
        if cyrillic and any(map(_is_cyrillic, w)):
            w = "".join(_TO_CYRILLIC.get(c, c) for c in w)
            low = unicodedata.normalize("NFC", w)
            as_latin = "".join(CYRILLIC.get(c) if c in CYRILLIC else (CYRILLIC.get(c.lower(), c).capitalize() if c.lower() in CYRILLIC else c) for c in low)
            if low.isupper() and len(low) > 1:
                as_latin = as_latin.upper()
        as_latin = re.sub(r"(?<=[a-zà-ÿ])I|(?<=[A-ZÀ-Ý])l(?=[A-ZÀ-Ý])", lambda m: "l" if m[0] == "I" else "I", as_latin)
        if unicodedata.category(as_latin[0])[0] == "L" and ord(as_latin[0]) < 0x250:
            plain = unicodedata.normalize("NFD", "".join(_PLAIN.get(c, c) for c in as_latin))
            as_latin = "".join(c for c in plain if not unicodedata.combining(c))
        words.append(as_latin)
    return " ".join(words)


def tokens(name: str | None) -> list[str]:
    """Tokens of a name, given name first where the spelling shows it; [] for blanks and skip words.

    A token is its kind and its text: F spelled out, A cut short with a dot, I an
    initial, U two or three capitals that may be an acronym.
    """
    if not name:
        return []
    s = latin(name).strip()
    if not s or s.casefold() in SKIP or not any(c.isalpha() for c in s):
        return []
    s = re.sub(r"\([^)]*\)", " ", s).replace("_", " ")
    for h in HONORIFICS:
        s = re.sub(rf"\s*{h}$", "", s)
    if s.count(",") == 1 and s.split(",")[1].replace(".", "").strip().casefold() not in LEGAL:
        family, given = s.split(",")
        s = f"{given.strip()} {family.strip()}" if given.strip() else family
    s = re.sub(r"[‐‑–-]", "-", s)
    words = [x for w in s.replace(",", " ").split() for x in _parts(w)]
    while len(words) > 2 and words[-1].replace(".", "").casefold() in LEGAL:
        words = words[:-1]
    while len(words) > 1 and words[0].rstrip(".").casefold() in TITLES:
        words = words[1:]
    upper = [len(w) > 3 and w.isupper() for w in words]
    if len(words) > 1 and upper[0] and not all(upper) and not any(upper[1:]):
        words = words[1:] + words[:1]
    out = []
    for w in words:
        dotted = [x for x in w.split(".") if x]
        if "." in w and dotted and all(len(x) == 1 for x in dotted):
            out += [f"I:{x.casefold()}" for x in dotted]
        elif len(w.strip(".")) == 1 and w.strip(".").isalpha() and ord(w.strip(".")) < 0x250:
            out.append(f"I:{w.strip('.').casefold()}")
        elif w.endswith(".") and len(w) > 2:
            out.append(f"A:{_fold(w.strip('.'))}")
        elif len(w) in (2, 3) and w.isupper() and w.isascii() and len(words) > 1:
            out.append(f"U:{w.casefold()}")
        elif t := _fold(w):
            out.append(f"F:{t}")
    return out


def _parts(w: str) -> list[str]:
    """A word in two where a dot joins whole words, or a hyphen a particle and a name."""
    if re.fullmatch(r"\w{2,}\.\w{2,}\.?", w):
        return w.split(".", 1)
    head, dash, rest = w.partition("-")
    return [head, rest] if dash and rest and head.casefold() in PARTICLES else [w]


def _fold(w: str) -> str:
    """Lower case, only letters and digits; the two ways to write an umlaut become one."""
    w = "".join(c for c in w.casefold() if c.isalnum())
    return w.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def grams(form: list[str]) -> list[str]:
    """Character bigrams and trigrams of each token, nicknames under their full names too."""
    out = set()
    for t in form:
        text = t[2:]
        for word in {text, *map(_fold, NICKS.get(text, ()))}:
            padded = f"^{word}$"
            out.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return sorted(out)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, or most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def most_edits(size: int) -> int:
    """Typing errors allowed between two words, the longer of ``size`` letters."""
    return 0 if size <= 3 else 1 if size <= 6 else 2


def near_keys(word: str, around: bool) -> set[str]:
    """Keys of a word; two words within ``most_edits``, one of them taken ``around``, share a key.

    The keys are what is left after deletions, and for long words the length.
    """
    keys: set[str] = set()
    if len(word) <= LONG + 2:
        keys = {word}
        for _ in range(1 if len(word) <= 4 else 2):
            keys |= {k[:i] + k[i + 1 :] for k in keys for i in range(len(k))}
    if len(word) > LONG:
        keys |= {f"#{len(word) + d}" for d in (range(-2, 3) if around else (0,))}
    return keys


_NICK_FOLDED: dict[str, frozenset[str]] = {_fold(k): frozenset(map(_fold, v)) for k, v in NICKS.items()}
_GIVEN_FOLDED = frozenset(map(_fold, GIVEN))


@lru_cache(maxsize=100_000)
def _sound(t: str) -> str:
    """The word with spellings of the same sound made equal."""
    for a, b in (("kh", "k"), ("ch", "k"), ("ck", "k"), ("ph", "f"), ("th", "t"), ("c", "k"), ("y", "i"), ("w", "v"), ("j", "i")):
        t = t.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", t)


def _token(a: str, b: str) -> tuple[float, str] | None:
    """(errors, kind) if tokens a and b can be the same word: full, nick, short or initial."""
    (ka, ta), (kb, tb) = (a[0], a[2:]), (b[0], b[2:])
    if "I" in (ka, kb):
        return (0, "full" if ka == kb else "initial") if ta[:1] == tb[:1] else None
    if "A" in (ka, kb):
        short, long = (ta, tb) if ka == "A" else (tb, ta)
        return (0, "short") if long.startswith(short) else None
    if ta == tb:
        return 0, "full"
    na, nb = _NICK_FOLDED.get(ta, frozenset()), _NICK_FOLDED.get(tb, frozenset())
    if ta in nb or tb in na or na & nb:
        return 0, "nick"
    if _sound(ta) == _sound(tb):
        return 1, "full"
    known = lambda k, t: k == "C" or t in _GIVEN_FOLDED or t in _NICK_FOLDED
    if known(ka, ta) and known(kb, tb):
        return None
    most = most_edits(max(len(ta), len(tb)))
    n = edits(ta, tb, most) if most and ta.isascii() and tb.isascii() else 9
    if n <= most:
        return n, "full"
    for nick, full in ((ta, tb), (tb, ta)):  # a nickname of a misspelled name, or a misspelled nickname
        for x in _NICK_FOLDED.get(nick, ()):
            if len(x) > 4 and edits(x, full, 1) <= 1:
                return 1, "nick"
    return None


def _spread_acronyms(form: list[str]) -> list[list[str]]:
    out = [[]]
    for t in form:
        out = [o + [f"F:{t[2:]}"] for o in out] + [o + [f"I:{c}" for c in t[2:]] for o in out] if t[0] == "U" else [o + [t] for o in out]
    return out


def _align(a: list[str], b: list[str]) -> tuple[int, float, list[tuple[int, int, str]]] | None:
    """Best one-to-one matching that uses every token of the shorter list a."""
    best = None

    def go(i: int, used: int, cost: float, pairs: list) -> None:
        nonlocal best
        if best is not None and cost >= best[0]:
            return
        if i == len(a):
            best = cost, list(pairs)
            return
        for j in range(len(b)):
            if not used >> j & 1 and (m := _token(a[i], b[j])):
                # Initials are weak, and tokens that keep their order are likelier.
                order = 0.01 * abs(i - j)
                go(i + 1, used | 1 << j, cost + m[0] + (0.5 if m[1] == "initial" else 0) + order, [*pairs, (i, j, m[1], m[0])])
        if a[i][2:] in PARTICLES or (a[i][0] == "I" and 0 < i < len(a) - 1):
            go(i + 1, used, cost + 0.2, pairs)

    go(0, 0, 0.0, [])
    return best


def compare(a: list[str], b: list[str]) -> tuple[str, float, int]:
    """(verdict, similarity, which is short): strong, weak or no; 1 if a is the short or informal one, 2 if b, 0 if neither or both."""
    best = ("no", 0.0, 0)
    for x in _spread_acronyms(a):
        for y in _spread_acronyms(b):
            flip = len(x) > len(y)
            s, t = (y, x) if flip else (x, y)
            verdict, sim, short = _compare(s, t)
            if flip:
                short = {0: 0, 1: 2, 2: 1}[short]
            if (verdict == "strong", verdict == "weak", sim) > (best[0] == "strong", best[0] == "weak", best[1]):
                best = verdict, sim, short
    return best


def _compare(s: list[str], t: list[str]) -> tuple[str, float, int]:
    no = ("no", 0.0, 0)
    if not s or not t or len(s) > 7 or len(t) > 7:
        joined = ["".join(x[2:] for x in w) for w in (s, t)]
        return ("strong", 1.0, 0) if s and t and joined[0] == joined[1] else no
    found = _align(s, t)
    size = max(1, sum(len(x) - 2 for x in t))
    if found is None:
        one, two = ("".join(x[2:] for x in w) for w in (s, t))
        n = edits(one, two, 1) if min(len(one), len(two)) >= 10 else 9
        return ("strong", 1 - n / size, 0) if n <= 1 and len(s) != len(t) else no
    _, pairs = found
    errors = sum(p[3] for p in pairs)
    kinds = [p[2] for p in pairs]
    solid = [p for p in pairs if p[2] != "initial" and len(s[p[0]]) > 3]
    used = {p[1] for p in pairs}
    left = [j for j in range(len(t)) if j not in used and t[j][2:] not in PARTICLES]
    if not solid or errors > 3:
        return no
    similarity = 1 - errors / size
    # Which side has the initial, the nickname or the cut word of each matched pair.
    shorter = set()
    for i, j, kind, _e in pairs:
        x, y = s[i], t[j]
        if kind == "initial" and x[0] != y[0]:
            shorter.add(1 if x[0] == "I" else 2)
        elif kind == "short" and x[0] != y[0]:
            shorter.add(1 if x[0] == "A" else 2)
        elif kind == "nick":
            shorter.add(1 if x[2:] in _NICK_FOLDED else 2)
    side = shorter.pop() if len(shorter) == 1 else 0
    if len(s) == 1:
        if len(t) == 1:
            return ("strong", similarity, 0) if kinds == ["full"] and (errors == 0 or len(s[0]) > 7) else ("weak", similarity, side) if kinds == ["nick"] else no
        i, j, kind, e = pairs[0]
        given = t[j][0] == "C" or t[j][2:] in _GIVEN_FOLDED or t[j][2:] in _NICK_FOLDED
        place_ok = j == 0 or (j == len(t) - 1 and t[0][0] != "C")
        return ("weak", similarity, 1) if kind in ("full", "nick") and given and place_ok and (e == 0 or len(t[j]) > 7) else no
    if left:
        first, last = 0 in used, len(t) - 1 in used
        family_first = any(p[0] == len(s) - 1 and p[1] == 0 for p in pairs)
        cut = first and 1 in used and not last
        middle = all(t[j][0] in "ICF" for j in left) and len(left) == 1
        if not (middle and len(pairs) >= 2 and (first and last or family_first or cut)):
            return no
        if "initial" in kinds and t[left[0]][0] == "I":
            return no
        if cut:
            return "weak", similarity, 1
    if len(solid) < 2 and len(pairs) < 2:
        return no
    ends_initial = "initial" in kinds and not all(_is_middle(p, s, t) for p in pairs if p[2] == "initial")
    if "nick" in kinds or ends_initial or ("short" in kinds and len(solid) < 2):
        return "weak", similarity, side
    return "strong", similarity, 0


def _is_middle(p: tuple, s: list[str], t: list[str]) -> bool:
    return 0 < p[0] < len(s) - 1 and 0 < p[1] < len(t) - 1


def average_linkage(person: list[bool], similar: dict[tuple[int, int], float], least: float) -> list[int]:
    """Group of each item: the two groups of highest mean similarity are joined while it reaches ``least``.

    The mean is taken over the pairs that are compared at all, those with a
    person; of these, pairs that aren't given have similarity 0. Mean similarities
    are kept as sums between groups that share a pair, so the work follows the
    pairs.
    """
    import heapq

    n = len(person)
    people = [int(p) for p in person]
    compared = lambda i, j: max(1, size[i] * size[j] - (size[i] - people[i]) * (size[j] - people[j]))
    sums: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), v in similar.items():
        sums[i][j] = sums[i].get(j, 0) + v
        sums[j][i] = sums[j].get(i, 0) + v
    size, alive, group = [1] * n, [True] * n, list(range(n))
    heap = [(-v, i, j) for i in range(n) for j, v in sums[i].items() if i < j]
    heapq.heapify(heap)
    while heap:
        v, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or j not in sums[i] or abs(-v - sums[i][j] / compared(i, j)) > 1e-12:
            continue
        if -v < least:
            break
        alive[j] = False
        for k, x in sums[j].items():
            if k != i:
                sums[i][k] = sums[i].get(k, 0) + x
                sums[k][i] = sums[i][k]
                del sums[k][j]
        sums[i].pop(j, None)
        size[i] += size[j]
        people[i] += people[j]
        group[j] = i
        for k, x in sums[i].items():
            a, b = min(i, k), max(i, k)
            heapq.heappush(heap, (-x / compared(i, k), a, b))
    for i in range(n):
        while group[i] != group[group[i]]:
            group[i] = group[group[i]]
    return group


def name_entities(names: DataFrame) -> DataFrame:
    """(lib, kind, id, name, entity): names of one entity of a library share ``entity``.

    ``names`` is (lib bigint, kind string, id bigint, name string), kind 'person'
    or 'request'. Blank names, skip words and null libraries, ids or names give
    no row. A request that fits no person, or whose short form fits several, has
    an entity of its own spelling. Repeated rows are kept. All spellings of a
    library are compared through the n-grams they share, whatever its size.
    """
    scratch = Scratch(names.sparkSession, "names")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(form=[" ".join(tokens(x)) for x in b["name"]])

    rows = spread(names.select("lib", "kind", "id", "name").where("lib is not null and id is not null and name is not null"))
    parsed = rows.mapInPandas(parse, "lib bigint, kind string, id bigint, name string, form string").where("form <> ''")
    parsed = scratch.keep(parsed.withColumn("f", F.xxhash64("lib", "form")))
    forms = parsed.groupBy("f", "lib", "form").agg(F.max(F.col("kind") == "person").alias("person"))

    # Tokens that several libraries have are words and get the kind C, unless they are frequent typing errors of far more frequent words.
    token = forms.select("f", "lib", "person", F.posexplode(F.split("form", " ")).alias("at", "token"))
    counted = scratch.keep(token.select("lib", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("libs")))
    common = counted.join(_misspelled(counted), "token", "left").select("token", (F.col("token").startswith("F:") & (F.col("libs") >= COMMON) & F.col("wrong").isNull()).alias("common"))
    marked = F.when(F.col("common"), F.concat(F.lit("C:"), F.expr("substring(token, 3)"))).otherwise(F.col("token"))
    together = F.array_sort(F.collect_list(F.struct("at", marked.alias("token"))))
    forms = scratch.keep(token.join(common, "token").groupBy("f", "lib", "person").agg(together.alias("t")).select("f", "lib", "person", F.array_join("t.token", " ").alias("form")))

    scratch.drop(counted)
    vector = scratch.keep(gram_vectors(forms))
    left = vector.where("person").select("lib", "gram", F.col("f").alias("a"), F.col("w").alias("wa"))
    right = vector.select("lib", "gram", F.col("f").alias("b"), F.col("w").alias("wb"), F.col("person").alias("pb"))
    products = left.join(right, ["lib", "gram"]).where("a <> b and (not pb or a < b)").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    candidates = products.where(F.col("cosine") >= LEAST_COSINE)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [compare(x.split(" "), y.split(" ")) for x, y in zip(b.fa, b.fb)]
            out = pd.DataFrame({"a": b.a, "b": b.b, "pb": b.pb, "strong": [g[0] == "strong" for g in got], "weak": [g[0] == "weak" for g in got], "similarity": [g[1] for g in got], "short": [g[2] for g in got]})
            yield out[out.strong | out.weak]

    named = candidates.join(forms.select(F.col("f").alias("a"), F.col("form").alias("fa")), "a").join(forms.select(F.col("f").alias("b"), F.col("form").alias("fb"), F.col("person").alias("pb")), "b")
    judged = scratch.keep(named.select("a", "b", "pb", "fa", "fb").mapInPandas(judge, "a bigint, b bigint, pb boolean, strong boolean, weak boolean, similarity double, short int"))

    scratch.drop(vector)
    entity = scratch.keep(_linked(forms, judged.where("strong")))

    # A short form belongs to the one entity that it fits, if there is just one; single words are settled
    # last, when longer short forms of the same person no longer count as others.
    weak = judged.where("weak")
    fits = weak.where("pb and short = 1").select(F.col("a").alias("f"), F.col("b").alias("to")).unionByName(weak.where("short = 2").select(F.col("b").alias("f"), F.col("a").alias("to")))
    words = forms.select("f", (F.size(F.split("form", " ")) == 1).alias("single"))
    fits = scratch.keep(fits.join(words, "f"))
    scratch.drop(judged)
    for single in (False, True):
        before, entity = entity, scratch.keep(_settled(entity, fits.where("single" if single else "not single")))
        scratch.drop(before)
    scratch.drop(fits)
    return parsed.join(entity, "f").select("lib", "kind", "id", "name", "entity")


class _GramNumbers(dict):
    def __missing__(self, gram: str) -> int:
        got = self[gram] = xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass")) - (1 << 63)
        if len(self) > 1_000_000:
            self.clear()
        return got


def gram_vectors(forms: DataFrame) -> DataFrame:
    """(f, lib, person, gram, w): the n-grams of each form by inverse document frequency, of length one.

    Frequencies are counted over all forms in GRAM_SLOTS slots by a hash of the
    n-gram, so what is sent to the tasks has one size whatever the number of forms;
    n-grams that share a slot count as equally frequent, but not as equal.
    """
    spark = forms.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _GramNumbers()
        for b in batches:
            yield pd.DataFrame({"f": b.f, "lib": b.lib, "person": b.person, "gram": [[number[g] for g in grams(x.split(" "))] for x in b.form]})

    held = spread(forms).mapInPandas(cut, "f bigint, lib bigint, person boolean, gram array<bigint>")
    slot = F.pmod("gram", F.lit(GRAM_SLOTS)).cast("int").alias("slot")
    counted = held.select(F.explode("gram").alias("gram")).select(slot).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most GRAM_SLOTS rows
    often = np.zeros(GRAM_SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(np.log1p(forms.count() / np.maximum(often, 1)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram = b.column(3)
            size = np.diff(gram.offsets.to_numpy())
            flat = gram.flatten()
            row = np.repeat(np.arange(b.num_rows), size)
            w = shared.value[flat.to_numpy() % GRAM_SLOTS]
            norm = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
            first = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(first) for c in range(3)), flat, pa.array(w / norm[row])], ["f", "lib", "person", "gram", "w"])

    return held.mapInArrow(weigh, "f bigint, lib bigint, person boolean, gram bigint, w double")


def _misspelled(counted: DataFrame) -> DataFrame:
    """(token, wrong): of (token, libs), the common tokens that can be typing errors of words that RARER times as many libraries have."""

    def keyed(around: bool, libs: int) -> DataFrame:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(key=[sorted(near_keys(x[2:], around)) for x in b["token"]])

        few = counted.where(F.col("token").startswith("F:") & (F.col("libs") >= libs))
        return few.mapInPandas(cut, "token string, libs bigint, key array<string>").select("token", "libs", F.explode("key").alias("key"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = [most_edits(max(len(x), len(y)) - 2) for x, y in zip(b["token"], b["word"])]
            yield b[[m > 0 and edits(x[2:], y[2:], m) <= m for x, y, m in zip(b["token"], b["word"], most)]][["token"]]

    words = keyed(True, COMMON * RARER).select("key", F.col("token").alias("word"), F.col("libs").alias("more"))
    pairs = keyed(False, COMMON).join(words, "key").where(F.col("more") >= F.col("libs") * RARER).select("token", "word").distinct()
    return pairs.mapInPandas(close, "token string").distinct().select("token", F.lit(True).alias("wrong"))


def _settled(entity: DataFrame, fits: DataFrame) -> DataFrame:
    """(f, entity) after each entity whose forms fit exactly one other has joined it."""
    target = fits.join(entity.select(F.col("f").alias("to"), F.col("entity").alias("target")), "to").join(entity, "f").where("target <> entity")
    alone = target.groupBy("entity").agg(F.min("target").alias("low"), F.max("target").alias("high")).where("low = high").select("entity", F.col("low").alias("target"))
    merged = connected_components(alone, "entity", "target").select(F.col("node").alias("entity"), F.col("component").alias("whole"))
    return entity.join(merged, "entity", "left").select("f", F.coalesce("whole", "entity").alias("entity"))


def _linked(forms: DataFrame, strong: DataFrame) -> DataFrame:
    """(f, entity): average linkage within each connected component of the strong pairs."""
    component = connected_components(strong).withColumnRenamed("node", "a")
    pairs = strong.select("a", "b", "pb", "similarity").join(component, "a")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        components: dict[int, list[tuple[int, int, bool, float]]] = {}
        for t in batches:
            for c, *pair in zip(t.component, t.a, t.b, t.pb, t.similarity):
                components.setdefault(c, []).append(tuple(pair))
        out: list[tuple[int, int]] = []
        for rows in components.values():
            ids = sorted({x for a, b, _, _ in rows for x in (a, b)})
            at = {x: i for i, x in enumerate(ids)}
            people = {a for a, _, _, _ in rows} | {b for _, b, pb, _ in rows if pb}
            similar = {(min(at[a], at[b]), max(at[a], at[b])): s for a, b, _, s in rows}
            group = average_linkage([x in people for x in ids], similar, LINKAGE)
            out += [(x, ids[g]) for x, g in zip(ids, group)]
        yield pd.DataFrame(out, columns=["f", "entity"])

    # Many small components come to a task at once; each is linked by itself.
    together = pairs.select("component", "a", "b", "pb", "similarity").repartition(parts(forms.sparkSession, pairs.count(), 50_000), "component")
    grouped = together.mapInPandas(link, "f bigint, entity bigint")
    return forms.select("f").join(grouped, "f", "left").select("f", F.coalesce("entity", "f").alias("entity"))


def same_entity_pairs(entities: DataFrame) -> DataFrame:
    """(kind_a, id_a, kind_b, id_b): a person with each other person or request of its entity whose name is stored differently."""
    persons = entities.where("kind = 'person'").select("lib", "entity", F.col("id").alias("id_a"), F.col("name").alias("na"))
    others = entities.select("lib", "entity", F.col("kind").alias("kind_b"), F.col("id").alias("id_b"), F.col("name").alias("nb"))
    both = persons.join(others, ["lib", "entity"]).where("na <> nb and (kind_b = 'request' or id_a < id_b)")
    return both.select(F.lit("person").alias("kind_a"), "id_a", "kind_b", "id_b").distinct()
