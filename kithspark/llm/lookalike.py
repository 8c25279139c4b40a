"""One consistent form for texts that look the same.

Code points and short strings that look alike are joined into classes by union
and find, over pairs that come from rules (decompositions, widths, kinds of
space, invisible characters) and from a fixed table. The member of a class that
is most frequent in the texts stands for it, and every text is rewritten with an
automaton that finds the longest pattern at each place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kithspark.llm.common import spread

# Characters that a plain sans-serif font draws alike, one class on each line.
LOOK_ALIKES = """
A Α А Ꭺ
B Β В Ᏼ
C С Ϲ Ꮯ
E Ε Е Ꭼ
G Ԍ Ꮐ
H Η Н Ꮋ
I l Ι І Ӏ ӏ ǀ
J Ј Ϳ Ꭻ
K Κ К Ꮶ
M Μ М Ϻ Ꮇ
N Ν
O Ο О Օ
P Ρ Р Ꮲ
Q Ԛ
S Ѕ Տ Ꮪ
T Τ Т Ꭲ
V Ѵ Ꮩ
W Ԝ Ꮃ
X Χ Х
Y Υ Ү
Z Ζ Ꮓ
a а
c с ϲ
d ԁ
e е
g ɡ
h һ հ
i і
j ј ϳ
o ο о օ
p р ρ
q ԛ
s ѕ
u ս
v ν ѵ
w ԝ
x х
y у
Γ Г
Λ Л
Π П
Φ Ф
κ к ĸ
ə ә
Æ Ӕ
æ ӕ
Ə Ә
Ð Đ Ɖ
3 З Ʒ Ӡ
- ‐ ‑
. ․ ｡
· ‧ ･ ∙ ⋅
: ꞉ ∶
' ꞌ
’ ʼ
カ 力
ロ 口
タ 夕
ニ 二
エ 工
ハ 八
ヘ へ
ー 一
ト 卜
"""

#: Marks over one letter; in whatever order they are stored, one sees the same set.
MARKS = re.compile("[\u0300-\u036f]{2,}")

#: Decompositions that keep the look, by Unicode's tags.
KEEPS_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"}


def invisible(c: str) -> bool:
    """Whether nothing is drawn for ``c``: controls, formats, fillers and variation selectors."""
    o = ord(c)
    if unicodedata.category(c) in ("Cf", "Cc", "Cn", "Co", "Cs") and c not in "\t\n\r\x0b\x0c\x85":
        return True
    return o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF


def same_look(c: str) -> str | None:
    """What the rules say ``c`` looks like, if not only like itself."""
    if invisible(c):
        return ""
    if c.isspace():
        return " " if c != " " else None
    tag, _, rest = unicodedata.decomposition(c).partition(" ") if unicodedata.decomposition(c).startswith("<") else ("", "", unicodedata.decomposition(c))
    if rest and (not tag or tag in KEEPS_LOOK):
        return "".join(chr(int(x, 16)) for x in rest.split())
    full = unicodedata.normalize("NFD", c)
    return full if full != c else None


class Classes:
    """Union and find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while s != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def rewrites(counts: dict[str, int]) -> dict[str, str]:
    """For each pattern that isn't its class's representative, what to write for it.

    ``counts`` has the code points of the texts. Of a class, the member with one
    code point that is most frequent stands for it, ties by the smaller code
    point; a class with the empty string is written as nothing, and one whose
    members decompose is written in its parts, each by its own class.
    """
    classes = Classes()
    for line in LOOK_ALIKES.split("\n"):
        first, *others = line.split() or [""]
        for c in others:
            classes.union(first, c)
    parts: dict[str, str] = {}
    todo, seen = sorted(counts), set()
    while todo:
        c = todo.pop()
        if c in seen:
            continue
        seen.add(c)
        look = same_look(c)
        if look is None:
            continue
        todo.extend(look)
        if len(look) <= 1:
            classes.union(c, look)
        else:
            classes.union(c, look)
            parts[c] = look
    members: dict[str, list[str]] = {}
    for s in list(classes.parent):
        members.setdefault(classes.find(s), []).append(s)
    stands: dict[str, str] = {}
    for group in members.values():
        whole = next((g for g in sorted(group, key=lambda g: (-len(g), g)) if len(g) > 1), None)
        best = "" if "" in group else whole or min(group, key=lambda g: (-counts.get(g, 0), g))
        for g in group:
            stands[g] = best

    def written(s: str, depth: int = 0) -> str:
        out = stands.get(s, s)
        return out if len(out) <= 1 or depth > 8 else "".join(written(x, depth + 1) for x in out)

    return {s: w for s in stands if s and (w := written(s)) != s}


class Rewriter:
    """Greedy rewriting: at each place the longest pattern, then on after it."""

    def __init__(self, patterns: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, v in patterns.items():
            self.automaton.add_word(k, (len(k), v))
        if patterns:
            self.automaton.make_automaton()
        self.any = bool(patterns)

    def __call__(self, text: str) -> str:
        out, at = [], 0
        if self.any:
            for end, (size, new) in self.automaton.iter_long(text):
                begin = end - size + 1
                out += text[at:begin], new
                at = end + 1
        plain = unicodedata.normalize("NFD", "".join(out) + text[at:]).strip()
        return MARKS.sub(lambda m: "".join(sorted(m[0])), plain)


def code_points(texts: DataFrame, text: str) -> dict[str, int]:
    """How often each code point occurs; there are at most as many as Unicode has."""
    each = texts.select(F.explode(F.split(F.col(text), "")).alias("c")).where("c <> ''")
    return {r.c: r.n for r in each.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}


def consistent(rows: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``rows`` with a column ``out``: equal for texts that look the same.

    Outer spaces, kinds of space and invisible characters don't count; case,
    accents and other spelling do. Null stays null; a text of which nothing shows
    gets ''. A column that is already called ``out`` is replaced.
    """
    patterns = rewrites(code_points(rows, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = Rewriter(patterns)
        for b in batches:
            yield b.assign(**{"__form": [rewrite(t) if isinstance(t, str) else None for t in b["__text"]]})

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n.lower() != out.lower())
    base = rows.drop(out).withColumn("__text", F.col(text))
    return spread(base).mapInPandas(run, f"{fields}, `__text` string, `__form` string").drop("__text").withColumnRenamed("__form", out)


def look_alike_pairs(rows: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(a, b): pairs of keys of one group whose texts are stored differently but look the same."""
    forms = consistent(rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(text).alias("t")).where("k is not null and g is not null and t is not null"), "t")
    left = forms.select("g", "form", F.col("k").alias("a"), F.col("t").alias("ta"))
    right = forms.select("g", "form", F.col("k").alias("b"), F.col("t").alias("tb"))
    return left.join(right, ["g", "form"]).where("a < b and ta <> tb").select("a", "b").distinct()


def chosen_names(rows: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key, text, form, chosen): of each group's texts that look the same, the most frequent one stands for all.

    Frequency is counted over the whole table; ties go to the shorter, then the
    smaller text. A null text has no form and is its own choice.
    """
    forms = consistent(rows.select(F.col(key).alias(key), F.col(group).alias("g"), F.col(text).alias(text)), text)
    often = forms.groupBy(text).agg(F.count(F.lit(1)).alias("n"))
    rated = forms.join(often, text).groupBy("g", "form").agg(F.min(F.struct(-F.col("n"), F.length(text), F.col(text).alias("t"))).alias("best")).select("g", "form", F.col("best.t").alias("chosen"))
    return forms.join(rated, ["g", "form"], "left").select(key, text, "form", "chosen")


def confusable(pairs: Iterable[tuple[str, str]], counts: dict[str, int]) -> list[bool]:
    """Whether the two of each pair look the same, given the code points of the texts."""
    rewrite = Rewriter(rewrites(counts))
    return [rewrite(a) == rewrite(b) for a, b in pairs]
