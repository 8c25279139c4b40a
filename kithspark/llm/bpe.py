"""Byte-pair encoding of a corpus by merge replay.

Texts are cut into words by the tokenizer's pattern. The distinct words of a
task's part of the corpus are laid out in one array; an inverted index leads from
each pair of neighbouring tokens to the positions where it stands. The merges are
replayed in rank order: a merge visits only the positions in its index entry and
updates only the pairs of the touched neighbours. A word's ids don't depend on
the other words, so parts can be replayed apart, and no text is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kithspark.llm.common import spread

#: Fixed value: the published word pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words a task remembers between batches; the memory is emptied beyond that. Bytes of words laid out at once.
REMEMBERED, LAID_OUT = 200_000, 4_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the merged token, for every way to cut a token into two others."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    return pairs


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[list[int]]:
    """The ids of each word, by replaying all merges over the words together."""
    single = [ranks[bytes([b])] for b in range(256)]
    token = [single[b] for w in words for b in w]
    size = len(token)
    begins = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=begins[1:])
    follow, before = list(range(1, size + 1)), list(range(-1, size - 1))
    for b in begins[:-1].tolist():
        if b < size:
            before[b] = -1
    for e in begins[1:].tolist():
        if e:
            follow[e - 1] = -1

    index: dict[int, list[int]] = {}  # rank of the merge -> positions of the left token
    for p in range(size):
        q = follow[p]
        if q >= 0 and (r := pairs.get((token[p], token[q]))) is not None:
            index.setdefault(r, []).append(p)
    todo = list(index)
    heapq.heapify(todo)
    while todo:
        rank = heapq.heappop(todo)
        # A later merge can add positions to a rank that waits, so they are put in order only here.
        for p in sorted(index.pop(rank)):
            q = follow[p] if token[p] >= 0 else -1
            if q < 0 or pairs.get((token[p], token[q])) != rank:
                continue
            token[p], token[q] = rank, -1
            n = follow[p] = follow[q]
            if n >= 0:
                before[n] = p
                if (r := pairs.get((rank, token[n]))) is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(todo, r)
                    index[r].append(p)
            if (b := before[p]) >= 0 and (r := pairs.get((token[b], rank))) is not None:
                if r not in index:
                    index[r] = []
                    heapq.heappush(todo, r)
                index[r].append(b)
    bounds = begins.tolist()
    return [[t for t in token[bounds[i] : bounds[i + 1]] if t >= 0] for i in range(len(words))]


class Encoder:
    """Encodes batches of texts; words seen before keep their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.pairs = ranks, merge_table(ranks)
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def learn(self, words: Iterable[str]) -> None:
        new, size = [], 0
        for w in words:
            new.append(w)
            size += len(w)
            if size > LAID_OUT:
                self._replay(new)
                new, size = [], 0
        self._replay(new)

    def _replay(self, words: list[str]) -> None:
        ids = replay([w.encode("utf-8", "surrogatepass") for w in words], self.ranks, self.pairs)
        self.known.update(zip(words, ids))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn({w for words in cut for w in words}.difference(self.known))
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids array<int>) for every row, by the vocabulary file at ``vocabulary``.

    The file is read on the driver and its table, of fixed size, is broadcast. No
    special tokens: their strings are ordinary text. An empty and a null text give
    an empty list; a null key is kept. Repeated rows give repeated rows.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    rows = spread(docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(ranks.value)
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")


def vocabulary_path(spark: SparkSession) -> str:
    """Where the vocabulary file lies: the setting kithspark.tokenizers, or the usual folder."""
    return spark.conf.get("kithspark.tokenizers", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
