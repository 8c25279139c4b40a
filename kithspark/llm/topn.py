"""The N best items of every group, by merging sorted runs with a loser tree.

Each partition of the input becomes a run, ordered by group and then by score,
and is cut to N items for each group: the best N overall are among the best N of
the runs, so a group with millions of items leaves at most N items for each run.
The runs are stored in the shared folder; how many rows they have says into how
many buckets of groups they are dealt, so a task of the merge gets about
BUCKET_ROWS whatever the size of the table. A task merges the runs of its bucket
and, once a group has N outputs, seeks to the next group in every run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kithspark.session import Scratch

#: Items that one task of the merge should get.
BUCKET_ROWS = 200_000


class LoserTree:
    """Winner of k sorted runs; inner nodes hold the losers of their matches."""

    def __init__(self, heads: list):
        self.k = len(heads)
        self.heads = heads  # the next key of each run, None at its end
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._enter(run)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def _enter(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = run
                return
            if not self._before(run, self.losers[node]):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run

    @property
    def winner(self) -> int:
        return self.losers[0]

    def replace(self, key) -> None:
        """Put the winner's next key in its place and replay its matches."""
        run = self.losers[0]
        self.heads[run] = key
        node = (run + self.k) // 2
        while node:
            if not self._before(run, self.losers[node]):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run


def merge_top(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, starts: list[int], n: int) -> list[int]:
    """Positions of the N best of each group, over runs that begin at ``starts``."""
    ends = [*starts[1:], len(groups)]
    nexts = np.r_[np.flatnonzero(np.diff(groups)) + 1, len(groups)] if len(groups) else np.array([0])
    g, s, i = groups.tolist(), (-scores).tolist(), ids.tolist()
    at = list(starts)
    key = lambda run: (g[p], s[p], i[p]) if (p := at[run]) < ends[run] else None
    tree = LoserTree([key(r) for r in range(len(starts))])
    out: list[int] = []
    group, taken = None, 0
    while tree.k and tree.heads[run := tree.winner] is not None:
        p = at[run]
        if g[p] != group:
            group, taken = g[p], 0
        if taken < n:
            out.append(p)
            taken += 1
            at[run] = p + 1
        else:  # seek: this run's next group
            at[run] = min(int(nexts[np.searchsorted(nexts, p, side="right")]), ends[run])
        tree.replace(key(run))
    return out


def top_n(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """(group bigint, rank int, item bigint, score double): the n best items of every group.

    Higher scores come first, ties go to the smaller item. Rows whose group, item
    or score is null, or whose score is NaN, are left out. Repeated rows count as
    often as they occur. Exact at every size. An empty table gives no row.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).cast("bigint").alias("g"), F.col(score).cast("double").alias("s"), F.col(item).cast("bigint").alias("i")).where("g is not null and i is not null and s is not null and not isnan(s)")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, had = TaskContext.get().partitionId(), None, 0
        for b in batches:
            g = b.column("g").to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            place = np.arange(len(g)) - np.repeat(new, np.diff(np.r_[new, len(g)]))
            if g[0] == last:
                first = new[1] if len(new) > 1 else len(g)
                place[:first] += had
            last, had = g[-1], int(place[-1]) + 1
            keep = b.filter(pa.array(place < n))
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(np.full(keep.num_rows, run), pa.int32())], ["g", "s", "i", "run"])

    scratch = Scratch(df.sparkSession, "runs")
    runs = scratch.keep(rows.sortWithinPartitions("g", F.desc("s"), "i").mapInArrow(cut, "g bigint, s double, i bigint, run int"))
    buckets = math.ceil(runs.count() / BUCKET_ROWS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        g, s, i, run = (pa.Table.from_batches(got).column(c).to_numpy() for c in ("g", "s", "i", "run"))
        starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist()]
        out = np.array(merge_top(g, s, i, starts, n), dtype=np.int64)
        og = g[out]
        new = np.flatnonzero(np.r_[True, og[1:] != og[:-1]])
        rank = np.arange(len(og)) - np.repeat(new, np.diff(np.r_[new, len(og)])) + 1
        yield pa.RecordBatch.from_arrays([pa.array(og), pa.array(rank.astype(np.int32)), pa.array(i[out]), pa.array(s[out])], ["group", "rank", "item", "score"])

    # The shuffle mixes what comes from different runs; sorted by run they lie one after another again, each in its order.
    bucket = runs.repartition(max(1, buckets), "g").sortWithinPartitions("run", "g", F.desc("s"), "i")
    return bucket.mapInArrow(merge, "group bigint, rank int, item bigint, score double")
