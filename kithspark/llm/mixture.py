"""Gaussian mixture of vectors and the groups of close vectors found with it.

The vectors are standardised and reduced to their main directions. A mixture is
fitted in two levels by expectation maximisation: a coarse one to a bounded
sample on the driver, and for the rows of each coarse component a fine one, in a
task of its own; the number of components is each time the candidate with the
lowest Bayesian information criterion. Covariances are diagonal and regularised
towards the one that all components of a fit share, so no component is so broad
that every vector comes to it. A vector lives in its likeliest fine component
and visits those that are about as likely; how much less likely they may be is so
set that a vector makes VISITS visits on average, whatever the size of the table.
In each component the exact links between those who live there and all who are
there are found, and the links' connected components are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kithspark.llm.common import spread
from kithspark.llm.vectors import DIMS, cosines, matrix, packed, unit
from kithspark.operators.graph import connected_components, roots
from kithspark.session import Scratch

#: Vectors that a fine component should hold; rows of a fitting sample for each component; most fine components, for
#: the model is sent to every task.
PER_COMPONENT, PER_FIT, MOST = 1_200, 100, 65_536
#: Sizes that the information criterion chooses between, as shares of the number that PER_COMPONENT gives.
CANDIDATES = (0.6, 0.8, 1.0, 1.25)
#: Directions kept; visits of a vector on average and at most; coarse components whose parts are weighed.
REDUCED, VISITS, MOST_VISITS, COARSE = 48, 7, 32, 16
#: Home rows and visitors of a component that one task gets; a larger component is dealt out to several.
HOMES, VISITORS = 20_000, 60_000
#: Home rows that are linked before implied links are dropped; rows of a matrix product.
LOCAL, BLOCK = 6_000, 2_048
#: Weight of the shared covariance, as a multiple of a component's mean number of rows.
SHARED = 5.0


@dataclass
class Components:
    """Mean, variances and weight of each component in the reduced directions."""

    mean: np.ndarray
    var: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.weight)

    def log_density(self, y: np.ndarray) -> np.ndarray:
        """Log of weight times density of each component, up to a constant."""
        inverse = (1 / self.var).astype(np.float32)
        const = -0.5 * ((self.mean**2 / self.var).sum(1) + np.log(self.var).sum(1)) + np.log(self.weight)
        return (y * y) @ (-0.5 * inverse.T) + y @ (self.mean * inverse).T.astype(np.float32) + const.astype(np.float32)


def _em(y: np.ndarray, m: Components, rounds: int) -> tuple[Components, float]:
    """``rounds`` of expectation maximisation, in blocks; the components and their log likelihood."""
    n, k, total = len(y), len(m), 0.0
    prior = SHARED * n / k
    for _ in range(rounds):
        count, first, second, total = np.zeros(k), np.zeros_like(m.mean, dtype=np.float64), np.zeros_like(m.mean, dtype=np.float64), 0.0
        for at in range(0, n, 4096):
            block = y[at : at + 4096]
            ll = m.log_density(block)
            top = ll.max(1, keepdims=True)
            np.subtract(ll, top, out=ll)
            np.exp(ll, out=ll)
            s = ll.sum(1, keepdims=True)
            ll /= s
            total += float((np.log(s) + top).sum(dtype=np.float64))
            count += ll.sum(0, dtype=np.float64)
            first += ll.T @ block
            second += ll.T @ (block * block)
        count += 1e-6
        mean = first / count[:, None]
        scatter = np.maximum(second / count[:, None] - mean**2, 0) * count[:, None]
        shared = np.maximum(scatter.sum(0) / count.sum(), 1e-6)
        var = (scatter + shared * prior) / (count[:, None] + prior)  # regularised: never singular, never far from the shared one
        m = Components(mean.astype(np.float32), var.astype(np.float32), (count + prior) / (count + prior).sum())
    return m, total


def fit(y: np.ndarray, total: int, want: float, seed: int = 11) -> Components:
    """Components for ``total`` rows from the sample ``y``: of the CANDIDATES around ``want`` the one with the lowest criterion."""
    n, d = y.shape
    rng = np.random.default_rng(seed)
    best = None
    for k in sorted({max(1, min(round(want * c), n // 4)) for c in CANDIDATES}):
        mean = y[rng.choice(n, k, replace=False)]
        start = Components(mean, np.tile(np.maximum(y.var(0) * 0.7, 1e-6), (k, 1)).astype(np.float32), np.full(k, 1 / k))
        m, likelihood = _em(y, start, 4)
        # The criterion of the whole table: the sample's likelihood stands for all of its rows.
        bic = -2 * likelihood * total / n + k * (2 * d + 1) * math.log(max(total, 2))
        if best is None or bic < best[0]:
            best = bic, m
    return _em(y, best[1], 6)[0]


@dataclass
class Mixture:
    """Linear map to the reduced features, the coarse components, and the fine ones with the coarse one that each is part of.

    ``margin`` is how much less likely than the best a visited component may be;
    ``homes`` and ``visitors`` say over how many tasks a component's are dealt.
    """

    shift: np.ndarray
    project: np.ndarray
    coarse: Components
    fine: Components
    part_of: np.ndarray
    margin: float = 0.0
    homes: np.ndarray | None = None
    visitors: np.ndarray | None = None

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) @ self.project).astype(np.float32)

    def weigh(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(component, log density) of the MOST_VISITS likeliest fine components of each row, among the parts of its
        COARSE likeliest coarse ones; -inf where there are fewer."""
        n, wide = len(y), min(MOST_VISITS, len(self.fine))
        near = min(COARSE, len(self.coarse))
        rough = self.coarse.log_density(y)
        chosen = np.argpartition(-rough, near - 1, axis=1)[:, :near] if near < len(self.coarse) else np.tile(np.arange(near), (n, 1))
        if near == len(self.coarse):
            return _likeliest(self.fine.log_density(y), wide)
        best, value = np.full((n, wide), -1), np.full((n, wide), -np.inf, np.float32)
        for c in np.unique(chosen):
            rows, own = np.flatnonzero((chosen == c).any(1)), np.flatnonzero(self.part_of == c)
            if not len(own):
                continue
            part = Components(self.fine.mean[own], self.fine.var[own], self.fine.weight[own])
            ll = part.log_density(y[rows])
            both = np.concatenate((value[rows], ll), axis=1)
            names = np.concatenate((best[rows], np.tile(own, (len(rows), 1))), axis=1)
            top = np.argpartition(-both, wide - 1, axis=1)[:, :wide]
            best[rows], value[rows] = np.take_along_axis(names, top, 1), np.take_along_axis(both, top, 1)
        return best, value


def _likeliest(ll: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.argpartition(-ll, wide - 1, axis=1)[:, :wide] if wide < ll.shape[1] else np.tile(np.arange(wide), (len(ll), 1))
    return top, np.take_along_axis(ll, top, 1)


def _moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of all vectors; each task gives one row of fixed size."""
    width = 1 + DIMS + DIMS * DIMS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(width)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(b.schema.get_field_index("vec"))).astype(np.float64)
                acc += np.r_[len(x), x.sum(0), (x.T @ x).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()])], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(width)
        for b in batches:
            for row in b.column(0):
                acc += np.asarray(row.values)
        yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()])], ["s"])

    rows = vectors.select("vec").mapInArrow(sums, "s array<double>").repartition(8).mapInArrow(add, "s array<double>").collect()
    acc = sum((np.asarray(r.s) for r in rows), np.zeros(width))
    n = int(acc[0])
    mean = acc[1 : 1 + DIMS] / max(n, 1)
    return n, mean, acc[1 + DIMS :].reshape(DIMS, DIMS) / max(n, 1) - np.outer(mean, mean)


def fit_mixture(vectors: DataFrame) -> tuple[int, Mixture | None]:
    """Fit to (id, vec), vec of unit length: moments of all rows; the coarse level on the driver from a sample of about
    2 * PER_FIT rows for each coarse component, a few tens of thousands at most; the fine level from PER_FIT rows for
    each fine component, a coarse component to a task."""
    n, mean, cov = _moments(vectors)
    if not n:
        return 0, None
    std = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    values, axes = np.linalg.eigh(cov / np.outer(std, std))
    shift, project = mean.astype(np.float32), (axes[:, ::-1][:, :REDUCED] / std[:, None]).astype(np.float32)
    want = min(MOST, max(1.0, n / PER_COMPONENT))
    rough = math.sqrt(want)
    few = max(4_096, round(2 * PER_FIT * rough))
    rows = _one_in(vectors, max(1, n // few), "coarse").select("id", "vec").toArrow().sort_by("id")  # else the fit would depend on how the rows are spread
    x = matrix(rows.column("vec").combine_chunks()) if rows.num_rows else np.zeros((0, DIMS), np.float32)
    y = ((x if len(x) else mean[None, :].astype(np.float32)) - shift) @ project
    coarse = fit(y.astype(np.float32), n, rough)
    once = Mixture(shift, project, coarse, coarse, np.arange(len(coarse)))
    mixture = Mixture(shift, project, coarse, *_fine(vectors, n, want, once))
    _, value = mixture.weigh(mixture.reduced(x)) if len(x) else (None, np.zeros((1, 1), np.float32))
    behind = np.sort((value.max(1, keepdims=True) - value).ravel())
    mixture.margin = float(behind[min(len(behind) - 1, VISITS * max(len(x), 1) - 1)])
    counted = np.zeros((2, len(mixture.fine)))
    if len(x):
        row, cell, own = _visits(*mixture.weigh(mixture.reduced(x)), mixture.margin)
        counted = np.array([np.bincount(own, minlength=len(mixture.fine)), np.bincount(cell, minlength=len(mixture.fine))]) * (n / len(x))
    mixture.homes, mixture.visitors = (np.maximum(1, np.ceil(c / most)).astype(np.int64) for c, most in zip(counted, (HOMES, VISITORS)))
    return n, mixture


def _one_in(vectors: DataFrame, per: int, what: str) -> DataFrame:
    """One row of ``per``, by a hash of the unique ids."""
    return vectors.where(F.pmod(F.xxhash64("id", F.lit(what)), F.lit(per)) == 0) if per > 1 else vectors


def _fine(vectors: DataFrame, n: int, want: float, rough: Mixture) -> tuple[Components, np.ndarray]:
    """The fine components of all coarse ones, and the coarse one of each; at most about MOST rows are collected."""
    per = max(1, int(n / (PER_FIT * want)))
    shared = vectors.sparkSession.sparkContext.broadcast(rough)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = shared.value.reduced(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.coarse.log_density(y).argmax(1).astype(np.int32)), b.column(0), _rows(y)], ["c", "id", "y"])

    def refine(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        y = matrix(t.column("y").combine_chunks(), REDUCED)
        total = len(y) * per
        m = fit(y, total, total / (n / want), seed=int(t.column("c")[0].as_py()))
        weight = np.log(m.weight * total / n)
        return pa.table({"c": np.full(len(m), t.column("c")[0].as_py(), np.int32), "weight": weight, "mean": _rows(m.mean), "var": _rows(m.var)})

    placed = _one_in(vectors, per, "fine").select("id", "vec").mapInArrow(place, "c int, id bigint, y binary")
    found = placed.groupBy("c").applyInArrow(refine, "c int, weight double, mean binary, var binary").toArrow()
    if not found.num_rows:
        return rough.coarse, rough.part_of
    found = found.sort_by([("c", "ascending"), ("weight", "ascending"), ("mean", "ascending")])
    one = lambda c: matrix(found.column(c).combine_chunks(), REDUCED)
    return Components(one("mean"), one("var"), np.exp(found.column("weight").to_numpy())), found.column("c").to_numpy().astype(np.int64)


def _rows(x: np.ndarray) -> pa.Array:
    return packed(np.ascontiguousarray(x, dtype=np.float32))


def weighed(vectors: DataFrame, mixture: Mixture) -> DataFrame:
    """(cell, h, v, id, vec, home, first, density): each vector in its likeliest components.

    A component that the sample shows to be large is dealt out over its tasks
    (h, v): home rows by one hash to h, visitors by another to v, so every home
    row meets every visitor in one of them. ``first`` marks one of a row's copies
    at home.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(mixture)  # at most about MOST components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x, ids = matrix(b.column(1)), b.column(0).to_numpy()
                best, value = m.weigh(m.reduced(x))
                top = value.max(1, keepdims=True)
                density = (top[:, 0] + np.log(np.exp(value - top).sum(1))).astype(np.float64)
                row, cell, own = _visits(best, value, m.margin)
                row, cell, h, v, home, first = dealt(ids, row, cell, own, m.homes, m.visitors)
                place = [pa.array(c.astype(np.int32)) for c in (cell, h, v)]
                yield pa.RecordBatch.from_arrays([*place, pa.array(ids[row]), packed(x[row]), pa.array(home), pa.array(first), pa.array(density[row])], ["cell", "h", "v", "id", "vec", "home", "first", "density"])

    return vectors.mapInArrow(run, "cell int, h int, v int, id bigint, vec binary, home boolean, first boolean, density double")


def dealt(ids: np.ndarray, row: np.ndarray, cell: np.ndarray, own: np.ndarray, homes: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, cell, h, v, home, first) for visits (row, cell): a visitor goes to all h at its own v, and a home row besides
    to all v at its own h."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at_home = own[row] == cell
    my_h = ((mixed[row] >> np.uint64(40)) % homes[cell].astype(np.uint64)).astype(np.int64)
    my_v = ((mixed[row] >> np.uint64(16)) % np.uint64(1 << 24) % visitors[cell].astype(np.uint64)).astype(np.int64)
    times = homes[cell]
    take = np.repeat(np.arange(len(row)), times)
    h = np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
    v = my_v[take]
    home = at_home[take] & (h == my_h[take])
    parts = [(row[take], cell[take], h, v, home, home)]
    times = np.where(at_home, visitors[cell] - 1, 0)  # the copy at its own v is there already
    if times.any():
        take = np.repeat(np.arange(len(row)), times)
        v = np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
        v = v + (v >= my_v[take])
        parts.append((row[take], cell[take], my_h[take], v, np.ones(len(take), bool), np.zeros(len(take), bool)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _visits(best: np.ndarray, value: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (row, component) to visit, and each row's best component, of the likeliest ``best`` with log densities ``value``."""
    top = value.argmax(1)
    rows = np.arange(len(best))
    own = best[rows, top]
    near = (value >= value[rows, top][:, None] - margin) & (best >= 0)
    row, place = np.nonzero(near)
    return row, best[row, place], own


def _linked_rows(x: np.ndarray, home: np.ndarray, least: float) -> np.ndarray:
    """For each row the place of one it is connected with, the same for all that are connected.

    All links of home rows are found, however many rows there are, in blocks.
    """
    n, h = len(x), int(home.sum())
    order = np.argsort(~home, kind="stable")  # home rows first
    y = x[order]
    near, root, left, right = 2e-6, np.arange(n), [], []
    dropped = 0
    for a, b in ((a, b) for a in range(0, h, BLOCK) for b in range(a, n, BLOCK)):
        c = y[a : min(a + BLOCK, h)] @ y[b : b + BLOCK].T
        hit = np.flatnonzero(c.ravel() >= least - near)
        i, j = hit // c.shape[1] + a, hit % c.shape[1] + b
        sure = c.ravel()[hit] >= least + near
        keep = i < j
        i, j, sure = i[keep], j[keep], sure[keep]
        if not sure.all():
            sure[~sure] = cosines(y[i[~sure]], y[j[~sure]]) >= least
            i, j = i[sure], j[sure]
        left.append(i)
        right.append(j)
        if sum(map(len, left)) > 4_000_000 or a >= dropped + LOCAL:  # links that are already implied needn't be kept
            dropped = a
            root = roots(n, np.r_[root, *left], np.r_[np.arange(n), *right])
            left, right = [], []
    root = roots(n, np.r_[root, *left], np.r_[np.arange(n), *right])
    out = np.empty(n, dtype=np.int64)
    out[order] = order[root]
    return out


def link_cell(ids: np.ndarray, x: np.ndarray, home: np.ndarray, least: float) -> np.ndarray:
    """For each row the smallest id it is connected with, by links with a home row of cosine >= least."""
    root = _linked_rows(x, home, least)
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, ids)
    return smallest[root]


def linked_groups(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """((id, group_id), (id, density)) for (id bigint, vec array<float> or binary).

    Vectors have to be usable. Two vectors are linked if their cosine, in double
    and rounded to 6 decimals, is at least ``least``; a group is everything
    connected. Every member of a group of two or more is given with the group's
    smallest id; vectors without a link aren't given. Copies of a vector are
    linked through their smallest id before anything else, so a vector that a
    third of the rows share is no load. Ids must be unique; rows without one are
    left out. An empty table gives no row.
    """
    scratch = Scratch(vectors.sparkSession, "mixture")
    schema = "id bigint, vec binary"

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), packed(unit(matrix(b.column(1))))], ["id", "vec"])

    units = scratch.keep(spread(vectors.select(F.col("id").cast("bigint").alias("id"), "vec").where("id is not null")).mapInArrow(normal, schema))
    again = scratch.keep(_copies(units))
    single = units.join(again.select("id"), "id", "left_anti")
    n, mixture = fit_mixture(single)
    links = again.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    empty = units.sparkSession.createDataFrame([], "id bigint, density double")
    if not n:
        return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group_id")), empty

    def link(table: pa.Table) -> pa.Table:
        ids, home, first = (table.column(c).to_numpy() for c in ("id", "home", "first"))
        root = link_cell(ids, matrix(table.column("vec").combine_chunks()), home, least)
        keep = (root != ids) | first
        return pa.table({"a": ids[keep], "b": root[keep], "home": first[keep], "density": table.column("density").to_numpy()[keep]})

    found = scratch.keep(weighed(single, mixture).groupBy("cell", "h", "v").applyInArrow(link, "a bigint, b bigint, home boolean, density double"))
    scratch.drop(units)
    edges = found.where("a <> b").select("a", "b").unionByName(links)
    groups = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("group_id"))
    density = found.where("home").select(F.col("a").alias("id"), "density")
    # A copy is as dense as the vector that stands for it.
    return groups, density.unionByName(again.join(density.withColumnRenamed("id", "rep"), "rep").select("id", "density"))


def _copies(units: DataFrame) -> DataFrame:
    """(id, rep) of every vector that equals one with a smaller id; only hashes are shuffled."""
    keyed = units.select("id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    many = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1")
    return keyed.join(many, ["h1", "h2"]).where("id <> rep").select("id", "rep")


def typical_members(groups: DataFrame, densities: DataFrame, n: int = 3) -> DataFrame:
    """(group_id, size bigint, members array<bigint>): the n members of highest density, ties to the smaller id."""
    size = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    from kithspark.llm.topn import top_n

    best = top_n(groups.join(densities, "id"), "group_id", "density", "id", n)
    members = best.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("m")).select(F.col("group").alias("group_id"), F.col("m.item").alias("members"))
    return size.join(members, "group_id", "left")
