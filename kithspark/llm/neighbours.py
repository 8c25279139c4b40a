"""The most similar vectors of every vector, by cross-polytope hashing.

A vector of unit length is turned by a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) and hashed to the signed axis it is nearest
to; a second hash, of as many axes as the table is large, divides the buckets
further, so they stay of one size. A vector is put into its PROBES likeliest
buckets, so that close vectors on either side of a border still meet; these are
equally many at every size of the table, and so is what a vector costs to move.
In a bucket the cosines are computed exactly and each vector keeps its best; the
best of all its buckets are its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kithspark.llm.common import spread
from kithspark.llm.vectors import DIMS, cosines, matrix, packed, unit
from kithspark.session import Scratch

#: Tables, buckets of each that a vector is put into, and vectors that a bucket should hold at most on average.
TABLES, PROBES, BUCKET = 1, 4, 200_000
#: Vectors of a bucket from which on its task hashes them once more, at no cost of moving them; then the buckets for each, and vectors of one.
INNER, INNER_PROBES, INNER_BUCKET = 24_000, 12, 1_500
#: Pairs found in a task from which on they are merged.
PAIRS = 3_000_000
#: Vectors from which on a bucket is divided; one in LOOKED_AT is kept to find such buckets, at most about ENOUGH are looked at.
HOT, LOOKED_AT, ENOUGH = 150_000, 64, 40_000
#: Entries of a matrix product.
AREA = 4_000_000
#: Vectors of a bucket that others are compared with at once; of a larger bucket the next as many follow, again and again.
AGAIN = 4_096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.float32(math.sqrt(d))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-rotation number ``seed``: thrice random signs and a Hadamard transform."""
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(y: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` nearest signed axes of each row, best first, and how far along them it lies."""
    size = np.abs(y)
    top = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
    value = np.take_along_axis(size, top, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return top * 2 + (np.take_along_axis(y, top, 1) > 0), value


def buckets(x: np.ndarray, table: int, axes: tuple[int, ...], probes: int) -> np.ndarray:
    """The ``probes`` likeliest buckets of each row in ``table``, by one rotation for each of ``axes``, of which so many axes count."""
    keys, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for k, d in enumerate(axes):
        near, value = nearest_axes(rotate(x, 1000 * table + k)[:, :d], min(probes, d))
        lost = (value[:, :1] - value) ** 2
        if d <= probes:  # the opposite ends of the axes are within reach too
            near, lost = np.concatenate((near, near ^ 1), axis=1), np.concatenate((lost, (value[:, :1] + value) ** 2), axis=1)
        keys = (keys[:, :, None] * (2 * x.shape[1]) + near[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        keys, cost = np.take_along_axis(keys, best, 1), np.take_along_axis(cost, best, 1)
    return keys


def _best(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray, c: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j), sorted by i, with rough cosines c: the k best of each i, exactly ranked."""
    new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    count = np.diff(np.r_[new, len(i)])
    place = np.arange(len(i)) - np.repeat(new, count)
    wide = np.full((len(new), int(count.max())), -2, np.float32)
    at = np.repeat(np.arange(len(new)), count)
    wide[at, place] = c
    kth = -np.partition(-wide, k - 1, axis=1)[:, k - 1] if wide.shape[1] > k else np.full(len(new), -2, np.float32)
    keep = c >= kth[at] - 4e-6  # the exact cosine decides between all that could be among the k best
    i, j = i[keep], j[keep]
    exact = cosines(x[i], x[j])
    keep = exact >= least
    i, j, exact = i[keep], j[keep], exact[keep]
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    if not len(i):
        return i, j, exact
    new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    place = np.arange(len(i)) - np.repeat(new, np.diff(np.r_[new, len(i)]))
    return i[place < k], j[place < k], exact[place < k]


def _among(ids: np.ndarray, x: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of each row among all, in blocks of bounded size."""
    n = len(ids)
    block, rows = max(1, min(1024, AREA // min(max(n, 1), AGAIN))), np.arange(n)
    for a in range(0, n, block):
        found = []
        for b in range(0, n, AGAIN):
            c = x[a : a + block] @ x[b : b + AGAIN].T
            w = c.shape[1]
            own = np.arange(max(a, b), min(a + len(c), b + w))
            c[own - a, own - b] = -2
            hit = c >= least - 2e-6
            if hit.sum() > 64 * len(c) and w > 2 * k:  # most are close: only what could be among the k best is looked at
                hit &= c >= np.partition(c, w - k, axis=1)[:, w - k, None] - 4e-6
            flat = np.flatnonzero(hit.ravel())
            if len(flat):
                found.append(_best(ids, x, rows, rows[flat // w + a], rows[flat % w + b], c.ravel()[flat], k, least))
        if found:
            yield found[0] if len(found) == 1 else _merged_best(ids, found, k)


def _merged_best(ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each i of all that was found, best first; a pair that was found twice counts once."""
    i, j, c = (np.concatenate(p) for p in zip(*found))
    order = np.lexsort((ids[j], -c, i))
    i, j, c = i[order], j[order], c[order]
    once = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(i) else np.zeros(0, bool)
    i, j, c = i[once], j[once], c[once]
    new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    place = np.arange(len(i)) - np.repeat(new, np.diff(np.r_[new, len(i)]))
    return i[place < k], j[place < k], c[place < k]


def search_bucket(ids: np.ndarray, x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): the k best partners j of each i within a bucket, best first; exact up to INNER vectors.

    Beyond, the vectors are hashed once more, into INNER_PROBES buckets each by a
    rotation that the outer hash doesn't use, and these are searched exactly.
    """
    if len(ids) <= INNER:
        found = list(_among(ids, x, k, least))
    else:
        found, held = [], 0
        for rows in _inner(x):
            found += [(rows[i], rows[j], c) for i, j, c in _among(ids[rows], x[rows], k, least)]
            held += sum(len(f[0]) for f in found[-1:])
            if held > PAIRS:
                found = [_merged_best(ids, found, k)]
                held = 0
    return _merged_best(ids, found, k) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _inner(x: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each inner bucket."""
    keys = buckets(x, 40, _axes(len(x), INNER_PROBES, INNER_BUCKET), INNER_PROBES)
    order = np.argsort(keys.ravel(), kind="stable")
    sizes = np.unique(keys.ravel(), return_counts=True)[1]
    for part in np.split(order // keys.shape[1], np.cumsum(sizes)[:-1]):
        yield part


def nearest(vectors: DataFrame, k: int, least: float) -> DataFrame:
    """(signal, id, partners array<struct<cosine, id>>): the k most similar others of every vector.

    ``vectors`` is (signal string, id bigint, vec); only vectors of the same
    signal are compared. Vectors have to be usable, ids unique within a signal;
    rows without an id or a signal are left out.
    Partners have a cosine of at least ``least`` and come best first, ties by the
    smaller id; a vector without any isn't given. Equal vectors are each other's
    partners; of a vector that more than k + 1 ids share, the smallest k + 1 are
    searched and stand for the others. The number of buckets follows the size of
    the table, that of the buckets a vector is put into doesn't; a bucket that a
    sample shows to hold far more vectors than others is divided by a further hash
    of what its vectors don't have in common; no bucket is cut. An empty table
    gives no row.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(unit(x)), packed(x)], ["signal", "id", "unit", "vec"])

    rows = spread(vectors.select("signal", F.col("id").cast("bigint").alias("id"), "vec").where("signal is not null and id is not null"))
    units = rows.mapInArrow(normal, "signal string, id bigint, unit binary, vec binary").drop("vec").withColumnRenamed("unit", "vec")
    # One pass over the vectors for what has to be known before they are spread: copies, sizes, and a few to look at.
    looked = F.when(F.pmod(F.xxhash64("id", F.lit("looked at")), F.lit(LOOKED_AT)) == 0, F.col("vec")).alias("looked")
    known = scratch.keep(units.select("signal", "id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"), looked))
    extra = scratch.keep(_further_copies(known, k + 1))
    sizes = {r.signal: r.n for r in known.groupBy("signal").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each signal
    plan = {s: _axes(n) for s, n in sizes.items()}
    hot = vectors.sparkSession.sparkContext.broadcast(_hot_buckets(known, sizes, plan))
    scratch.drop(known)
    searched = units.join(extra.select("signal", "id"), ["signal", "id"], "left_anti")

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                b = batch.slice(at, 8192)
                signal = np.array(b.column(0).to_pylist(), dtype=object)
                for s in sorted(set(signal)):
                    mine = np.flatnonzero(signal == s)
                    part = b.take(pa.array(mine))
                    x = matrix(part.column(2))
                    for t in range(TABLES):
                        row, key = _placed(x, t, plan[s], PROBES, hot.value.get(s, {}))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(key), part.column(1).take(pa.array(row)), packed(x[row])], ["signal", "bucket", "id", "vec"])

    def search(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), matrix(t.column("vec").combine_chunks())
        i, j, c = search_bucket(ids, x, k, least)
        new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        offsets = pa.array(np.r_[new, len(i)].astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(c), pa.array(ids[j])], ["cosine", "id"])
        signal = t.column("signal")[0].as_py()
        return pa.table({"signal": pa.array([signal] * len(new), pa.string()), "id": pa.array(ids[i[new]]), "partners": pa.ListArray.from_arrays(offsets, pairs)})

    kind = "signal string, id bigint, partners array<struct<cosine:double,id:bigint>>"
    found = searched.mapInArrow(spread_out, "signal string, bucket bigint, id bigint, vec binary").groupBy("signal", "bucket").applyInArrow(search, kind)
    best = _merged(found, k)
    return best.unionByName(_for_copies(best, extra, k))


def _axes(n: int, probes: int = PROBES, most: int = BUCKET) -> tuple[int, ...]:
    """Axes of each rotation of a hash, the fewest so that its buckets hold ``most`` vectors at most on average."""
    want, axes = n * probes / most, (DIMS,)
    while (have := math.prod(2 * d for d in axes)) < want:
        axes = (*axes, min(DIMS, max(1, math.ceil(want / have / 2))))
    return axes


def _placed(x: np.ndarray, table: int, axes: tuple[int, ...], probes: int, hot: dict[int, tuple[np.ndarray, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) for every bucket of a table that a row is put into.

    A bucket in ``hot`` is divided: what its vectors have in common is taken from
    them, and the rest is hashed in turn, again with several probes.
    """
    keys = buckets(x, table, axes, probes) * TABLES + table
    row, key = np.repeat(np.arange(len(x)), keys.shape[1]), keys.ravel()
    for b, (mean, more) in hot.items():
        inside = np.flatnonzero(key == b)
        if not len(inside):
            continue
        rest = x[row[inside]] - mean
        size = np.linalg.norm(rest, axis=1, keepdims=True)
        sub = buckets(rest / np.maximum(size, 1e-12), 70 + table, more, 3)
        outside = np.flatnonzero(key != b)
        divided = -1 - (b * (2 * DIMS) ** len(more) + sub)
        row = np.r_[row[outside], np.repeat(row[inside], sub.shape[1])]
        key = np.r_[key[outside], divided.ravel()]
    return row, key


def _hot_buckets(known: DataFrame, sizes: dict[str, int], plan: dict[str, tuple[int, ...]]) -> dict[str, dict[int, tuple[np.ndarray, tuple[int, ...]]]]:
    """For each signal the buckets with more than HOT vectors, by the vectors in ``looked``: their mean and the axes to divide them by.

    There is at most one for each HOT placings, so the result is small.
    """
    out: dict[str, dict[int, tuple[np.ndarray, tuple[int, ...]]]] = {}
    for s, n in sizes.items():
        if n <= HOT:
            continue  # no bucket can hold so many
        per = LOOKED_AT * max(1, n // (LOOKED_AT * ENOUGH))
        rows = known.where((F.col("signal") == s) & F.col("looked").isNotNull() & (F.pmod(F.xxhash64("id", F.lit("looked at")), F.lit(per)) == 0)).select("looked").toArrow()
        if not rows.num_rows:
            continue
        x = matrix(rows.column("looked").combine_chunks())
        for t in range(TABLES):
            keys = buckets(x, t, plan[s], PROBES) * TABLES + t
            row = np.repeat(np.arange(len(x)), keys.shape[1])
            value, count = np.unique(keys.ravel(), return_counts=True)
            for b, c in zip(value.tolist(), count.tolist()):
                about = c * n / len(x)
                if about > HOT:
                    out.setdefault(s, {})[b] = x[row[keys.ravel() == b]].mean(0), _axes(int(about))
    return out


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of all partners found for an id; at most TABLES times probes lists of k each."""
    order = F.expr("transform(partners, p -> struct(-p.cosine as c, p.id as id))")
    lists = found.withColumn("partners", order).groupBy("signal", "id").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("p"))
    return lists.select("signal", "id", F.expr(f"transform(slice(array_sort(p), 1, {k}), q -> struct(-q.c as cosine, q.id as id))").alias("partners"))


def _further_copies(keyed: DataFrame, keep: int) -> DataFrame:
    """(signal, id, rep): of (signal, id, h1, h2), ids beyond the ``keep`` smallest of equal hashes."""
    from pyspark.sql import Window

    key = ["signal", "h1", "h2"]
    keyed = keyed.select("id", *key)
    many = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where(F.col("n") > keep).drop("n")
    members = keyed.join(many, key)
    # Ranked over salts first, so that a vector that very many ids share isn't ranked in one task.
    salted = Window.partitionBy(*key, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    small = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= keep)
    small = small.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("r") <= keep)
    return members.join(small.select("signal", "id"), ["signal", "id"], "left_anti").select("signal", "id", "rep")


def _for_copies(best: DataFrame, extra: DataFrame, k: int) -> DataFrame:
    """Partners of the further copies: those of the smallest copy, and itself."""
    of = best.select("signal", F.col("id").alias("rep"), F.col("partners").alias("p"))
    with_rep = F.expr(f"transform(slice(array_sort(transform(concat(p, array(struct(1D as cosine, rep as id))), q -> struct(-q.cosine as c, q.id as id))), 1, {k}), q -> struct(-q.c as cosine, q.id as id))")
    return extra.join(of, ["signal", "rep"]).select("signal", "id", with_rep.alias("partners"))


def neighbour_pairs(best: DataFrame) -> DataFrame:
    """(signal, id_a, id_b) of each unordered pair where one is among the other's partners."""
    pair = best.select("signal", "id", F.explode("partners.id").alias("other"))
    return pair.select("signal", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
