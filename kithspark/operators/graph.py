"""Close pairs, connected components and density-based clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kithspark.functions.vectors import usable, validate_weights
from kithspark.schemas import EYE_WEIGHT, FULL_WEIGHT, NOISE
from kithspark.session import Scratch

#: Rows of a block of the exact pair search; edges that one task may connect.
BLOCK, EDGES = 3_000, 2_000_000

#: Similarities, from -1 to 1, of each row of one matrix of unit rows with each of another.
Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _min_of(e: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest of u and its neighbours.

    The minima are reduced before their shuffle; the join back has one row for
    each u on one side, so a u with very many edges can be split by the planner.
    """
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(least, "u")


def _distinct_edges(e: DataFrame) -> DataFrame:
    return e.where("u <> v").distinct()


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n can reach over the edges (i, j), by propagation and pointer jumping."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
        differ = root[i] != root[j]
        i, j = i[differ], j[differ]
    return root


def _forests(edges: DataFrame, tasks: int) -> DataFrame:
    """(u, v) with which each task's share of the edges (u, v) can be replaced: every node and the smallest it reaches there."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        node, place = np.unique(np.concatenate([t.column(0).to_numpy(), t.column(1).to_numpy()]), return_inverse=True)
        root = roots(len(node), place[: t.num_rows], place[t.num_rows :])
        below = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(node[root[below]])], ["u", "v"])

    dealt = edges.repartition(tasks, F.xxhash64("u", "v")) if tasks > 1 else edges.coalesce(1)
    return dealt.mapInArrow(shrink, "u bigint, v bigint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node bigint, component bigint): component is the smallest node that can be reached.

    Edges are undirected; repeated edges and self-loops change nothing, though a
    node with only a self-loop is a component. Edges with a null end are left
    out. Each task first replaces its share of the edges by a forest. While more
    than EDGES are left, large-star and small-star steps alternate, until every
    node hangs on its component's smallest node; so many or fewer fit a task,
    which ends the work. Each round is written to the shared folder, which cuts
    the lineage and survives the loss of an executor, and is removed once the
    next is there.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    raw = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null")
    raw = scratch.keep(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    size = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, mark, at = raw.where("u <> v"), None, 0
    n = now.count()
    if n > EDGES:
        now = scratch.keep(_forests(now, math.ceil(n / EDGES)).distinct())
        n = now.count()
    while n > EDGES:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _distinct_edges(_min_of(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _min_of(large)
        star = _distinct_edges(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))))
        old, now = now, scratch.keep(star)
        seen = tuple(size(now))
        scratch.drop(old)
        if seen == mark:
            break
        mark, n, at = seen, seen[0], at + 1
        if at == rounds:
            raise RuntimeError(f"components did not settle within {rounds} rounds")
    else:
        now = scratch.keep(_forests(now, 1))
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    loops = raw.where("u = v").select(F.col("u").alias("node")).distinct()
    alone = loops.join(members.select("node").unionByName(tops.select("node")), "node", "left_anti").withColumn("component", F.col("node"))
    found = scratch.keep(members.unionByName(tops).unionByName(alone))
    scratch.drop(raw)
    scratch.drop(now)
    return found


def close_pairs(vectors: DataFrame, eps: float, full: str = "full", eye: str | None = None, weights: tuple[float, float] = (FULL_WEIGHT, EYE_WEIGHT), block: int = BLOCK, scope: str | None = None, metric: Metric | None = None) -> DataFrame:
    """(a, b, distance), a < b: every pair of rows of (id, full[, eye][, scope]) whose distance is at most ``eps``. Exact.

    The distance is 1 - cosine, or 1 - the weighted mean of both cosines where
    both rows have an eye vector; or what ``metric`` gives for two matrices of
    unit rows, in place of the cosine. ``full`` must be usable, and only vectors
    of the same length are compared; an eye vector that is unusable or not as
    long as most of the table's, of equally frequent lengths the smaller, counts
    as missing. With a ``scope`` column only rows of the same scope meet, and
    those of a null scope none. Rows of a scope are dealt into blocks of about
    ``block``, and each pair of blocks is one matrix product, so tasks are even
    whatever the data; only close pairs are given out. The work is quadratic in
    the largest scope, as an exact result needs at distances as wide as these,
    where no bound of angles leaves any pair out; it is linear in the number of
    scopes.
    """
    wf, we = validate_weights(*weights)
    none = F.lit(None).cast("array<float>")
    own_scope = F.col(scope) if scope else F.lit(0)
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), own_scope.alias("scope"), F.col(full).alias("full"), (F.when(usable(F.col(eye)), F.col(eye)) if eye else none).alias("eye")).where("scope is not null")
    lengths = rows.where("eye is not null").groupBy(F.size("eye").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect() if eye else []
    dim = lengths[0].d if lengths else 0
    rows = rows.withColumn("eye", F.when(F.size("eye") == dim, F.col("eye")))
    count = rows.groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    rows = rows.join(count, "scope").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = rows.withColumn("other", other).select("scope", "id", "full", "eye", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    similar = metric or _cosine

    def product(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
        same = t.column("p")[0].as_py() == t.column("q")[0].as_py()
        left = np.flatnonzero(own == t.column("p")[0].as_py())
        right = left if same else np.flatnonzero(own == t.column("q")[0].as_py())
        f = _unit_rows(t.column("full"))
        has = t.column("eye").is_valid().to_numpy()
        e = np.zeros((len(ids), max(dim, 1)))
        if has.any():
            e[has] = _unit_rows(t.column("eye").filter(t.column("eye").is_valid()))
        out = []
        for at in range(0, len(left), 1024):
            l = left[at : at + 1024]
            fs = similar(f[l], f[right])
            if has[l].any() and has[right].any():
                both = has[l][:, None] & has[right][None, :]
                fs = np.where(both, wf * fs + we * similar(e[l], e[right]), fs)
            i, j = np.nonzero(1 - fs <= eps)
            d, i2, j2 = (1 - fs)[i, j], ids[l[i]], ids[right[j]]
            keep = i2 < j2 if same else np.ones(len(i2), bool)
            out.append((np.minimum(i2, j2)[keep], np.maximum(i2, j2)[keep], d[keep]))
        a, b, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "distance": np.clip(d, 0, 2)})

    return placed.groupBy("scope", "p", "q", F.size("full").alias("dims")).applyInArrow(product, "a bigint, b bigint, distance double")


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(x @ y.T, -1, 1)


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix of unit rows."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def density_clusters(vertices: DataFrame, edges: DataFrame, min_samples: int = 1) -> DataFrame:
    """(id, label): density-based clusters over the edges (a, b) between close vertices (id).

    A vertex with at least ``min_samples`` close vertices, itself included, is a
    core; cores that are close form a cluster, named by its smallest core. A
    vertex close to a core joins the smallest of their clusters; any other is
    noise, -1. With ``min_samples`` 1 every vertex is a core and the labels are
    the connected components.
    """
    if min_samples < 1:
        raise ValueError("min_samples must be at least 1")
    ids = vertices.select(F.col("id").cast("bigint").alias("id"))
    if min_samples == 1:
        found = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("label"))
        return ids.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("near")))
    cores = Scratch(edges.sparkSession, "density").keep(both.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_samples).select("id"))
    linked = both.join(cores, "id").join(cores.select(F.col("id").alias("near")), "near", "left_semi").where("id < near")
    found = connected_components(linked, "id", "near").select(F.col("node").alias("id"), F.col("component").alias("label"))
    core_labels = cores.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    border = both.join(cores, "id", "left_anti").join(core_labels.select(F.col("id").alias("near"), "label"), "near").groupBy("id").agg(F.min("label").alias("label"))
    return ids.join(core_labels.unionByName(border), "id", "left").select("id", F.coalesce("label", F.lit(NOISE)).alias("label"))
