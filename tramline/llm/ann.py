"""Nearest neighbours by largest inner product: stable projections, a kd-tree over them, and a chi-square stopping test.

With one more component, sqrt(M^2 - |x|^2), all vectors have the length M, and the largest inner product becomes the least distance.
A Gaussian (2-stable) projection to m dimensions makes of a squared distance d^2 the random d^2 chi^2(m). One kd-tree lies over all
projected vectors: its top, split on a sample of ``SAMPLE`` rows at most, deals every vector to a block of about ``block_rows``; each
block carries the tree on to leaves. A query first searches the block that its own projection falls into, then those blocks that the
test does not rule out. In a block it takes leaves in the order of their boxes' distance, one, two, four and so on at a time, and verifies all their vectors
with exact inner products. It stops as soon as a vector as near as its k-th best would lie within the next box's distance with
probability ``sure``; a block is left out by the same test. Every vector is in an index; only projections approximate.

Of equal vectors k + 1 rows, those of the least ids, are enough for any answer, and equal queries are searched once, so copies of
a vector cost no more than one. Vectors that are null, zero or hold null or non-finite components take no part; nor do rows without an
id. A vector is compared with those of its own number of components only. Ties go to the smaller id; fewer candidates than k are all
returned; an empty table gives an empty result; rows that repeat an id are candidates each, and queries each: only a query's own
row is no candidate of it; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS, LEAF, DIMENSIONS, QUERIES, SAMPLE = 8192, 64, 8, 256, 100_000
#: Queries of a block that one task takes.
ASKED = 20_000


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Of the chi-square distribution with an even number m of degrees of freedom."""
    h = np.maximum(x, 0) / 2
    return 1 - np.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree: split at the median of the widest dimension until ``leaf`` rows or fewer are left."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = points[rows]
        by = np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], len(rows) // 2)
        todo += [rows[by[: len(rows) // 2]], rows[by[len(rows) // 2 :]]]
    return out


class Top:
    """The top of the tree for vectors of one number of components: the projection, the splits, and the box of each block once it is known."""

    def __init__(self, size: int, top: float, dimensions: int = DIMENSIONS):
        self.rule, self.top, self.m = np.random.default_rng(7).standard_normal((size + 1, dimensions)), top, dimensions
        self.splits: list[tuple[int, float, int, int]] = []  # (dimension, value, child below, child above); children from 0 on are nodes, below that blocks
        self.low = self.high = np.zeros((0, dimensions))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """Of indexed vectors; a query's added component is 0."""
        return vectors @ self.rule[:-1] + np.sqrt(np.maximum(self.top - (vectors**2).sum(axis=1), 0))[:, None] * self.rule[-1]

    def split(self, points: np.ndarray, blocks: int) -> None:
        made = 0

        def node(rows: np.ndarray, want: int) -> int:
            nonlocal made
            if want <= 1 or len(rows) < 2:
                made += 1
                return -made
            own = points[rows]
            at = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            below = want // 2
            by = np.argsort(own[:, at], kind="stable")
            cut = max(1, len(rows) * below // want)
            value = float(own[by[cut], at])
            place = len(self.splits)
            self.splits.append((at, value, 0, 0))
            left = node(rows[own[:, at] < value], below)
            right = node(rows[own[:, at] >= value], want - below)
            self.splits[place] = (at, value, left, right)
            return place

        self.root, self.blocks = node(np.arange(len(points)), blocks), 0
        self.blocks = made

    def block_of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -at - 1
            elif len(rows):
                d, value, left, right = self.splits[at]
                below = points[rows, d] < value
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def boxes(self, found: list[tuple[int, list[float], list[float]]]) -> None:
        self.low, self.high = np.full((self.blocks, self.m), np.inf), np.full((self.blocks, self.m), np.inf)  # blocks without a vector are endlessly far
        for block, low, high in found:
            self.low[block], self.high[block] = low, high

    def open_blocks(self, queries: np.ndarray, kth: np.ndarray, sure: float) -> list[np.ndarray]:
        """For each query the blocks that the test does not rule out, given its k-th best score (-inf if there are fewer)."""
        q = queries @ self.rule[:-1]
        far = self.top + (queries**2).sum(axis=1) - 2 * kth
        out = []
        for i in range(len(q)):
            gap = (np.maximum(0, np.maximum(self.low - q[i], q[i] - self.high)) ** 2).sum(axis=1)
            ruled = chi2_cdf(gap / max(far[i], 1e-300), self.m) >= sure if np.isfinite(kth[i]) else np.zeros(len(gap), bool)
            out.append(np.flatnonzero(np.isfinite(gap) & ~ruled))
        return out


class Index:
    """The leaves of one block."""

    def __init__(self, top: Top, ids: np.ndarray, row: np.ndarray, vectors: np.ndarray):
        points = top.points(vectors)
        leaves = kd_leaves(points)
        order = np.concatenate(leaves)
        self.tree, self.ids, self.row, self.vectors = top, ids[order], row[order], vectors[order]
        self.edges = np.r_[0, np.cumsum([len(x) for x in leaves])]
        self.low = np.stack([points[x].min(axis=0) for x in leaves])
        self.high = np.stack([points[x].max(axis=0) for x in leaves])
        self.longest = float(np.sqrt((vectors**2).sum(axis=1).max()))
        self.read = 0  # pairs of a query and a vector that were verified

    def search(self, queries: np.ndarray, k: int, sure: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query (ids, rows, scores) of its nearest here, k at most."""
        q = queries @ self.tree.rule[:-1]
        gap = sum(np.maximum(0, np.maximum(self.low[:, i][None] - q[:, i : i + 1], q[:, i : i + 1] - self.high[:, i][None])) ** 2 for i in range(self.tree.m))
        order = np.argsort(gap, axis=1, kind="stable")
        sorted_gap = np.take_along_axis(gap, order, axis=1)
        scores = np.full((len(q), len(self.ids)), -np.inf)
        alive, at, leaves, step = np.arange(len(q)), 0, len(self.low), 1
        length = (queries**2).sum(axis=1)
        while len(alive) and at < leaves:
            wanted = np.zeros((len(q), leaves), bool)
            np.put_along_axis(wanted[: len(alive)], order[alive, at : at + step], True, axis=1)
            for leaf in np.flatnonzero(wanted.any(axis=0)):
                rows = alive[wanted[: len(alive), leaf]]
                a, b = self.edges[leaf], self.edges[leaf + 1]
                scores[rows, a:b] = queries[rows] @ self.vectors[a:b].T
                self.read += len(rows) * int(b - a)
            at, step = at + step, 2 * step
            if at >= leaves:
                break
            if scores.shape[1] >= k:
                kth = -np.partition(-scores[alive], k - 1, axis=1)[:, k - 1]
                far = self.tree.top + length[alive] - 2 * kth
                alive = alive[~(np.isfinite(kth) & (chi2_cdf(sorted_gap[alive, at] / np.maximum(far, 1e-300), self.tree.m) >= sure))]
        slack = 1e-12 * np.sqrt(length) * self.longest * queries.shape[1]  # what the order of adding up can change
        for i in range(len(q)):
            s = scores[i]
            kth = -np.partition(-s, k - 1)[k - 1] if len(s) >= k else -np.inf
            rows = np.flatnonzero((s >= kth - slack[i]) & (s > -np.inf)) if np.isfinite(kth) else np.flatnonzero(s > -np.inf)
            exact = (self.vectors[rows] * queries[i]).sum(axis=1)
            best = np.lexsort((self.row[rows], self.ids[rows], -exact))[:k]
            yield self.ids[rows[best]], self.row[rows[best]], exact[best]


def _matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, size)


def _by_size(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = batch.column(column).value_lengths().to_numpy()
    for n in np.unique(size).tolist():
        yield n, batch if (size == n).all() else batch.filter(pa.array(size == n))


def tops(index: DataFrame, block_rows: int) -> dict[int, Top]:
    """The tree's top for each number of components, from a bounded sample: rows of the least hashes."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    sizes = {r["size"]: (r["n"], r["top"]) for r in index.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("top")).collect()}  # a row for each number of components
    sample = index.select("embedding").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow().combine_chunks().to_batches()  # bounded
    out = {n: Top(n, top) for n, (_, top) in sizes.items()}
    some = {n: _matrix(part.column(0), n) for batch in sample for n, part in _by_size(batch, 0)}
    for n, tree in out.items():
        tree.split(tree.points(some.get(n, np.zeros((0, n)))), max(1, -(-sizes[n][0] // block_rows)))
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, sure: float = 0.97, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors: (vec_id, embedding); queries: ids divisible by ``every``."""
    context = vectors.sparkSession.sparkContext
    x = F.col("embedding")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    fine = fine.where("vec_id is not null and embedding is not null").where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0))
    fine = fine.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", lambda v: v + F.lit(0.0)).alias("embedding"))
    fine = written(fine.withColumns({"v": F.xxhash64("embedding"), "v2": F.xxhash64(F.lit(1), "embedding")}), "vectors")  # v, v2: which vector
    few = Window.partitionBy("v", "v2").orderBy("vec_id", "row")
    index = written(fine.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1).drop("nth"), "index")
    asked = fine.where(F.col("vec_id") % every == 0)
    wanted = written(asked.groupBy("v", "v2").agg(F.first("embedding").alias("embedding")), "queries")
    trees = tops(index, block_rows)
    send = context.broadcast(trees)  # splits: fewer than blocks, that is, a few bytes for each block_rows vectors

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(size, block, row, vec_id, point, embedding) of (row, vec_id, embedding)."""
        for big in batches:
            for n, batch in _by_size(big, 2):
                points = send.value[n].points(_matrix(batch.column(2), n))
                block = send.value[n].block_of(points)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), n)), pa.array(block), batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), points.shape[1]).cast(pa.list_(pa.float64())), batch.column(2)], ["size", "block", "row", "vec_id", "point", "embedding"])

    placed = written(index.select("row", "vec_id", "embedding").mapInArrow(dealt, "size long, block long, row long, vec_id long, point array<double>, embedding array<double>"), "blocks")
    edges = [f(F.col("point")[i]) for f in (F.min, F.max) for i in range(DIMENSIONS)]
    for n, tree in trees.items():
        tree.boxes([])
    boxes = placed.groupBy("size", "block").agg(F.array(*edges[:DIMENSIONS]).alias("low"), F.array(*edges[DIMENSIONS:]).alias("high")).collect()  # a row a block
    for n, tree in trees.items():
        tree.boxes([(r["block"], r["low"], r["high"]) for r in boxes if r["size"] == n])
    full = context.broadcast(trees)  # and 16 numbers for each block

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (v, v2, kth, done, embedding): without a kth the block a query falls into, else the others that it must see."""
        for big in batches:
            for n, batch in _by_size(big, 4):
                if n not in full.value:
                    continue
                tree, q = full.value[n], _matrix(batch.column(4), n)
                kth, done = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
                blocks = [np.array([b]) for b in tree.block_of(q @ tree.rule[:-1])] if batch.column(3).null_count else [b[b != d] for b, d in zip(tree.open_blocks(q, kth, sure), done, strict=True)]
                row = pa.array(np.repeat(np.arange(len(batch)), [len(b) for b in blocks]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), n)), pa.array(np.concatenate([*blocks, np.zeros(0, np.int64)]).astype(np.int64)), *(batch.column(i).take(row) for i in (0, 1, 4))], ["size", "block", "v", "v2", "embedding"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (size, block, part, query, v, v2, embedding) come sorted: a block's vectors, with row and id for v and v2, then its queries."""
        at, held, index = None, [], None
        for big in batches:
            key = np.stack([np.asarray(big.column(i)) for i in range(3)], 1)
            asks = big.column(3).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1, len(key)]
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if i == j:
                    continue
                if tuple(key[i]) != at:
                    at, held, index = tuple(key[i]), [], None
                n, part = int(key[i, 0]), big.slice(i, j - i)
                if not asks[i]:
                    held.append(part)
                    continue
                if index is None and held:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    index, held = Index(full.value[n], np.asarray(t.column(5)), np.asarray(t.column(4)), _matrix(t.column(6), n)), []
                if index is None:
                    continue
                for a in range(0, len(part), QUERIES):
                    some = part.slice(a, QUERIES)
                    found = list(index.search(_matrix(some.column(6), n), k + 1, sure))
                    r = pa.array(np.repeat(np.arange(len(some)), [len(f[0]) for f in found]))
                    yield pa.RecordBatch.from_arrays([some.column(1).take(r), some.column(4).take(r), some.column(5).take(r), *(pa.array(np.concatenate([f[c] for f in found])) for c in range(3))], ["block", "v", "v2", "vec_id", "row", "score"])

    def searched(asks: DataFrame) -> DataFrame:
        """asks: (size, block, v, v2, embedding). A block with more than ``ASKED`` queries goes to several tasks."""
        asks = written(asks, "asks")
        parts = asks.groupBy("size", "block").agg(F.ceil(F.count("*") / ASKED).alias("parts"))  # a row a block
        one = asks.join(F.broadcast(parts), ["size", "block"]).select("size", "block", F.pmod("v", "parts").alias("part"), F.lit(True).alias("query"), "v", "v2", "embedding")
        base = placed.join(F.broadcast(parts), ["size", "block"]).select("size", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"), F.col("row").alias("v"), F.col("vec_id").alias("v2"), "embedding")
        rows = base.unionByName(one).repartition("size", "block", "part").sortWithinPartitions("size", "block", "part", "query")
        return rows.mapInArrow(search, "block long, v long, v2 long, vec_id long, row long, score double")

    names, schema = ["v", "v2", "kth", "done", "embedding"], "size long, block long, v long, v2 long, embedding array<double>"
    first = written(searched(wanted.select("v", "v2", F.lit(None).cast("double").alias("kth"), F.lit(None).cast("long").alias("done"), "embedding").mapInArrow(homes, schema)), "near")
    bound = first.groupBy("v", "v2").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("kth"), F.max("block").alias("done"))
    again = wanted.join(bound, ["v", "v2"], "left").select("v", "v2", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), F.coalesce("done", F.lit(-1).cast("long")).alias("done"), "embedding").select(*names)
    found = first.unionByName(searched(again.mapInArrow(homes, schema))).drop("block")
    best = Window.partitionBy("v", "v2").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    own = asked.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), "v", "v2").join(found, ["v", "v2"]).where("q_row <> row")
    rank = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return own.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
