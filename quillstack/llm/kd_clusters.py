"""Centroid clustering by kd-tree filtering, in whole numbers.

Vectors are packed into blocks of ``BLOCK`` rows at most, and each block's rows are ordered by a kd-tree, stored with them:
a node holds its rows' count, the exact sums of their components, and their box. In a round every block's nodes are
visited level by level with the centroids that may still be nearest: the one nearest to the box's middle prunes each
other that is farther from every point of the box (strictly, so ties are left to the rows). A node with one centroid left
is assigned whole by its count and sums; a leaf's rows are compared exactly with the centroids left. A task adds up
its blocks, and one row a centroid and component is summed over tasks: the driver sees k times the length numbers a round.

All arithmetic is whole numbers of 64 bits (components end at 2**27), the new centroid is the exact floor(sum / count).
Vectors that are null, of another length, or have a null or not finite component take no part; fewer vectors than
centroids make fewer centroids. Repeated rows are rows of their own. A row without an id is clustered, but is no starting
centroid while others are left. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import discard, stored
from quillstack.llm.vectors import is_finite, matrix, unpacked, whole

LENGTH, CENTROIDS, ROUNDS = 64, 40, 5
BLOCK, LEAF = 4096, 32


def build_tree(rows: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and per node its start, end and left child (-1 of a leaf); a right child follows its left one.

    A node is cut at the median of its widest component, so the depth is the logarithm of the rows, whatever their values.
    """
    order, nodes, at = np.arange(len(rows)), [[0, len(rows), -1]], 0
    while at < len(nodes):
        start, end, _ = nodes[at]
        own = order[start:end]
        if end - start > leaf:
            spread = rows[own].max(0) - rows[own].min(0)
            wide = int(spread.argmax())
            if spread[wide] > 0:
                half = (end - start) // 2
                order[start:end] = own[np.argpartition(rows[own, wide], half)]
                nodes[at][2] = len(nodes)
                nodes += [[start, start + half, -1], [start + half, end, -1]]
        at += 1
    return order, np.array(nodes, np.int64)


def measured(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, lower and upper box corners of all nodes over the ordered rows, children before parents."""
    sums, low, high = (np.empty((len(nodes), rows.shape[1]), np.int64) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        start, end, left = nodes[i]
        if left < 0:
            own = rows[start:end]
            sums[i], low[i], high[i] = own.sum(0), own.min(0), own.max(0)
        else:
            sums[i] = sums[left] + sums[left + 1]
            low[i], high[i] = np.minimum(low[left], low[left + 1]), np.maximum(high[left], high[left + 1])
    return sums, low, high


def dominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """alive (nodes, k) without the centroids that another one beats strictly in every point of the node's box."""
    norms = (centroids * centroids).sum(1)
    middle = low + high  # twice the middle: 4 |m - c|^2 = |2m|^2 - 4 c.2m + 4 |c|^2
    far = 4 * norms - 4 * (middle @ centroids.T)
    best = np.where(alive, far, np.iinfo(np.int64).max).argmin(1)
    out = alive.copy()
    for i in range(len(low)):
        against = centroids - centroids[best[i]]
        # over the box the distance to z less that to the best is least in the corner farthest along z - best
        most = np.where(against > 0, against * high[i], against * low[i]).sum(1)
        out[i] &= norms - norms[best[i]] - 2 * most <= 0
        out[i, best[i]] = True
    return out


def filtered(nodes: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(nodes, centroids left for each, whole): whole nodes with one centroid left, and leaves."""
    at, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(at):
        alive = dominated(low[at], high[at], centroids, alive)
        one = alive.sum(1) == 1
        yield at[one], alive[one], True
        leaf = ~one & (nodes[at, 2] < 0)
        yield at[leaf], alive[leaf], False
        down = ~one & ~leaf
        left = nodes[at[down], 2]
        at, alive = np.concatenate([left, left + 1]), np.concatenate([alive[down], alive[down]])


def exact_nearest(rows: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The nearest of the centroids ``left`` (numbers, ascending) of each row; ties to the smaller number."""
    c = centroids[left]
    # |row|^2 is the same for all, so it can't change which is least
    return left[((c * c).sum(1) - 2 * (rows @ c.T)).argmin(1)]


class Block:
    """A stored block with its tree."""

    def __init__(self, batch: dict, length: int):
        self.rows = np.frombuffer(batch["rows"], "<i4").reshape(-1, length).astype(np.int64)
        self.nodes = np.frombuffer(batch["nodes"], "<i8").reshape(-1, 3)
        self.sums, self.low, self.high = np.frombuffer(batch["figures"], "<i8").reshape(3, -1, length)

    def sums_by_centroid(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for at, alive, one in filtered(self.nodes, self.low, self.high, centroids):
            if one:
                near = alive.argmax(1)
                np.add.at(count, near, self.nodes[at, 1] - self.nodes[at, 0])
                np.add.at(total, near, self.sums[at])
            else:
                for i, left in zip(at, alive, strict=True):
                    rows = self.rows[self.nodes[i, 0] : self.nodes[i, 1]]
                    near = exact_nearest(rows, centroids, np.flatnonzero(left))
                    np.add.at(count, near, 1)
                    np.add.at(total, near, rows)
        return count, total

    def nearest(self, centroids: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.rows), np.int64)
        for at, alive, one in filtered(self.nodes, self.low, self.high, centroids):
            for i, left in zip(at, alive, strict=True):
                span = slice(self.nodes[i, 0], self.nodes[i, 1])
                out[span] = left.argmax() if one else exact_nearest(self.rows[span], centroids, np.flatnonzero(left))
        return out


def kept(vectors: DataFrame, length: int = LENGTH) -> DataFrame:
    fits = is_finite(F.col("embedding")) & (F.size("embedding") == length)
    return vectors.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("whole"))


def starts(rows: DataFrame, length: int, k: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``2:<vec_id>``, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(key.asc_nulls_last(), "whole").limit(k).select("whole").collect()
    return np.array([r[0] for r in first], np.int64).reshape(len(first), length)


def blocks(rows: DataFrame, length: int = LENGTH, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """The stored blocks: ids, rows, nodes and figures."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed_block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = matrix(table["whole"].combine_chunks(), length)
            order, nodes = build_tree(x, leaf)
            x = x[order]
            figures = np.stack(measured(x, nodes))
            ids = table["vec_id"].combine_chunks().take(pa.array(order))
            cells = {"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "rows": [x.astype("<i4").tobytes()], "nodes": [nodes.tobytes()], "figures": [figures.tobytes()]}
            return pa.RecordBatch.from_pydict(cells)

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                while part.num_rows:
                    held.append(part.slice(0, block - n))
                    n += held[-1].num_rows
                    part = part.slice(held[-1].num_rows)
                    if n == block:
                        yield packed_block()
                        held, n = [], 0
        if n:
            yield packed_block()

    return stored(rows.mapInArrow(pack, "ids array<long>, rows binary, nodes binary, figures binary"), "kd-blocks")


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, length = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                c, t = Block(row, length).sums_by_centroid(centroids)
                count += c
                total += t
        place = np.arange(length, dtype=np.int32)
        sums = {"cluster": np.repeat(np.arange(k, dtype=np.int32), length), "place": np.tile(place, k), "n": np.repeat(count, length), "total": total.ravel()}
        yield pa.RecordBatch.from_pydict(sums)

    parts = trees.select("rows", "nodes", "figures").mapInArrow(add, "cluster int, place int, n long, total long")
    # decimals, so that sums beyond 64 bits stay exact
    sums = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in sums:
        if r["n"]:
            out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    length = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row, length)
                near = own.nearest(centroids)
                off = own.rows - centroids[near]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(near.astype(np.int32)), pa.array((off * off).sum(1))], ["vec_id", "cluster", "distance"]
                )

    return trees.mapInArrow(assign, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """The stored assignment of every vector, and the centroids."""
    rows = kept(vectors, length)
    centroids = starts(rows, length, k)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    trees = blocks(rows, length, block, leaf)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    out = stored(assigned(trees, centroids), "clusters")
    discard(trees)
    return out, centroids


def report(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = clusters(vectors, **settings)
    own = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(own.values())
    facts = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in own.items()]
    told = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
