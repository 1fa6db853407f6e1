"""Exact search for pairs of fingerprints within a few bits, by vantage-point trees.

A node splits fingerprints by their Hamming distance to a vantage point: at most mu goes left, more
goes right. By the triangle bound a fingerprint at distance d has neighbours within r on the left only
if d <= mu + r, and on the right only if d >= mu + 1 - r. So a fingerprint has one home leaf and
visits those leaves that the bound does not rule out; of a pair that a node parts, only the right
one visits. A tree of a bounded sample deals fingerprints to shards; inside a shard a tree of all its
fingerprints goes down to leaves, where pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, rounds

SAMPLE = 16_384
SHARD = 50_000
LEAST = 16_384  # points of a shard for the sake of parallelism
LEAF = 256
_ROWS, _COLUMNS = 256, 4096


@dataclass
class Node:
    point: np.uint64
    mu: int
    left: Node | int
    right: Node | int


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 8, of: int = 2048) -> tuple[np.uint64, int] | None:
    """A vantage point and mu with little mass within the radius of the boundary and a quarter of the
    points at least on either side if that can be had; None if no try parts the points."""
    some = points if len(points) <= of else rng.choice(points, of, replace=False)
    best = None
    for v in rng.choice(points, min(tries, len(points)), replace=False):
        n = np.bincount(distance(some, v), minlength=66 + radius)
        below = np.cumsum(n)
        for mu in np.flatnonzero((below[:-1] > 0) & (below[:-1] < len(some))).tolist():
            left = below[mu] / len(some)
            near = (below[min(mu + radius, len(below) - 1)] - below[max(mu - radius, -1)] * (mu >= radius)) / len(some)
            cost = near + 4 * max(0.0, 0.25 - min(left, 1 - left))
            if best is None or cost < best[0]:
                best = (cost, v, mu)
    return best and best[1:]


def grow(points: np.ndarray, leaves: int, radius: int, seed: int = 0) -> Node | int:
    """A tree with about so many leaves, numbered from 0."""
    rng = np.random.default_rng(seed)
    count = [0]

    def down(points: np.ndarray, leaves: int) -> Node | int:
        at = split(points, radius, rng) if leaves > 1 and len(points) > 1 else None
        if at is None:
            count[0] += 1
            return count[0] - 1
        near = distance(points, at[0]) <= at[1]
        share = max(1, min(leaves - 1, round(leaves * near.mean())))
        return Node(at[0], at[1], down(points[near], share), down(points[~near], leaves - share))

    return down(points, leaves)


def route(tree: Node | int, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, points at home there, points that visit it), leaf by leaf."""
    todo = [(tree, points, points[:0])]
    while todo:
        node, home, visit = todo.pop()
        if not len(home) and not len(visit):
            continue
        if not isinstance(node, Node):
            yield node, home, visit
            continue
        d, dv = distance(home, node.point), distance(visit, node.point)
        far = d > node.mu
        todo.append((node.right, home[far], visit[dv >= node.mu + 1 - radius]))
        todo.append((node.left, home[~far], np.concatenate([visit[dv <= node.mu + radius], home[far & (d <= node.mu + radius)]])))


class Union:
    """Union-find over numbers from 0, the least number of a set as its root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while True:
            up = self.root[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            pairs = np.unique(np.maximum(a, b) << 32 | np.minimum(a, b))
            # of each larger root the least smaller one; what is left over comes again
            a, b = pairs & 0xFFFFFFFF, pairs >> 32
            high, first = np.unique(b, return_index=True)
            self.root[high] = a[first]


def linked(home: np.ndarray, visit: np.ndarray, radius: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each point that has a neighbour within the radius (at home, or visiting and at home), with the
    least point of those it is connected to here. Points are distinct; the pairs of dense groups are
    compared in blocks and only joined, never listed."""
    points = np.unique(np.concatenate([home, visit]))
    union, rng = Union(len(points)), np.random.default_rng(seed)
    todo = [(home, visit)]
    while todo:
        h, v = todo.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        at = split(h, radius, rng) if len(h) > LEAF else None
        if at is not None:
            parts = list(route(Node(at[0], at[1], 0, 1), np.concatenate([h]), radius))
            d = distance(v, at[0])
            seen = {0: v[d <= at[1] + radius], 1: v[d >= at[1] + 1 - radius]}
            todo += [(own, np.concatenate([more, seen[leaf]])) for leaf, own, more in parts if len(own)]
            continue
        hi = np.searchsorted(points, h)
        both = np.concatenate([h, v])
        bi = np.searchsorted(points, both)
        for r in range(0, len(h), _ROWS):
            for c in range(0, len(both), _COLUMNS):
                if c + _COLUMNS <= r:
                    continue  # pairs at home count once
                near = distance(h[r : r + _ROWS, None], both[None, c : c + _COLUMNS]) <= radius
                i, j = np.nonzero(near)
                i, j = hi[r + i], bi[c + j]
                union.join(i[i != j], j[i != j])
    root = union.find(np.arange(len(points)))
    size = np.bincount(root, minlength=len(points))
    more = size[root] > 1
    return points[more], points[root[more]]


def links(fingerprints: DataFrame, radius: int = 2, column: str = "fp", sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) of longs that connect all fingerprints within the radius of each other: of each
    group that a shard finds, every member to its least one.

    The column holds distinct longs, no nulls; no rows give no edges. The top tree is grown from at
    most `sample` fingerprints (those of least hash), one shard for each `shard` fingerprints, or fewer
    of them if the cluster has tasks to spare; it decides where pairs meet, not whether. Each shard is
    the task of its number."""
    spark = fingerprints.sparkSession
    fingerprints = fingerprints.select(F.col(column).alias("fp"))
    n = fingerprints.count()
    shards = max(1, -(-n // shard), min(n_partitions(spark), n // LEAST))
    drawn = np.array([r[0] for r in fingerprints.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64) if shards > 1 else np.zeros(0, np.uint64)
    tree = grow(drawn, shards, radius) if shards > 1 else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for leaf, home, visit in route(tree, points, radius):
                both = np.concatenate([home, visit]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), leaf, np.int32)), pa.array(both), pa.array(np.arange(len(both)) < len(home))], ["shard", "fp", "home"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in rounds(batches, "shard"):
            whole = pa.Table.from_batches(held)
            points, home = whole.column("fp").to_numpy().view(np.uint64), whole.column("home").to_numpy()
            a, b = linked(points[home], points[~home], radius)
            apart = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[apart].view(np.int64)), pa.array(b[apart].view(np.int64))], ["a", "b"])

    dealt = fingerprints.mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.repartitionById(shards, F.col("shard")).mapInArrow(search, "a long, b long")
