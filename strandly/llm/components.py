"""Connected components of a graph of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare


#: Most edges whose components one task finds.
FEW = 1_000_000


class Sets:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        if j < i:
            i, j = j, i
        self.parent[j] = i
        return True


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) with the components of the given edges."""
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = Sets(len(names))
    for i, j in zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True):
        sets.join(i, j)
    roots = np.array([sets.root(i) for i in range(len(names))], np.int64)
    other = roots != np.arange(len(names))
    return names[other], names[roots[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars."""
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of all of a task's edges."""
    given = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if given:
        a, b = forest(*(np.concatenate([g[i] for g in given]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b): of each vertex that is not the smallest of its component, that smallest one.

    Edges (a, b) in any order, repeated or with a = b; none give none. Batches are contracted on the
    map side; at most `few` edges are then one task's work (16 bytes each). Of more,
    alternating large and small stars run until nothing changes, each cut by a checkpoint.
    A vertex with very many edges is one key of joins that are split at runtime; none of its
    edges are gathered."""
    prepare(edges.sparkSession)
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut(e.mapInArrow(_contract, "a long, b long").distinct())
    if e.limit(few + 1).count() <= few:
        return cut(e.coalesce(1).mapInArrow(_whole, "a long, b long"))
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now[0] == 0 or now == before:
            return e
        before = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        large = large.mapInArrow(_contract, "a long, b long").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
