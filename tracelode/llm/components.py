"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


EDGES = 1_000_000  # of which a task makes one forest


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) that are not the smallest of their component, and that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[rest], ids[label[rest]]


def _contract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of each million edges or so of a partition."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        both = np.concatenate(held)
        held.clear()
        u, v = roots(both[:, 0], both[:, 1])
        return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    for part in parts:
        held.append(np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], 1))
        if sum(map(len, held)) > EDGES:
            yield out()
    if held:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u long, v long) edges in any order and direction -> (node, component): the smallest node reachable.

    Nodes without an edge to another node, and smallest nodes themselves, have no row. No edges: no rows.
    Only forests of local edges are shuffled; minima are combined before each shuffle.
    """
    links = stored(edges.where("u != v").select("u", "v"), "links")  # written, so that no task needs two Python workers at once
    parts = max(1, -(-links.count() // EDGES))  # as many edges in a task as it holds at once, so that forests leave as little as they can
    forests = links.coalesce(parts).mapInArrow(_contract, "u long, v long")
    if parts == 1:  # one forest of all edges: each node has its smallest already
        return stored(forests.select(F.col("u").alias("node"), F.col("v").alias("component")), "edges")
    e = stored(forests.distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that the joins below are between two plain shuffles, and nodes with very many edges are split
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = stored(both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # every remaining edge points to a smaller node
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stored(small.distinct(), "edges")
