"""Connected components of an edge table: joined in parts within tasks, then by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import in_arrow, staged

#: Edges that a task joins at a time. A table has as many parts as that takes.
PART_EDGES = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, and that one."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def in_parts(edges: DataFrame, rows: int, most: int) -> DataFrame:
    """The same components by fewer edges: of rows edges, each part of at most most becomes a forest of stars."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n + part.num_rows > most:
                    yield stars(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield stars(held)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        u, v = forest(table["u"].to_numpy(), table["v"].to_numpy())
        return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return in_arrow(edges.coalesce(max(1, -(-rows // most))), join, "u long, v long")


def settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no u has two v's or is the v of another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return not ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 OR n = 1 AND least = 0").limit(1).count()


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """edges has columns a and b; the result has a row (node, component) for each node, component being the
    smallest node that it can reach.

    First each part of at most PART_EDGES edges is joined within a task; a table of one part is then settled. Each round joins every
    node with its smallest neighbour, so that no list of neighbours is ever held by one task; Spark may split the join at a hot node. The
    edge table shrinks to stars, which end the rounds. Every round is written to the shared folder.
    """
    given = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), name)
    rows = given.count()
    now = staged(in_parts(given, rows, PART_EDGES), f"{name}-parts")
    done = rows <= PART_EDGES
    for _ in range(rounds):
        done = done or settled(now)
        if done:
            break
        # large star: the larger neighbours of u are hung on the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, f"{name}-large")
        # small star: u and its smaller neighbours are hung on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-small")
    else:
        raise RuntimeError(f"{name}: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
