"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.staging import release, stage

#: Edges up to which one task joins all (some 50 MB there).
TASK_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest of its component, for the components of the given edges alone."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    member = root != np.arange(len(nodes))
    return nodes[member], nodes[root[member]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if held:
        a, b = (np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1))
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """Smallest reachable node of every node of `edges` (long columns a, b): columns node, root.

    Every partition's edges are first replaced by a forest of their own, without a shuffle.
    Once at most TASK_EDGES are left, one task makes stars of them; a round for them costs more than all their work.
    Until then large-star and small-star steps alternate, each one aggregation by node (combined
    before the shuffle) and one join, until the edges are stars; every round is written to
    the shared folder, which cuts the lineage. Nodes without edges are absent; null ends
    and self-loops are ignored. Also returns the staged paths still in use.
    """
    spark = edges.sparkSession
    clean = edges.where(F.col("a") != F.col("b")).select("a", "b")
    now, path = stage(clean.mapInArrow(_contract, "a long, b long"), f"{name}-edges")
    while True:
        if now.count() <= TASK_EDGES:
            stars, stars_path = stage(now.coalesce(1).mapInArrow(_contract, "a long, b long"), f"{name}-stars")
            release(spark, path)
            now, path = stars, stars_path
            break
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        # the forest of each task's part of the large star stands for it; equal edges meet in the aggregation below
        large, large_path = stage(large.mapInArrow(_contract, "a long, b long"), f"{name}-large")
        smallest = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(smallest, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = small.unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b"))
        after, after_path = stage(linked.distinct(), f"{name}-edges")
        release(spark, path, large_path)
        now, path = after, after_path
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), [path]


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one root, and no root at another."""
    rows, members = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return rows == members and edges.join(edges.select(F.col("b").alias("r")).distinct(), F.col("a") == F.col("r"), "left_semi").isEmpty()
