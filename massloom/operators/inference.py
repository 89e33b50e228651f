"""Protein inference by connected components: small ones are solved whole in a task, large ones in slices and rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.work import dropped, written

#: Edges of a component, or of a slice of one, that are solved in one task (some tens of MB there).
TASK_EDGES = 200_000
#: How many times smaller the edges left must become in a round for another without components.
FALLING = 2
#: Rounds in which components of a block are solved together before what is left is taken one protein at a time.
TOGETHER = 40


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of edges (columns a, b of one orderable type) with the smallest node of their component: node, component.

    Every round gives each node's larger neighbours to its smallest neighbour, then its smaller ones, so that the
    rounds grow with the logarithm of the longest path. Smallest neighbours are
    aggregated before they are shuffled; the edges of a hub may be split among tasks by the adaptive skew join.
    Edges from a node to itself make it a component; edges with a null end are left out.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes, nodes_path = written(both.select(F.col("u").alias("node")).unionByName(both.select(F.col("v").alias("node"))).distinct(), "components-nodes")
    now, path = written(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = signature(now)
    while last[0]:
        # larger neighbours of each node go to the least of its neighbours and itself
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # then the smaller ones, and the node itself
        large = large.where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        following, following_path = written(small, "components")
        dropped(spark, path)
        now, path = following, following_path
        following_signature = signature(now)
        if following_signature == last:
            break
        last = following_signature
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out, _ = written(nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node")), "components-found")
    dropped(spark, path, nodes_path)
    return out


def protein_counts(edges: DataFrame) -> DataFrame:
    """Peptides, unique ones and the rarest peptide (with the proteins that hold it) of each protein of edges (protein, peptide), distinct: protein, size, unique, rarest."""
    degree = edges.groupBy("peptide").agg(F.count("*").alias("degree"))
    counts = edges.join(degree, "peptide").groupBy("protein").agg(F.count("*").alias("size"), F.count(F.when(F.col("degree") == 1, 1)).alias("unique"), F.min(F.struct("degree", "peptide")).alias("rarest"))
    return written(counts, "inference-counts")[0]


def phase_one(edges: DataFrame, least_peptides: int, least_unique: int, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(proteins chosen for enough peptides and unique ones; those whose peptides a chosen one holds all) of edges (protein, peptide), distinct.

    A protein is compared only with the chosen holders of its rarest peptide. counts: protein_counts of edges, if at hand.
    """
    counts = protein_counts(edges) if counts is None else counts
    chosen = counts.where((F.col("size") >= least_peptides) & (F.col("unique") >= max(least_unique, 1))).select("protein")
    others = counts.join(chosen, "protein", "left_anti").select("protein", "size", F.col("rarest.peptide").alias("peptide"))
    held = edges.join(chosen, "protein", "left_semi")
    pairs = others.join(held.withColumnRenamed("protein", "by"), "peptide").select("protein", "by", "size")
    shared = pairs.join(edges, "protein").join(held.withColumnRenamed("protein", "by"), ["by", "peptide"]).groupBy("protein", "by", "size").agg(F.count("*").alias("n"))
    return chosen, shared.where("n = size").select("protein").distinct()


def solve(group: pd.DataFrame) -> pd.DataFrame:
    """Proteins taken one at a time, largest first (ties: smallest), each unless it shares a peptide with one taken."""
    used: set = set()
    taken = []
    for _, protein, peptides in sorted(((-len(g), p, g["peptide"].tolist()) for p, g in group.groupby("protein", sort=False)), key=lambda r: r[:2]):
        if used.isdisjoint(peptides):
            taken.append(protein)
            used.update(peptides)
    return pd.DataFrame({"protein": taken})


def solve_block(protein: np.ndarray, peptide: np.ndarray) -> np.ndarray:
    """solve of many components at once: the proteins taken. Each round takes all that come before every one they share a peptide with."""
    names, protein = np.unique(protein, return_inverse=True)
    _, peptide = np.unique(peptide, return_inverse=True)
    size = np.bincount(protein, minlength=len(names))
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((np.arange(len(names)), -size))] = np.arange(len(names))
    taken = np.zeros(len(names), bool)
    for _ in range(TOGETHER):
        if not len(protein):
            return names[taken]
        first = np.full(peptide.max() + 1, len(names))
        np.minimum.at(first, peptide, rank[protein])
        behind = np.bincount(protein, first[peptide] < rank[protein], len(names))
        top = np.zeros(len(names), bool)
        top[protein] = behind[protein] == 0
        taken |= top
        used = np.zeros(len(first), bool)
        used[peptide[top[protein]]] = True
        gone = np.zeros(len(names), bool)
        gone[protein[used[peptide]]] = True
        protein, peptide = protein[~gone[protein]], peptide[~gone[protein]]
    rest = solve(pd.DataFrame({"protein": protein, "peptide": peptide}))["protein"].to_numpy().astype(np.int64)
    taken[rest] = True
    return names[taken]


def solve_components(edges: DataFrame, block: int = TASK_EDGES) -> DataFrame:
    """Proteins that solve takes of each component of edges (component, protein, peptide): small components are solved some hundred thousand edges at a time."""
    kind = edges.schema["protein"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def solved(table: pa.Table) -> pa.RecordBatch:
            protein = table.column("protein").combine_chunks()
            # by their places in order, so that any kind of id will do
            ids = protein.dictionary_encode()
            codes = pc.rank(ids.dictionary, tiebreaker="dense").to_numpy().astype(np.int64)
            peptides = table.column("peptide").combine_chunks().dictionary_encode().indices.to_numpy()
            taken = solve_block(codes[ids.indices.to_numpy()], peptides)
            return pa.RecordBatch.from_arrays([ids.dictionary.filter(pa.array(np.isin(codes, taken)))], ["protein"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= block:
                table = pa.concat_tables(held).combine_chunks()
                component = table.column("component").chunk(0)
                # the last component may go on in the next batch
                end = pc.index(component, component[len(component) - 1]).as_py()
                if end:
                    yield solved(table.slice(0, end))
                held, rows = [table.slice(end)], len(table) - end
        if rows:
            yield solved(pa.concat_tables(held))

    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = edges.select("component", "protein", "peptide").repartition(tasks, "component").sortWithinPartitions("component")
    return sorted_.mapInArrow(run, f"protein {kind}")


def largest_first(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Proteins that remain if the largest is taken again and again and all that share a peptide with it go (ties: smallest id first).

    edges: protein, peptide, distinct. Each round takes all proteins that are larger than every one they share with,
    which in whatever order gives the same. Once that no longer makes the rest much smaller, components of at most task_edges
    edges are solved at once, and of a larger one the slice of its largest proteins that fits a task besides;
    what is left may have fallen apart and begins anew. So neither a component nor the longest
    chain of proteins bounds a task or the number of rounds alone.
    """
    spark = edges.sparkSession
    sizes = edges.groupBy("protein").agg(F.count("*").alias("size"))
    # a protein goes with all of its edges, so sizes stay
    left, left_path = written(edges.join(sizes, "protein").select("protein", "peptide", "size"), "inference-left")
    taken: list[DataFrame] = []
    before, n = 0, left.count()
    while n:
        best = left.groupBy("peptide").agg(F.min(F.struct((-F.col("size")).alias("size"), "protein")).alias("best"))
        now = left.join(best, "peptide").groupBy("protein").agg(F.min((F.col("best.protein") == F.col("protein")).cast("int")).alias("top")).where("top = 1").select("protein")
        whole, placed_path = False, None
        # components cost many rounds, so they wait until taking tops alone no longer makes the rest much smaller
        if before and n * FALLING > before:
            least = left.groupBy("peptide").agg(F.min("protein").alias("first"))
            roots = connected_components(left.join(least, "peptide").select(F.col("protein").alias("a"), F.col("first").alias("b")).distinct())
            proteins = left.select("protein", "size").distinct()
            placed, placed_path = written(proteins.join(roots, proteins["protein"] == roots["node"]).drop("node"), "inference-placed")
            # edges of the proteins down to each size, by component: the slice is what fits a task
            by_size = placed.groupBy("component", "size").agg(F.sum("size").alias("edges"))
            order = Window.partitionBy("component").orderBy(F.desc("size"))
            fits = by_size.withColumn("edges", F.sum("edges").over(order)).where(F.col("edges") <= task_edges).groupBy("component").agg(F.min("size").alias("down_to"))
            inside = placed.join(fits, "component").where(F.col("size") >= F.col("down_to")).select("protein", "component")
            solved = solve_components(left.join(inside, "protein"))
            whole = placed.groupBy("component").agg(F.sum("size").alias("edges")).where(F.col("edges") > task_edges).isEmpty()
            now = solved if whole else solved.unionByName(now).distinct()
        now, _ = written(now, "inference-taken")
        taken.append(now)
        if placed_path:
            dropped(spark, placed_path)
        if whole:
            break
        used = left.join(now, "protein", "left_semi").select("peptide").distinct()
        gone = left.join(used, "peptide", "left_semi").select("protein").distinct()
        following, following_path = written(left.join(gone, "protein", "left_anti"), "inference-left")
        dropped(spark, left_path)
        left, left_path = following, following_path
        before, n = n, left.count()
    dropped(spark, left_path)
    out = edges.select("protein").limit(0)
    for df in taken:
        out = out.unionByName(df)
    return out


def infer_proteins(edges: DataFrame, least_peptides: int = 1, least_unique: int = 1, task_edges: int = TASK_EDGES, counts: DataFrame | None = None) -> DataFrame:
    """Proteins of edges (protein, peptide, distinct; ids orderable) that explain the peptides: protein, phase.

    Phase 1 takes all with at least least_peptides peptides, of them least_unique (1 at least) that no
    other holds. Those whose peptides a chosen one holds all are out. With least_unique of 0,
    phase 2 takes from the rest, of least_peptides or more, the largest first, and drops all
    that share a peptide with it; with 1 or more none of the rest has enough unique peptides, so it ends there.
    counts: protein_counts of edges, if at hand.
    """
    chosen, covered = phase_one(edges, least_peptides, least_unique, counts)
    first = chosen.withColumn("phase", F.lit(1))
    if least_unique >= 1:
        return first
    rest = edges.join(chosen, "protein", "left_anti").join(covered, "protein", "left_anti")
    enough = rest.groupBy("protein").agg(F.count("*").alias("n")).where(F.col("n") >= least_peptides).select("protein")
    return first.unionByName(largest_first(rest.join(enough, "protein", "left_semi"), task_edges).withColumn("phase", F.lit(2)))
