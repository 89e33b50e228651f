"""Inference without a Python group for each component, and without components where they aren't needed."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from massloom.operators import inference
from massloom.plans import protein_queries


def graph(rng, components, proteins, peptides):
    return sorted({(c * 100 + rng.randrange(proteins), c * 1000 + rng.randrange(peptides)) for c in range(components) for _ in range(2 * proteins)})


def test_a_block_is_solved_as_its_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = pd.DataFrame(graph(rng, 60, 12, 30), columns=["protein", "peptide"])
    want = sorted(p for _, g in edges.groupby(edges["protein"] // 100) for p in inference.solve(g)["protein"])
    for rounds in (0, 1, 40):
        monkeypatch.setattr(inference, "TOGETHER", rounds)
        assert sorted(inference.solve_block(edges["protein"].to_numpy(), edges["peptide"].to_numpy()).tolist()) == want
    # a chain, each end of which comes before the next
    chain = pd.DataFrame([(i, k) for i in range(300) for k in (i, i + 1)], columns=["protein", "peptide"])
    assert inference.solve_block(chain["protein"].to_numpy(), chain["peptide"].to_numpy()).tolist() == list(range(0, 300, 2))
    assert len(inference.solve_block(np.array([], np.int64), np.array([], np.int64))) == 0
    # text ids, and components that lie in several batches and blocks
    df = spark.createDataFrame([(f"c{p // 100}", f"p{p:05d}", f"q{q}") for p, q in edges.itertuples(index=False)], "component string, protein string, peptide string")
    for block in (1, 50, 1 << 20):
        assert sorted(r.protein for r in inference.solve_components(df, block).collect()) == [f"p{p:05d}" for p in want]


def test_tops_need_no_components(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame(graph(rng, 20, 10, 40), "protein long, peptide long")
    want = sorted(r.protein for r in inference.largest_first(edges).collect())
    solved = edges.toPandas()
    assert want == sorted(inference.solve(solved)["protein"])

    def never(*_):
        raise AssertionError("components")

    monkeypatch.setattr(inference, "connected_components", never)
    monkeypatch.setattr(inference, "FALLING", 0)
    assert sorted(r.protein for r in inference.largest_first(edges).collect()) == want


def test_the_graph_is_counted_once(spark, monkeypatch, tmp_path):
    spark.range(400).select((F.col("id") * 7).alias("l_orderkey"), (F.col("id") * 13 % 50).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = []
    counts = inference.protein_counts
    monkeypatch.setattr(inference, "protein_counts", lambda edges: made.append(edges) or counts(edges))
    assert protein_queries.inference_by_component(spark, str(tmp_path)).count() > 0
    assert len(made) == 1
