"""Large groups of texts that are alike but not similar enough."""

import numpy as np
import pyarrow as pa
import pytest

from massloom.llm import components, near_dedup


def test_common_counts(monkeypatch):
    monkeypatch.setattr(near_dedup, "SLAB", 7)
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sides = [[np.unique(np.concatenate((rng.choice(common, int(rng.integers(0, 41)), replace=False), rng.integers(0, 99, int(rng.integers(0, 30)), dtype=np.uint64)))) for _ in range(n)] for n in (30, 50)]
    assert near_dedup.common_counts(*sides).tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    assert near_dedup.common_counts(sides[0], [common[:0]]).tolist() == [[0]] * 30


def test_a_crowded_region_makes_rows_by_document_and_not_by_pair():
    """400 documents alike by sketch, each a component of its own: 79,800 pairs, and one row for each document and block it meets."""
    n = 400
    table = pa.table({"i": [1] * n, "j": [1] * n, "chunk": [1] * n, "id": range(n), "root": range(n), "block": [k // 200 for k in range(n)], "sketch": [bytes(32)] * n})
    rows = near_dedup._compare_chunks(table).to_pylist()
    assert len(rows) == 2 * n and {(r["x"], r["y"]) for r in rows} == {(0, 0), (0, 1), (1, 1)}
    same = table.set_column(4, "root", pa.array([0] * n))
    assert near_dedup._compare_chunks(same).num_rows == 0


@pytest.mark.parametrize("percent", [60, 90])
def test_links_of_blocks_are_a_forest(percent):
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate((np.arange(60), rng.integers(100, 140, 12)))).astype(np.uint64) for _ in range(80)]
    table = pa.table({"x": [0] * 80, "y": [1] * 80, "id": range(80), "block": [k % 2 for k in range(80)], "root": range(80), "shingles": [s.tobytes() for s in sets]})
    found = near_dedup.confirm_block(table, percent)
    links = [(i, j) for i in range(0, 80, 2) for j in range(1, 80, 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
    assert found.num_rows < 80 and links

    def parts(pairs):
        root = list(range(80))
        for _ in range(80):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))) == parts(links)


@pytest.mark.parametrize("limit", [10, 10_000])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "TASK_EDGES", limit)
    rounds = []
    monkeypatch.setattr(components, "stage", lambda df, name, f=components.stage: (rounds.append(name), f(df, name))[1])
    n = 300
    edges = [(i, i + 1) for i in range(n) if i % 50 != 49]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges] + [(7, 7), (None, 3)], "a long, b long").repartition(4)
    roots, _ = components.components(df, "few")
    assert {r.node: r.root for r in roots.collect()} == {i: i // 50 * 50 for i in range(n)}
    assert (rounds == ["few-edges", "few-stars"]) == (limit > n)
