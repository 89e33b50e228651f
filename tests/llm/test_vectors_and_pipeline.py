import math

import numpy as np

import corpus_pipeline
from massloom.llm import embedding_dedup
from massloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute(ids, vectors, threshold):
    ok = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], float), np.array(vectors[j], float)
                linked[i, j] = linked[j, i] = (x @ y) / math.sqrt((x @ x) * (y @ y)) >= threshold
    label = list(ids)
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))]) for i in range(n)]
        if new == label:
            return {i: (int(linked[k].sum()), label[k], label[k] == i) for k, i in enumerate(ids)}
        label = new


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [None, [], [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] * 8, [3.0, 4.0], [6.0, 8.0], [1e-30] * 8]
    for _ in range(12):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 25))):
            vectors.append((centre + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.4])).tolist())
    copy = rng.normal(size=8).astype(np.float32).astype(float).tolist()
    vectors += [copy] * 40 + [[x * 2 for x in copy]] * 3
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, n long, id long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df, 0.95).collect()}
    assert got == brute(ids, vectors, 0.95)
    assert embedding_dedup.near_duplicate_vectors(df.where("false"), 0.95).count() == 0


def test_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PIVOTS", 16)
    rng = np.random.default_rng(3)
    vectors = [(c + rng.normal(size=8) * s).tolist() for c in rng.normal(size=(9, 8)) for s in (0.001, 0.02, 0.2) for _ in range(7)]
    vectors += [[1e200, 0.0], [1e200, 0.0], [3e-200, 1e-210], [0.0, 5e-324], [1.0, 1.0]]
    ids = rng.permutation(len(vectors)).tolist()
    usual = [[x / max(map(abs, v)) for x in v] for v in vectors]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df, 0.95).collect()}
    assert got == brute(ids, usual, 0.95)


def test_any_number_of_lengths_and_repeated_ids(spark):
    rows = [(n, [1.0] * (1 + n // 2)) for n in range(2400)] + [(7, [1.0] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df, 0.95).collect() if r.vec_id is not None)
    assert got == sorted([(n, 2 if n in (6, 7) else 1, n - n % 2) for n in range(2400)] + [(7, 2, 6)])


def test_tree_levels_are_nested():
    rng = np.random.default_rng(2)
    x = embedding_dedup.units(np.concatenate([rng.normal(size=(40, 6)), rng.normal(size=6) + rng.normal(size=(60, 6)) * 0.05]))
    order, starts = embedding_dedup.cover_levels(x)
    assert sorted(order.tolist()) == list(range(100))
    for radius, s, e in zip(embedding_dedup.LEVELS, starts, [np.append(s[1:], 100) for s in starts], strict=True):
        for a, b in zip(s, e, strict=True):
            assert (np.linalg.norm(x[order[a:b]] - x[order[a]], axis=1) <= radius + 1e-9).all()
    assert set(starts[0]) <= set(starts[1]) <= set(starts[2])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, DATA)
        assert out.columns == columns, name
        docs = out.persist()
        after = docs.count()
        assert 0 < after <= before, name
        before = after
    pieces = corpus_pipeline.packing(spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_every_operator_has_a_query(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
