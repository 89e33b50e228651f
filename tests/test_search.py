"""Envelopes, isotope distributions, interval joins, inference and low-resolution scores against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import chemistry
from massloom.operators import envelopes, inference, isotopes, lowres, scoring, sweep

from test_queries import plan


def walk(peaks, mz, share, tolerance, charge):
    """One ion by plain loops: (tallest peak, weight, error, isotope peaks) or None."""
    top = max(range(len(share)), key=lambda i: (share[i], -i))
    near = [p for p in peaks if abs(p[0] - mz[top]) <= tolerance]
    if not near:
        return None
    tallest = max(near, key=lambda p: (p[1], -p[0]))
    shift, seen = tallest[0] - mz[top], {top: tallest[0] - mz[top]}
    for way in (1, -1):
        i = top + way
        while 0 <= i < len(share):
            hits = [p for p in peaks if mz[i] + shift - tolerance / 2 <= p[0] <= mz[i] + shift + tolerance / 2]
            if not hits:
                break
            rel = share[i] / share[top]
            for p in hits:
                if rel * 0.5 < p[1] / tallest[1] < min(rel * 5, 1.5):
                    seen[i] = p[0] - mz[i]
                    break
            i += way
    weight = 1.0
    if len(share) > 1:
        second = max((i for i in range(len(share)) if i != top), key=lambda i: (share[i], -i))
        weight = 2.0 if second in seen else 0.5 if share[second] / share[top] > 0.5 else 1.0
    if tallest[2] not in (0, charge):
        weight /= 2
    rel = {i: share[i] / share[top] for i in seen}
    return tallest, weight, sum(seen[i] * rel[i] for i in seen) / sum(rel.values()), len(seen)


def test_envelopes_equal_a_plain_walk(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        peaks = sorted({(float(round(m, 3)), float(round(i, 2)), int(z)) for m, i, z in zip(rng.uniform(100, 130, k * 3), rng.uniform(1, 50, k * 3), rng.integers(0, 3, k * 3), strict=True)})
        ions = []
        for _ in range(int(rng.integers(0, 12))):
            n, z = int(rng.integers(1, 6)), int(rng.integers(1, 3))
            start = float(rng.uniform(95, 130))
            ions.append((z, [start + 1.003 / z * i for i in range(n)], [float(x) for x in rng.dirichlet(np.ones(n))]))
        rows.append((k, peaks, ions))
    df = spark.createDataFrame(rows + [(98, None, rows[3][2]), (99, rows[5][1], None)], "id int, peaks array<struct<mz:double,inten:double,charge:int>>, ions array<struct<charge:int,mz:array<double>,share:array<double>>>")
    got = {r.id: r.found for r in envelopes.match_envelopes(df, 0.6).collect()}
    assert got[98] == [] and got[99] == []
    hits = 0
    for k, peaks, ions in rows:
        want = [(i, w) for i, (z, mz, share) in enumerate(ions) if (w := walk(peaks, mz, share, 0.6, z)) is not None]
        assert [f.ion for f in got[k]] == [i for i, _ in want]
        for f, (_, (tallest, weight, error, n)) in zip(got[k], want, strict=True):
            assert peaks[f.place][:2] == tallest[:2] and (f.weight, f.n_peaks) == (weight, n)
            assert math.isclose(f.error, error, abs_tol=1e-9)
            hits += n > 1
    assert hits > 20


def test_errors_are_recentred(spark):
    df = spark.createDataFrame([([(0, 0, 1.0, 0.5, 1), (1, 0, 1.0, 0.1, 1)],), ([],)], "found array<struct<ion:int,place:int,weight:double,error:double,n_peaks:int>>")
    got = [r[0] for r in df.select(envelopes.recentred(F.col("found"))).collect()]
    assert got[0] == pytest.approx([0.2, -0.2]) and got[1] == []


def test_distributions_equal_convolving_atom_by_atom(spark):
    peptides = ["PEPTIDEK", "MCMCWWSS", "GGGGGGGG", "DEEDLKRH" * 6]
    df = spark.createDataFrame([(p, i) for i, p in enumerate([*peptides, "KEDITPEP", None])], "peptide string, i int")
    rows = {r.i: r for r in isotopes.peptide_distributions(df).collect()}
    assert len(rows) == 6 and rows[5].mass is None
    assert rows[4].mass == rows[0].mass and rows[4].share == rows[0].share
    for i, p in enumerate(peptides):
        counts = dict(zip(isotopes.ELEMENTS, (sum(isotopes.RESIDUE_ATOMS[c][k] for c in p) + isotopes.END_ATOMS[k] for k in range(6)), strict=True))
        full = np.ones(1)
        for e, n in counts.items():
            for _ in range(n):
                full = np.convolve(full, isotopes.ISOTOPES[e][1])
        got = np.array(rows[i].share)
        assert abs(got.sum() - 1) < 1e-9 and np.abs(got - full[: len(got)]).max() < 2e-5
        assert rows[i].lowest_mass == pytest.approx(sum(n * isotopes.ISOTOPES[e][0][0] for e, n in counts.items()), abs=1e-6)
        average = sum(n * float(np.dot(*isotopes.ISOTOPES[e])) for e, n in counts.items())
        assert rows[i].average_mass == pytest.approx(average, abs=2e-2)
        one = chemistry.compound(counts, {e: (np.array(m), np.array(s)) for e, (m, s) in isotopes.ISOTOPES.items()})
        assert np.abs(one[1][: len(got)] - got[: len(one[1])]).max() < 1e-6 and rows[i].most_abundant_mass == pytest.approx(chemistry.most_abundant(one), abs=1e-6)


def test_negative_counts_and_labels(spark):
    mass, share = isotopes.multiply_rows(isotopes.ISOTOPES["H"], np.array([-1, 0, 2]))
    assert mass[0, 0] == pytest.approx(-1.007825) and mass[1, 0] == 0 and mass[2, 0] == pytest.approx(2.01565)
    assert np.allclose(share.sum(1), 1)
    labelled = isotopes.enriched("C", 0.5)
    assert labelled["C"][1] == (0.5, 0.5) and isotopes.enriched("S", 1.0)["S"][1] == (0.0, 1.0, 0.0, 0.0)
    df = spark.createDataFrame([((0, 0),)], "composition struct<C:int,H:int>")
    assert isotopes.distributions(df).first().mass == [0.0]
    assert isotopes.distributions(df.limit(0)).count() == 0


def test_each_composition_is_convolved_once(spark):
    df = spark.createDataFrame([("PEPTIDEK",), ("KEDITPEP",), ("PEPTIDEK",)], "peptide string")
    named = df.select(isotopes.composition(F.col("peptide")).alias("composition"))
    assert isotopes.distributions(named).count() == 1


def test_interval_join_of_all_widths(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([rng.uniform(-50, 50), 7.0])) for i in range(300)] + [(1000, None), (1001, float("nan"))]
    ranges = [(i, low, low + rng.choice([0, 0.001, 0.3, 5, 40, 90])) for i in range(200) for low in [rng.choice([rng.uniform(-60, 50), 7.0])]] + [(500, 3.0, 2.0), (501, None, 1.0), (502, 1.0, float("nan"))]
    p = spark.createDataFrame(points, "p int, x double")
    r = spark.createDataFrame(ranges, "r int, a double, b double")
    want = sorted((i, j) for i, x in points if x is not None for j, a, b in ranges if a is not None and a <= x <= b)
    for kw in ({}, {"widths": [0.01, 1.0, 64.0]}, {"widths": [2.0], "salt": 3}):
        got = sweep.interval_join(p, r, "x", F.col("a"), F.col("b"), **kw)
        assert sorted((q.p, q.r) for q in got.collect()) == want
        assert "NestedLoop" not in plan(got)
    assert sweep.interval_join(p, r.limit(0), "x", F.col("a"), F.col("b")).count() == 0


def test_no_range_is_copied_to_more_than_two_bins(spark):
    r = spark.createDataFrame([(i, float(i), i + w) for i in range(50) for w in (0.001, 1.0, 999.0, 70000.0)], "r int, a double, b double")
    widths = sweep.bin_widths(r, F.col("a"), F.col("b"))
    assert max(widths) >= 70000 and len(widths) <= 4
    w = F.element_at(F.filter(F.lit(widths), lambda w: w >= F.col("b") - F.col("a")), 1)
    assert r.select((F.floor(F.col("b") / w) - F.floor(F.col("a") / w) + 1).alias("n")).agg(F.max("n")).first()[0] <= 2


def test_sweep_windows(spark):
    # 50 % is searched from 13 neutrons below to 3 above, as separate windows if the tolerance is small
    rows = [r for r in sweep.level_windows() if r[0] == 50]
    assert [round((a + b) / 2 / chemistry.NEUTRON) for _, a, b in rows] == list(range(-13, 4))
    assert [(level, len([1 for r in sweep.level_windows() if r[0] == level])) for level in (0, 1, 100)] == [(0, 5), (1, 5), (100, 5)]
    assert len(sweep.level_windows(tolerance=0.6)) == 101
    each = sweep.at_each_level(spark.range(2), [(3, -0.5, 0.5), (4, 1.0, 2.0)])
    assert sorted(map(tuple, each.collect())) == [(0, 3, -0.5, 0.5), (0, 4, 1.0, 2.0), (1, 3, -0.5, 0.5), (1, 4, 1.0, 2.0)]
    configs = spark.createDataFrame([("a", [1, 0, 5, 0], 0.6), ("b", [2], 0.01), ("c", None, 0.1), ("d", [1], None)], "search_name string, windows array<int>, tolerance double")
    got = sorted((r.search_name, round(r.low, 6), round(r.high, 6)) for r in sweep.windows_of_configs(configs).collect())
    assert got == [("a", -0.6, 1.603355), ("a", 4.416775, 5.616775), ("b", 1.99671, 2.01671)]


def infer(edges, least_peptides, least_unique):
    held, by = {}, {}
    for p, q in edges:
        held.setdefault(p, set()).add(q)
        by.setdefault(q, set()).add(p)
    alone = {p: sum(len(by[q]) == 1 for q in s) for p, s in held.items()}
    chosen = {p for p in held if len(held[p]) >= least_peptides and alone[p] >= max(least_unique, 1)}
    rest = {p for p in held if p not in chosen and not any(held[p] <= held[c] for c in chosen)}
    out = dict.fromkeys(chosen, 1)
    while rest:
        best = min(rest, key=lambda p: (-len(held[p]), p))
        if len(held[best]) < least_peptides or alone[best] < least_unique:
            break
        out[best] = 2
        rest = {p for p in rest if not held[p] & held[best]}
    return sorted(out.items())


@pytest.mark.parametrize(("least_peptides", "least_unique", "task_edges"), [(1, 0, 10**6), (2, 0, 12), (3, 0, 1), (1, 1, 50), (1, 2, 50)])
def test_inference(spark, least_peptides, least_unique, task_edges):
    rng = random.Random(least_peptides)
    edges = sorted({(rng.randrange(40), rng.randrange(60)) for _ in range(110)})
    df = spark.createDataFrame(edges, "protein long, peptide long")
    got = sorted(map(tuple, inference.infer_proteins(df, least_peptides, least_unique, task_edges).collect()))
    assert got == infer(edges, least_peptides, least_unique)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    # each protein shares a peptide with the next smaller one and holds no peptide alone
    edges = [(i, p) for i in range(30) for p in [f"s{i}", f"s{i + 1}", *(f"x{i}-{k}" for k in range(40 - i))]]
    edges += [(1000 + i, p) for i, p in edges if p.startswith("x")]
    rounds = []
    solved = inference.connected_components
    monkeypatch.setattr(inference, "connected_components", lambda df, *a: rounds.append(1) or solved(df, *a))
    df = spark.createDataFrame(edges, "protein long, peptide string")
    got = sorted(map(tuple, inference.largest_first(df, 700).collect()))
    held = {}
    for p, q in edges:
        held.setdefault(p, set()).add(q)
    want, used = [], set()
    for p in sorted(held, key=lambda p: (-len(held[p]), p)):
        if not held[p] & used:
            want.append((p,))
            used |= held[p]
    assert got == sorted(want) and len(want) > 10
    assert len(rounds) <= 5


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(70)] + [(900, 900), (None, 1), (2, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, inference.connected_components(df).collect())) == sorted((x, find(x)) for x in parent)
    assert inference.connected_components(df.limit(0)).count() == 0


def low_score(peptide, charge, peaks, tolerance):
    """The state machine, ion by ion."""
    m = [scoring.RESIDUE_MASS[c] for c in peptide]
    basic = [5 if c in "RHK" else 3 if c in "QN" else 1 for c in peptide]

    def found(at):
        near = [p for p in peaks if abs(p[0] - at) <= tolerance]
        if not near:
            return 0.0
        p = max(near, key=lambda p: (p[1], -p[0]))
        return math.erfc(abs(p[0] - at) / (tolerance / 2 * math.sqrt(2))) + p[1]

    score, last, reward = 0.0, [0.0, 0.0], [0, 0]
    for n in range(len(m) - 1):
        masses = [sum(m[len(m) - n - 1 :]) + scoring.WATER, sum(m[: len(m) - n - 1])]
        now = [found(x + chemistry.PROTON) for x in masses]
        if charge >= 3:
            side = 0 if sum(basic[: n + 1]) * 2 > sum(basic) else 1
            now[side] += found((masses[side] + 2 * chemistry.PROTON) / 2)
        both = min(now) > 1e-8
        score += sum(now) * (2 if both else 1)
        for k in (0, 1):
            follows = last[k] > 1e-8
            if follows:
                score += now[k] + (last[k] if reward[k] < 3 else 0)
            reward[k] = (3 if follows else 2) if both else (2 if follows else 0)
        last = now
    return score


def test_weight_sum(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, p in enumerate(["PEPTIDEK", "RAGQNHK", "GG", "K", "WWAAKRHQNDEM"] * 3):
        b, y = scoring.ion_masses(p)
        hits = [float(x) for x in np.concatenate((b, y)) + 1.0073 + rng.normal(0, 0.2, 2 * len(b)) if rng.random() < 0.6]
        rows.append((p, 1 + i % 4, sorted(zip(hits + rng.uniform(100, 900, 20).tolist(), rng.uniform(0.1, 1, len(hits) + 20).tolist(), strict=True))))
    df = spark.createDataFrame(rows, "peptide string, charge int, peaks array<struct<mz:double,inten:double>>")
    scored = df.select("*", lowres.weight_sum(F.col("peptide"), F.col("charge"), F.col("peaks"), 0.5).alias("score"))
    assert "Python" not in plan(scored) and "Pandas" not in plan(scored)
    for r in scored.collect():
        assert r.score == pytest.approx(low_score(r.peptide, r.charge, [tuple(p) for p in r.peaks], 0.5), abs=1e-9)
    empty = spark.createDataFrame([("", 1, []), (None, 1, []), ("PEK", 1, [])], df.schema)
    assert [r[0] for r in empty.select(lowres.weight_sum(F.col("peptide"), F.col("charge"), F.col("peaks"), 0.5)).collect()] == [0.0, None, 0.0]


def test_scaled_peaks(spark):
    rng = np.random.default_rng(8)
    peaks = sorted((float(m), float(i)) for m, i in zip(rng.uniform(100, 400, 120), rng.uniform(1, 9, 120), strict=True))
    df = spark.createDataFrame([(peaks,), ([],)], "peaks array<struct<mz:double,inten:double>>")
    most = max(i for _, i in peaks)
    bins = {}
    for m, i in peaks:
        bins[int(m)] = max(bins.get(int(m), 0), i / most * 100)
    want = []
    for m, i in peaks:
        near = sorted((bins.get(k, 0.0) for k in range(int(m) - 50, int(m) + 50)), reverse=True)
        if i / most * 100 >= near[6]:
            want.append((m, i / most * 100 / near[0]))
    got, none = (r[0] for r in df.select(lowres.scaled_peaks(F.col("peaks"), 7)).collect())
    assert none == [] and [g.mz for g in got] == [m for m, _ in want]
    assert [g.inten for g in got] == pytest.approx([i for _, i in want])


def test_error_score_column(spark):
    errors = [0.0, 1e-4, 0.003, -0.0099, 0.01, -0.02]
    df = spark.createDataFrame([(e,) for e in errors], "e double").select(chemistry.error_score_column(F.col("e"), 0.02))
    assert [r[0] for r in df.collect()] == pytest.approx(list(chemistry.error_score(np.array(errors), 0.02)), abs=1e-14)
