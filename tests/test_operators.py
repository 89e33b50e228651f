import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from massloom.functions import chemistry
from massloom.operators import digest, joins, proteins, quant, ranking, scoring, spectra


def test_digestion_gives_back_the_protein(spark):
    seqs = ["MKAARPKKC", "AAAA", "KRKR", "", "PKPRK"]
    df = spark.createDataFrame(list(enumerate(seqs)), "protein_id long, seq string")
    rows = digest.digest(df, "KR", "ACDEFGHIKLMNQRSTVWY", 0, 1, 99).orderBy("protein_id", "begin").collect()
    for i, s in enumerate(seqs):
        assert "".join(r.peptide for r in rows if r.protein_id == i) == s
    two = digest.digest(df.where("protein_id = 0"), "KR", "ACDEFGHIKLMNQRSTVWY", 2, 1, 99).collect()
    assert {(r.peptide, r.begin, r.missed) for r in two} == {("MK", 0, 0), ("AARPK", 2, 0), ("K", 7, 0), ("C", 8, 0), ("MKAARPK", 0, 1), ("AARPKK", 2, 1), ("KC", 7, 1), ("MKAARPKK", 0, 2), ("AARPKKC", 2, 2)}
    assert {(r.prefix, r.suffix) for r in two if r.peptide == "AARPK"} == {("K", "K")}
    assert {(r.prefix, r.suffix) for r in two if r.peptide == "C"} == {("K", None)}


def test_modifications_and_substitutions(spark):
    assert sorted(digest.modified_forms("MNM", {"~": "M", "!": "N"}, 2)) == sorted([("M~NM", 1), ("MNM~", 1), ("MN!M", 1), ("M~N!M", 2), ("M~NM~", 2), ("MN!M~", 2)])
    df = spark.createDataFrame([("MAM",), ("AAA",), ("",)], "peptide string")
    assert {r.modified for r in digest.single_modifications(df, "~", "M").collect()} == {"M~AM", "MAM~"}
    assert {r.modified for r in digest.modify(df, {"~": "M"}, 2).collect()} == {"M~AM", "MAM~", "M~AM~"}
    assert len(list(digest.substituted_forms("AC", "K", "C", 1))) == 2 * 19
    assert ("K", 1, "K") in set(digest.substituted_forms("AC", "K", "C", 0))


def test_decoys(spark):
    df = spark.createDataFrame([("P1", "MACK")], "protein_id string, seq string")
    assert {(r.protein_id, r.seq, r.is_decoy) for r in digest.with_decoys(df).collect()} == {("P1", "ACK", False), ("Rev_P1", "KCA", True)}
    assert {r.seq for r in digest.split_decoys(df).collect()} == {"MACK", "KCAM"}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=4), st.integers(1, 12))
def test_convolution_keeps_probability(p, n):
    p = np.array(p) / sum(p)
    mass, prob = chemistry.multiply((np.arange(len(p)) * 1.003 + 12, p), n)
    assert math.isclose(prob.sum(), 1) and np.all(np.diff(mass) > 0.9)
    full = p
    for _ in range(n - 1):
        full = np.convolve(full, p)
    kept = full[full >= 1e-6]
    assert len(prob) <= len(full) and abs(prob.max() - full.max() / kept.sum()) < 1e-3


def test_chemistry_scalars(spark):
    assert chemistry.ln_combinations(5, 2, chemistry.ln_factorials(5)) == pytest.approx(math.log(10))
    assert chemistry.ln_combinations(2, 5, chemistry.ln_factorials(5)) == -1
    assert chemistry.error_score(np.array([0.0]), 0.02)[0] == 1
    assert chemistry.most_abundant((np.array([12.0, 13.0]), np.array([0.9, 0.1]))) == 12
    assert chemistry.average_mass((np.array([12.0, 13.0]), np.array([0.9, 0.1]))) == pytest.approx(12.1)
    water = chemistry.compound({"H": 2, "O": 1}, {"H": (np.array([1.0]), np.array([1.0])), "O": (np.array([16.0]), np.array([1.0]))})
    assert water[0][0] == pytest.approx(18)
    r = spark.range(1).select(chemistry.folded_difference(F.lit(1.1)).alias("a"), chemistry.folded_remainder(F.lit(-1.1)).alias("b"), chemistry.neutral_mass(F.lit(500.0), F.lit(2)).alias("m"), chemistry.deduction(F.lit(0.5), 0.005, 4.0).alias("d")).first()
    assert r.a == pytest.approx(1.1 - 1.00867108694132) and r.b == pytest.approx(1.1 - 1.003355) and r.m == pytest.approx(1000 - 2 * 1.007276466) and r.d == pytest.approx(-0.005)


def test_binned_join_is_the_range_join(spark):
    rng = np.random.default_rng(5)
    points, centres = rng.uniform(-50, 50, 300), rng.uniform(-50, 50, 40)
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate(points)], "i long, x double")
    c = spark.createDataFrame([(i, float(x)) for i, x in enumerate(centres)], "j long, y double")
    exact = {(i, j) for i, x in enumerate(points) for j, y in enumerate(centres) if y - 2.5 <= x <= y + 0.5}
    for salt in (1, 3):
        got = [(r.i, r.j) for r in joins.range_join(p, c, "x", F.col("y") - 2.5, F.col("y") + 0.5, 1.0, salt).collect()]
        assert len(got) == len(set(got)) and set(got) == exact
    windows = joins.merged_windows([-1, 0, 1], 0.6)
    assert windows == [(-1.6, 1.6)]


def test_cutoff_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(z), round(float(s), 2), bool(d), i) for i, (z, s, d) in enumerate(zip(rng.integers(1, 4, 400), rng.normal(0, 1, 400), rng.random(400) < 0.3, strict=True))]
    df = spark.createDataFrame(rows, "z int, score double, decoy boolean, i int")
    got = {r.z: r.cutoff for r in ranking.decoy_cutoff(df, ["z"], "score", ~F.col("decoy"), F.col("decoy"), 0.35, [F.col("i")]).collect()}
    for z in (1, 2, 3):
        t = d = 0
        cutoff = None
        for _, s, decoy, _ in sorted((r for r in rows if r[0] == z), key=lambda r: (-r[1], r[3])):
            d, t = d + decoy, t + (not decoy)
            if t and d <= 0.35 * t:
                cutoff = s
        assert got.get(z) == cutoff


def test_refine_and_grid(spark):
    df = spark.createDataFrame([(5.0, False), (4.0, False), (3.0, True), (2.0, False), (1.0, True)], "score double, decoy boolean")
    assert sorted(r.score for r in ranking.refine_by_maximum(df, "score", F.col("decoy"), 0.25, []).collect()) == [2.0, 3.0, 4.0, 5.0]
    got = ranking.grid_cutoff(df.withColumn("z", F.lit(1)), ["z"], "score", F.col("decoy"), 0.3, steps=30).first()
    assert (got.n_rows, got.n_decoys) == (4, 1)


def test_inference(spark):
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 2), (4, 9)], "protein long, peptide long")
    assert {(r.protein_group, r.n_peptides) for r in proteins.indistinguishable_groups(e).collect()} == {("{1,3}", 2), ("2", 2), ("4", 1)}
    assert {r.protein for r in proteins.parsimonious(e, 1, 1).collect()} == {2, 4}
    none = e.where("false").select("protein")
    cover = {r.protein for r in proteins.greedy_cover(e, none, 1).collect()}
    assert 4 in cover and 1 in cover and 3 not in cover and 2 not in cover
    named = e.select(F.concat(F.lit("P"), "protein").alias("protein"), "peptide")
    assert {r.protein for r in proteins.greedy_cover(named, named.select("protein").limit(0), 1).collect()} == {"P1", "P4"}
    assert {r.protein for r in proteins.greedy_cover(named, named.where("protein = 'P2'").select("protein"), 1).collect()} == {"P2", "P4"}
    assert proteins.greedy_cover(named.limit(0), named.select("protein").limit(0), 1).count() == 0
    assert proteins.cluster_levels([1, 1, 2, 10, 11, 30], 3) == [0, 0, 0, 1, 1, 2]
    levels = spark.createDataFrame([(1, float(x)) for x in (1, 1, 2, 10, 11, 30)], "owner long, level double")
    got = {(r.cluster, r.n, round(r.mean_level, 3), round(r.sd_level, 3)) for r in proteins.enrichment_clusters(levels, 3.0).collect()}
    assert got == {(0, 3, 1.333, 0.577), (1, 2, 10.5, 0.707), (2, 1, 30.0, 0.0)}


def test_sites_and_coverage(spark):
    seq = spark.createDataFrame([("P", "AAMKAAMKC")], "protein_id string, seq string")
    pep = spark.createDataFrame([("P", "AAM~K", 3, 9.0), ("P", "AAMK", 2, 5.0)], "protein_id string, peptide string, spectra long, score double")
    rows = {r.position: r for r in quant.site_table(pep, seq, "~!").collect()}
    assert set(rows) == {3, 7}
    r = rows[3]
    assert (r.residue, r.ptm, r.modified_peptides, r.modified_spectra, r.unmodified_peptides, r.unmodified_spectra, r.best_score, r.before, r.after) == ("M", "~", 1, 3, 1, 2, 9.0, "AA", "KAAMKC")
    places = quant.occurrences(seq.withColumn("peptide", F.lit("AAMK")), "seq", "peptide").select("protein_id", "start", F.length("peptide").alias("length"), F.length("seq").alias("protein_length"))
    assert quant.coverage(places).first().covered == 8


def test_impurity(spark):
    m = np.array([[0.9, 0.1], [0.05, 0.95]])
    x = np.array([10.0, 20.0])
    y = m.T @ x
    r = spark.createDataFrame([tuple(map(float, y))], "a double, b double").select(*(c.alias(f"c{i}") for i, c in enumerate(quant.impurity_corrected([F.col("a"), F.col("b")], m)))).first()
    assert (r.c0, r.c1) == (pytest.approx(10), pytest.approx(20))


def test_scores_prefer_the_right_peptide(spark):
    b, y = scoring.ion_masses("ACDEFGHIK")
    mz = np.sort(np.concatenate((b, y)) + scoring.PROTON)
    inten = np.linspace(1, 2, len(mz))
    row = {"scan": 1, "charge": 2, "neutral_mass": 2000.0, "mz": mz.tolist(), "inten": inten.tolist()}
    df = spark.createDataFrame([row | {"peptide": p} for p in ("ACDEFGHIK", "KIHGFEDCA", "WWWWWWWW")], "scan long, charge int, neutral_mass double, mz array<double>, inten array<double>, peptide string")
    got = {r.peptide: r for r in scoring.score_pairs(df, 50.0, 2000.0).collect()}
    for s in ("mvh", "xcorr", "wdp"):
        assert got["ACDEFGHIK"][s] > got["KIHGFEDCA"][s] >= got["WWWWWWWW"][s] - 1
    assert got["ACDEFGHIK"].wdp == pytest.approx(2 * 16, rel=1e-3)


def test_labels(spark):
    df = spark.createDataFrame([(["Rev1_A", "Rev1_B"],), (["Rev2_A", "Rev1_B"],), (["Rev2_A", "C"],), (["Z_A"],)], "names array<string>")
    assert [r.x for r in df.select(ranking.label_of(F.col("names"), "Z_", "Rev1_", "Rev2_").alias("x")).collect()] == [2, 3, 1, 4]


def test_levels_and_charges(spark):
    levels = {r.level: r for r in spectra.enrichment_levels(spark).collect()}
    assert levels[1].search_name == "C13_1070Pct" and levels[50].heavy == 0.5 and len(levels) == 101
    assert {r.level: r for r in spectra.enrichment_levels(spark, "N", "15").collect()}[0].search_name == "N15_368Pct"
    df = spark.createDataFrame([(0, [1.0, 2.0], 3.0), (None, [1.0, 9.0], 3.0), (4, [1.0], 0.0)], "z int, mz array<double>, parent double")
    assert [r.c for r in df.select(spectra.possible_charges(F.col("z"), F.col("mz"), F.col("parent")).alias("c")).collect()] == [[1], [2, 3], [4]]
    assert spark.range(1).select(spectra.pct_of(F.lit("C13_50000Pct"))).first()[0] == 50


def test_substring_search(spark):
    p = spark.createDataFrame([("A", "MAAKCCCCCCCK"), ("B", "KKK")], "protein_id string, seq string")
    q = spark.createDataFrame([("CCCCCCCK",), ("AAK",), ("KK",), ("WWWWWWWW",)], "peptide string")
    assert {(r.protein_id, r.peptide) for r in joins.peptides_in_proteins(p, q).collect()} == {("A", "CCCCCCCK"), ("A", "AAK"), ("B", "KK")}
