from pyspark.sql import functions as F

from massloom.operators import quant, ranking


def test_decoys_go_by_name(spark):
    df = spark.createDataFrame([("P1,Rev_2", 1), ("P1", 2), (None, 3), ("xRev2_", 4), ("", 5)], "names string, i int")
    assert sorted(r.i for r in ranking.without_decoys(df, "names", ["Rev_", "Rev2_"]).collect()) == [2, 3, 5]
    assert ranking.without_decoys(df, "names", []).count() == 5


def test_a_match_of_a_group_comes_once(spark):
    m = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("f", 2, "b"), ("g", 1, "c")], "file string, scan int, protein string")
    g = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("c", 2), ("d", 2)], "protein string, grp int")
    assert sorted(map(tuple, quant.matches_of_groups(m, g, "protein", "grp", ["file", "scan"]).collect())) == [(1, "f", 1), (1, "f", 2), (2, "g", 1)]


def test_isomers_by_mass(spark):
    rows = [("s", "PEM~TM", "PEMTM", 1, 500.0, 9.0), ("s", "PEMTM~", "PEMTM", 1, 500.00001, 6.0), ("s", "PEMTM!", "PEMTM", 1, 501.0, 8.0), ("s", "PEM~T", "PEMT", 1, 500.0, 7.0), ("t", "AK", "AK", 0, 1.0, 2.0), ("u", "AK~", "AK", 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "scan string, identified string, original string, ptms int, mass double, x double")
    by_mass = {r.scan: r.delta_p for r in ranking.localisation(df, ["scan"], ["x"], "original", "identified", "ptms", [F.col("identified")], mass="mass").collect()}
    assert by_mass == {"s": (9 - 6) / 9, "t": None, "u": 1.0}
    by_number = {r.scan: r.delta_p for r in ranking.localisation(df, ["scan"], ["x"], "original", "identified", "ptms", [F.col("identified")]).collect()}
    assert by_number["s"] == (9 - 8) / 9


def test_labels_by_file(spark):
    df = spark.createDataFrame([("f", "P", "a", 10.0), ("f", "P", "b", 1.0), ("f", "P", "b", 30.0), ("f", "Q", "a", None), ("g", "P", "c", 2.0)], "file string, protein string, peptide string, level double")
    got = {r.file: (r.psms, r.labelled_psms, r.proteins, r.labelled_proteins, r.peptides, r.labelled_peptides) for r in quant.labelled_by_file(df, "file", "protein", "peptide", "level", 5.0).collect()}
    assert got == {"f": (4, 2, 2, 1, 2, 2), "g": (1, 0, 1, 0, 1, 0)}
