"""Distributions of peptides of several kinds from one pass, without a join."""

import pytest

from massloom.operators import isotopes
from massloom.plans import envelope_queries

from test_queries import plan

PEPTIDES = ["PEPTIDEK", "KEDITPEP", "MCMCWWSS", "GGGGGGGG", "DEEDLKRH" * 6, "", "A*Z", *("ACDEFGHIK"[i:] + "ACDEFGHIK"[:i] for i in range(9))]


@pytest.mark.parametrize("size", ["10000", "3"])
def test_columns_are_those_of_single_distributions(spark, size):
    labelled = isotopes.enriched("C", 0.5)
    df = spark.createDataFrame([(p,) for p in [*PEPTIDES, None]], "peptide string")
    wanted = {f"{n}_{c}": (i, c) for n, i in (("plain", isotopes.ISOTOPES), ("labelled", labelled)) for c in isotopes.COLUMNS}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r.peptide: r for r in isotopes.peptide_columns(df, wanted, batch=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(PEPTIDES)
    for name, kinds in (("plain", isotopes.ISOTOPES), ("labelled", labelled)):
        for r in isotopes.peptide_distributions(df.dropna(), kinds).collect():
            g = {c: got[r.peptide][f"{name}_{c}"] for c in isotopes.COLUMNS}
            assert g["peaks"] == len(r.share) == len(g["share"]) == len(g["mass"])
            assert g["share"] == pytest.approx(r.share, abs=1e-12) and g["mass"] == pytest.approx(r.mass, abs=1e-8)
            assert [g[c] for c in ("lowest_mass", "most_abundant_mass", "average_mass")] == pytest.approx([r.lowest_mass, r.most_abundant_mass, r.average_mass], abs=1e-8)
    assert isotopes.peptide_columns(df.limit(0), wanted).count() == 0


def test_no_join_and_no_counting_of_letters_by_replacing(spark):
    text = plan(envelope_queries.peptide_envelopes(spark, "/root/testdata/sf0.001"))
    assert "Join" not in text and "replace(peptide" not in text
