"""Rescoring: the spectra of linked proteins without the whole graph, and features made once."""

from pyspark.sql import functions as F

from massloom.operators import proteins
from massloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_peptide_spectra_are_those_of_linked_features(spark):
    rows = [(1, 0, 10), (1, 1, 10), (1, 1, 11), (2, 0, 11), (2, 0, 11), (3, 0, 12), (3, 0, 12), (4, 2, 10), (None, 0, 10), (5, 0, None), (5, 0, 13), (6, 0, None)]
    psms = spark.createDataFrame(rows, "pep int, form int, protein int")
    whole = proteins.linked_features(psms, "pep", "form", "protein").select("pep", "peptide_spectra", (F.col("linked_unique") + F.col("linked_shared")).alias("s")).distinct()
    assert sorted(map(tuple, proteins.peptide_spectra(psms, "pep", "protein").select("pep", "peptide_spectra", "linked_spectra").collect())) == sorted(map(tuple, whole.collect()))


def test_features_are_made_once(spark):
    text = QUERIES["rescore_matches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Exchange" not in text
