"""Range joins shuffle both sides: what is copied to bins or levels is never broadcast, however small its files are."""

import pytest
from pyspark.sql import functions as F

from massloom.operators import joins, sweep
from massloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sweep_range_join", "multi_window_range_join", "precursor_range_join", "all_peaks_join"])
def test_copies_to_bins_are_not_broadcast(spark, name):
    assert "Broadcast" not in final_plan(QUERIES[name](spark, DATA))


def test_interval_join_is_not_broadcast(spark):
    points = spark.range(50).select((F.col("id") * 1.0).alias("x"))
    ranges = spark.createDataFrame([(1.0, 3.0), (5.0, 30.0)], "a double, b double")
    assert "Broadcast" not in final_plan(sweep.interval_join(points, ranges, "x", F.col("a"), F.col("b")))


def test_level_join_is_the_join_of_all_windows(spark):
    points = spark.createDataFrame([(i, x) for i, x in enumerate([99.0, 100.5, 101.0, 102.0, 103.0, 103.0, 107.5, None, float("nan"), -5.0])], "i int, x double")
    peptides = spark.createDataFrame([("p", 100.0), ("q", 103.0), ("q", 103.0), ("n", None), ("m", float("nan"))], "p string, mass double")
    windows = [(0, -1.0, 1.0), (1, 0.5, 2.0), (1, 4.0, 4.5), (2, 3.0, 3.0)]
    got = sweep.level_join(points, peptides, "x", "mass", windows).select("i", "p", "level")
    plain = sweep.interval_join(points, sweep.at_each_level(peptides, windows), "x", F.col("mass") + F.col("low"), F.col("mass") + F.col("high")).select("i", "p", "level")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.count() > 10
    # a peptide is moved once, not once for each level
    assert joins.range_join(points, peptides, "x", F.col("mass") - 1.0, F.col("mass") + 4.5, 5.5).count() <= 3 * points.count()
