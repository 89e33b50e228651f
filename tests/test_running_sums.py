import random

import pytest
from pyspark.sql import functions as F

from massloom.operators import ranking


@pytest.fixture
def ranges(spark):
    """Small tables stay in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows():
    rng = random.Random(5)
    out = [(c, rng.choice([3.0, rng.uniform(0, 1)]), i, rng.randrange(4)) for i in range(600) for c in [rng.choice("aab")]]
    return [*out, ("a", 1e300, 9001, 1), ("a", -1e300, 9002, 1), ("b", None, 9003, 2), (None, 1.0, 9004, 3), (None, 2.0, 9005, 1)]


@pytest.mark.parametrize("by", [["c"], []])
def test_running_sums(spark, ranges, by):
    df = spark.createDataFrame(rows(), "c string, x double, i int, n long")
    got = {r.i: (r.total, r.rows) for r in ranking.running_sums(df, by, "x", [F.col("i")], {"total": F.col("n"), "rows": F.lit(1)}).collect()}
    want = {}
    for c in ("a", "b", None) if by else (0,):
        total = k = 0
        for r in sorted((r for r in rows() if not by or r[0] == c), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
            total, k = total + r[3], k + 1
            want[r[2]] = (total, k)
    assert got == want


def test_neither_outlier_nor_ties_fill_a_range(spark, ranges):
    df = spark.createDataFrame([("a", 1e300 if i == 0 else 5.0 if i % 2 else 1.0 + i / 9000, i) for i in range(3500)], "c string, x double, i int")
    dealt = ranking.running_sums(df, ["c"], "x", [F.col("i")], {"rows": F.lit(1)})
    sizes = [r["count"] for r in df.repartitionByRange("c", F.desc("x"), "i").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1000 and dealt.agg(F.max("rows")).first()[0] == 3500
    assert ranking.running_sums(df.limit(0), ["c"], "x", [F.col("i")], {"rows": F.lit(1)}).count() == 0
