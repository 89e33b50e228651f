import pytest

from massloom.operators import bucketed
from massloom.plans.registry import QUERIES

from test_queries import DATA, plan


def test_merging_searches_shuffles_nothing(spark):
    df = QUERIES["search_merge"](spark, DATA)
    text = plan(df)
    assert "SortMergeJoin" in text or "BroadcastHashJoin" in text
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_merged_candidates(spark):
    rows = [(1, "A", "s1", 5.0), (1, "A", "s2", 7.0), (1, "B", "s1", 7.0), (1, "C", "s3", None), (2, "D", "s2", 1.0), (2, "D", "s2", 1.0)]
    m = bucketed.bucketed(spark.createDataFrame(rows, "scan int, pep string, search string, score double"), ["scan"], 4)
    got = sorted(tuple(r) for r in bucketed.merge_searches(m, ["scan"], "pep", "search", "score", 3).collect())
    assert got == [(1, "A", 7.0, ["s1", "s2"], 1), (1, "B", 7.0, ["s1"], 2), (1, "C", None, ["s3"], 3), (2, "D", 1.0, ["s2"], 1)]
    scans = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "scan int, t string")
    assert sorted((r.scan, r.t) for r in bucketed.with_scan(m, scans, ["scan"]).collect()) == [(1, "x")] * 4 + [(2, "y")] * 2
    with pytest.raises(Exception, match="no scan for"):
        bucketed.with_scan(m, scans.where("scan = 1"), ["scan"]).collect()
