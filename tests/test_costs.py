"""How much some queries move."""

import re

from massloom.plans import report_queries

from test_queries import plan


def test_members_text_is_not_copied_to_members(spark, tmp_path):
    """The text of a group's members is in no join by its members, whose size would be the square of a group."""
    rows = [("A", 1, 1, 7, p, float(p), 1.0, 0.0, 0.0, "1995-01-01") for p in range(50)] + [("A", 2, 1, 8, 3, 2.0, 1.0, 0.0, 0.0, "1995-01-01")]
    names = "l_returnflag string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_shipdate string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = report_queries.group_members_join(spark, str(tmp_path))
    found = {r.pep: (r.members, r.best, r.n_psms) for r in out.collect()}
    assert found == {7: ("{" + ",".join(map(str, range(50))) + "}", 49.0, 50), 8: ("{3}", 2.0, 1)}
    assert not re.search(r"Join.*\[pep#\d+L?, protein#\d+L?\][^\n]*members", plan(out))
    joined = [n for n in plan(out).splitlines() if "Generate" in n and "members" in n]
    assert joined and all("[pep#" in n for n in joined) and not any(re.search(r"Generate explode.*\[pep#\d+L?, members#\d+\]", n) for n in joined)
