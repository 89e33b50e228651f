import pytest
from pyspark.sql import functions as F

from massloom.sources import match_files
from massloom.sources.match_files import MatchFiles, ReportWriter, read_matches, statistics, write_report

WIDE = ["Filename", "ScanNumber", "ParentCharge", "MeasuredParentMass", "CalculatedParentMass", "ScanType", "SearchName", "ScoringFunction", "Rank", "Score", "IdentifiedPeptide", "OriginalPeptide", "ProteinNames"]
NARROW = [c for c in WIDE if c not in ("ScanType", "OriginalPeptide")]


def line(names, i):
    values = {"Filename": f"f{i % 3}.FT2", "ScanNumber": i, "ParentCharge": 2, "MeasuredParentMass": 1000 + i / 8, "CalculatedParentMass": 999.5, "ScanType": "HCD", "SearchName": "C13_50000Pct", "ScoringFunction": "WeightSum", "Rank": 1, "Score": i / 4, "IdentifiedPeptide": f"[PEP{i}K]", "OriginalPeptide": f"[PEP{i}K]", "ProteinNames": "{A,B}"}
    return "\t".join(str(values[n]) for n in names)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.sip").write_text("#\tconfig\n#\n" + "\n".join(["\t".join(WIDE), *(line(WIDE, i) for i in range(50))]) + "\n")
    (tmp_path / "b.sip").write_text("\n".join(["\t".join(NARROW), *(line(NARROW, i) for i in range(50, 90)), "", "short\tx"]))
    (tmp_path / "c.txt").write_text("other\n")
    return str(tmp_path)


@pytest.mark.parametrize("step", [37, 400, 1 << 26])
def test_both_widths(spark, folder, step):
    df = read_matches(spark, folder, ".sip", range_bytes=step)
    assert df.columns == [*WIDE, "source"] and dict(df.dtypes)["ScanNumber"] == "bigint" and dict(df.dtypes)["Score"] == "double"
    rows = {r.ScanNumber: r for r in df.collect()}
    assert set(rows) == {None, *range(90)}
    assert rows[7].MeasuredParentMass == 1000.875 and rows[7].OriginalPeptide == "[PEP7K]" and rows[7].source == "a.sip"
    assert rows[60].OriginalPeptide is None and rows[60].ProteinNames == "{A,B}" and rows[60].source == "b.sip"
    assert rows[None].Filename == "short" and rows[None].ParentCharge is None


def test_a_file_filter_is_pushed(spark, folder):
    df = read_matches(spark, folder, ".sip").where("source = 'b.sip' and Score > 16")
    assert sorted(r.ScanNumber for r in df.collect()) == list(range(65, 90))
    assert df.rdd.getNumPartitions() == 1
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert "PushedFilters: [EqualTo(source,b.sip)]" in df._jdf.queryExecution().explainString(mode)
    assert read_matches(spark, folder, ".sip").where("source in ('a.sip', 'x')").count() == 50
    assert read_matches(spark, folder, ".sip").where("source = 'none'").count() == 0


def test_chromatogram_tables(spark, tmp_path):
    (tmp_path / "p.txt").write_text("made by x\nXIC_filename\tidentifier\tpeakHeight\tIDs\nx1\t1\t12.5\tf.7.2,g.8.3\n\nx2\t2\tbad\t\n")
    rows = read_matches(spark, f"file://{tmp_path}/p.txt", skip=1, range_bytes=11).orderBy("XIC_filename").collect()
    assert [(r.XIC_filename, r.identifier, r.peakHeight, r.IDs) for r in rows] == [("x1", "1", 12.5, "f.7.2,g.8.3"), ("x2", "2", None, None)]


def test_a_report_is_one_in_order(spark, tmp_path):
    out = str(tmp_path / "report")
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("ScanNumber"), F.concat(F.lit("p"), F.col("id") % 5).alias("IdentifiedPeptide"), F.when(F.col("id") > 3, F.col("id") / 2).alias("Score"))
    write_report(df, out, ["ScanNumber"], statistics(df, F.col("ScanNumber") % 10 != 0), parts=4)
    parts = sorted((tmp_path / "report").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert len(parts) == 4 and (tmp_path / "report/_SUCCESS").exists() and not (tmp_path / "report/_temporary").exists()
    assert lines[:5] == ["#\t[Statistical_Results]", "#\tTargets = 900", "#\tDecoys = 100", "#\tFDR = 0.111111", "ScanNumber\tIdentifiedPeptide\tScore"]
    assert [int(x.split("\t")[0]) for x in lines[5:]] == list(range(1000))
    with pytest.raises(Exception, match="not empty"):
        write_report(df, out, ["ScanNumber"])
    write_report(df.limit(0), out, ["ScanNumber"], mode="overwrite")
    assert [x for p in (tmp_path / "report").glob("part-*") for x in p.read_text().splitlines()] == ["ScanNumber\tIdentifiedPeptide\tScore"]


def test_a_written_report_is_read_again(spark, tmp_path, folder):
    df = read_matches(spark, folder, ".sip")
    (tmp_path / "again").mkdir()
    write_report(df.drop("source"), str(tmp_path / "again"), ["ScanNumber", "Filename"], ["x"], parts=1)
    back = read_matches(spark, str(tmp_path / "again"), ".txt").drop("source")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.drop("source").collect()), key=repr)


def test_attempts_that_fail_leave_nothing(tmp_path, spark):
    schema = spark.createDataFrame([], "a int, b string").schema
    out = tmp_path / "out"

    def rows(n, fail=False):
        for i in range(n):
            yield (i, "x")
        if fail:
            raise RuntimeError("lost")

    first, second = (ReportWriter(schema, {"path": str(out), "partition": p, "head": "h"}) for p in (0, 1))
    second.job = first.job
    with pytest.raises(RuntimeError):
        first.write(rows(3, fail=True))
    messages = [first.write(rows(3)), second.write(rows(2))]
    first.write(rows(3))  # an attempt that Spark doesn't choose
    first.commit(messages)
    assert sorted(p.name for p in out.iterdir()) == ["_SUCCESS", "part-00000.txt", "part-00001.txt"]
    assert (out / "part-00000.txt").read_text() == "#\th\na\tb\n0\tx\n1\tx\n2\tx\n" and (out / "part-00001.txt").read_text() == "0\tx\n1\tx\n"
    third = ReportWriter(schema, {"path": str(tmp_path / "gone")})
    third.abort([third.write(rows(2)), None])
    assert list((tmp_path / "gone").iterdir()) == []


def test_names_and_types(tmp_path):
    (tmp_path / "x").write_text("")
    assert match_files._header(str(tmp_path / "x"), 0) == [] and MatchFiles({"path": str(tmp_path / "x")}).schema().names == ["source"]
