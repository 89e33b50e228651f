import base64
import struct
import zlib

from pyspark.sql import functions as F

from massloom.sources import config, spectra, tables

FT2 = "H\tx\ty\nS\t1\t1\t500.25\nZ\t2\t999.5\nI\tScanType\tFT-MS2@HCD\nI\tRetentionTime\t12.5\n100.5 10\n200.25 20 0 0 0 1\n\nS\t2\t2\t600.5\n150.1\t5\nS\t3\t3\t700\nZ\t3\nS\t40\t40\t800.125\nZ\t0\n300 1 0 0 0 2\n100 4\n"


def peaks(r):
    return [tuple(p) for p in r.peaks]


def test_ft2_round_trip(spark, tmp_path):
    (tmp_path / "a.FT2").write_text(FT2)
    read = spectra.read_ft2(spark, str(tmp_path / "a.FT2"))
    rows = {r.scan: r for r in read.collect()}
    assert set(rows) == {1, 2, 40}
    assert (rows[1].charge, rows[1].parent_mz, rows[1].scan_type, rows[1].rtime) == (2, 500.25, "FT-MS2@HCD", "12.5")
    assert peaks(rows[1]) == [(100.5, 10.0, 0), (200.25, 20.0, 1)]
    assert rows[2].charge is None and rows[40].charge is None and peaks(rows[40]) == [(300.0, 1.0, 2), (100.0, 4.0, 0)]
    spectra.write_ft2(read, str(tmp_path / "out"))
    again = {r.scan: r for r in spectra.read_ft2(spark, str(tmp_path / "out")).collect()}
    assert {k: (r.charge, r.parent_mz, r.scan_type, r.rtime, peaks(r)) for k, r in again.items()} == {k: (r.charge, r.parent_mz, r.scan_type, r.rtime, peaks(r)) for k, r in rows.items()}


def test_fasta(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">P1 first # one\nMKA\nRX*K\n>P2\n>P3 third\tx\nACDE\n")
    read = tables.read_fasta(spark, str(tmp_path / "p.fasta"))
    assert {tuple(r) for r in read.collect()} == {("P1", "first # one", "MKARK"), ("P3", "third\tx", "ACDE")}
    assert {tuple(r) for r in tables.needed_descriptions(read, read.where("protein_id <> 'P2'")).collect()} == {("P1", "first $ one"), ("P3", "third x")}
    tables.write_fasta(read, str(tmp_path / "out"))
    assert {(r.protein_id, r.seq) for r in tables.read_fasta(spark, str(tmp_path / "out")).collect()} == {("P1", "MKARK"), ("P3", "ACDE")}


def test_mzml_and_mgf(spark, tmp_path):
    mz = base64.b64encode(struct.pack("<2d", 100.5, 200.25)).decode()
    inten = base64.b64encode(zlib.compress(struct.pack("<2f", 1.5, 2.5))).decode()

    def param(n, v=""):
        return f'<cvParam accession="MS:{n}" name="x" value="{v}"/>'

    one = f"<scanList count='1'><scan>{param(1000016, 3.5)}</scan></scanList><precursorList count='1'><precursor><selectedIonList count='1'><selectedIon>{param(1000744, 500.5)}{param(1000041, 2)}</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList count='2'><binaryDataArray>{param(1000523)}{param(1000514)}<binary>{mz}</binary></binaryDataArray><binaryDataArray>{param(1000521)}{param(1000574)}{param(1000515)}<binary>{inten}</binary></binaryDataArray></binaryDataArrayList>"
    (tmp_path / "m.mzML").write_text(f"<mzML><run><spectrumList count='2'><spectrum index='0' id='scan=7'>{param(1000511, 2)}{one}</spectrum><spectrum index='1' id='scan=8'>{param(1000511, 1)}</spectrum></spectrumList></run></mzML>")
    (r,) = spectra.read_mzml(spark, str(tmp_path / "m.mzML")).collect()
    assert (r.scan, r.charge, r.parent_mz, r.rtime, peaks(r)) == (7, 2, 500.5, "3.5", [(100.5, 1.5, 0), (200.25, 2.5, 0)])
    (tmp_path / "x.mgf").write_text("BEGIN IONS\nTITLE=a\nSCANS=5\nPEPMASS=400.5 12\nCHARGE=2+\n100.1 3\n200.2 4 2+\nEND IONS\nBEGIN IONS\nSCANS=6\nPEPMASS=1\nEND IONS\n")
    (r,) = spectra.read_mgf(spark, str(tmp_path / "x.mgf")).collect()
    assert (r.scan, r.charge, r.parent_mz, peaks(r)) == (5, 2, 400.5, [(100.1, 3.0, 0), (200.2, 4.0, 2)])


def test_hierarchical(spark, tmp_path):
    (tmp_path / "h.txt").write_text("# c\n+\tFilename\tScan\tZ\tM\tT\tN\tR\n*\tIdentified\tOriginal\tMass\tA\tB\tC\tP\n+\tf.FT2\t7\t2\t999.5\tHCD\tC13_50000Pct\t1.5\n*\t[PEP~K]\t[PEPK]\t999.4\t10\t2\t3\t{A,B,A}\n*\t[AAK]\t[AAK]\t999.3\t5\t1\t2\t{C}\n+\tf.FT2\t8\t3\t888\tHCD\tX\t2\n*\t[K]\t[K]\t1\t1\t1\t1\t{D}\n")
    c = tables.candidates(tables.read_hierarchical(spark, str(tmp_path / "h.txt")))
    assert {(r.scan, r.identified, r.mvh, tuple(r.proteins)) for r in c.collect()} == {(7, "[PEP~K]", 10.0, ("A", "B")), (7, "[AAK]", 5.0, ("C",)), (8, "[K]", 1.0, ("D",))}
    sip = tables.candidates(tables.read_hierarchical(spark, str(tmp_path / "h.txt")), sip=True)
    assert {r.wdp for r in sip.where("scan = 7").collect()} == {10.0, 5.0}
    xml = [r.value for r in tables.pepxml_hits(c.withColumnRenamed("identified", "peptide"), "mvh", 1).collect()]
    assert len(xml) == 2 and sum("hit_rank" in x for x in xml) == 2 and any('peptide="[PEP~K]"' in x for x in xml)
    text = tables.hierarchical_text(c.select("scan", "charge").distinct(), c, ["scan"], ["scan", "charge"], ["identified", "mvh"])
    assert "+\t7\t2\n*\t[AAK]\t5.0\n*\t[PEP~K]\t10.0" in {r.value for r in text.collect()}


def test_forward_fill(spark):
    rows = [("f", 1, "+", ["a"]), ("f", 2, "*", ["b"]), ("f", 3, "+", ["c"]), ("f", 4, "*", ["d"]), ("f", 5, "*", ["e"])]
    df = spark.createDataFrame(rows, "file string, n int, marker string, fields array<string>")
    assert {(r.parent[0], r.fields[0]) for r in tables.parents_of_children(df, ["file"], F.col("n")).collect()} == {("a", "b"), ("c", "d"), ("c", "e")}


def test_table_and_runs(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.txt").write_text(f'# hi\nx\ty\n1\t{n}"q\n')
    rows = tables.read_table(spark, str(tmp_path / "*.txt"), "x int, y string").collect()
    assert {(r.y, r.run, r.source) for r in rows} == {('a"q', "Run1", "a.txt"), ('b"q', "Run2", "b.txt")}


def test_config():
    text = "[Peptide_Identification]\nSearch_Name = SE # c\nPTM{~} = M\nPTM{~to!} = x\nParent_Mass_Windows = -1, 0, 1\nResidue{G} = 2,3,1,1,0,0\nElement_Masses{C}=12.0,13.003355\nElement_Percent{C}=0.9893,0.0107\nSearch_Name = other\nMax_PTM_Count=2\n"
    c = config.search_config(text)
    assert (c.search_name, c.mass_windows, c.most_ptms, c.ptms, c.losses) == ("SE", (-1, 0, 1), 2, {"~": "M"}, {"~": "!"})
    assert c.elements["C"] == ((12.0, 13.003355), (0.9893, 0.0107)) and c.residues["G"] == (2, 3, 1, 1, 0, 0) and c.high_resolution
    made = config.sweep_configs(text, "C", 1, {"C13_50000Pct": 0.5}, {"C13_50000Pct": [-1, 0]})["C13_50000Pct"]
    assert "Element_Percent{C}= 0.50000, 0.50000" in made and config.search_config(made).mass_windows == (-1, 0)


def test_small_columns(spark):
    r = spark.createDataFrame([("{a, b,a}", "abcdef")], "p string, s string").select(tables.items(F.col("p")).alias("i"), tables.shortened(F.col("s"), 3).alias("s")).first()
    assert r.i == ["a", "b"] and r.s == "abc..."
