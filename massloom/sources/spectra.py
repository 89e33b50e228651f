"""Spectrum files: FT2 and MS2 text, mzML and MGF, as one row a scan."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN_SCHEMA = "file string, scan int, charge int, parent_mz double, scan_type string, rtime string, peaks array<struct<mz:double,inten:double,z:int>>"


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def read_ft2(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scans of FT2 or MS2 files: a record a scan, split where a line begins with S, so that large files are read in parts.

    Lines: S scan [scan] m/z; Z charge; I name value; peaks m/z intensity [.. .. .. charge].
    Scans without peaks are left out; an unknown charge is null.
    """
    paths = [path] if isinstance(path, str) else path
    records = spark.read.option("lineSep", "\nS").text(paths).select(_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    # a file's first record still has its header and its S
    body = F.regexp_replace("value", r"(?s)^(?:H[^\n]*\n|\s*\n)*S(?=\s)", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = records.select("file", lines.alias("lines")).where(F.size("lines") > 0)
    head = F.split(F.col("lines")[0], r"\s+")
    fields = lambda x: F.split(x, r"\s+")
    z = F.try_element_at(F.filter("lines", lambda x: x.startswith("Z")), F.lit(1))
    info = F.filter("lines", lambda x: x.startswith("I"))

    def value_of(*names: str) -> Column:
        hit = F.filter(F.transform(info, fields), lambda x: F.try_element_at(x, F.lit(2)).isin(*names))
        return F.array_join(F.slice(F.try_element_at(hit, F.lit(1)), 3, 1000), " ")

    def peak(x: Column) -> Column:
        p = fields(x)
        z_ = F.coalesce(F.try_element_at(p, F.lit(6)).try_cast("int"), F.lit(0))
        return F.struct(p[0].try_cast("double").alias("mz"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("inten"), z_.alias("z"))

    peaks = F.transform(F.filter("lines", lambda x: x.rlike(r"^[0-9]+[.0-9eE+-]*\s+[0-9]") & ~x.eqNullSafe(F.col("lines")[0])), peak)
    out = rows.select(
        "file", head[0].try_cast("int").alias("scan"), F.try_element_at(fields(z), F.lit(2)).try_cast("int").alias("charge"), F.try_element_at(head, F.lit(-1)).try_cast("double").alias("parent_mz"), value_of("ScanType").alias("scan_type"), value_of("RetentionTime", "RTime").alias("rtime"), peaks.alias("peaks"),
    )
    return out.where((F.size("peaks") > 0) & F.col("scan").isNotNull()).withColumn("charge", F.when(F.col("charge") > 0, F.col("charge")))


def decode_array(text: str, bits: int, compressed: bool) -> np.ndarray:
    raw = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(raw) if compressed else raw, "<f8" if bits == 64 else "<f4").astype(float)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """MS2 scans of mzML files by the XML source, a record a spectrum; arrays are decoded by Arrow batches. Peak charges are 0, the first precursor counts."""
    param = "array<struct<_accession:string,_name:string,_value:string>>"
    array = f"struct<cvParam:{param},binary:string>"
    schema = f"_id string, _index long, cvParam {param}, scanList struct<scan:array<struct<cvParam:{param}>>>, precursorList struct<precursor:array<struct<selectedIonList:struct<selectedIon:array<struct<cvParam:{param}>>>>>>, binaryDataArrayList struct<binaryDataArray:array<{array}>>"
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(schema).load(path).select("*", _file_name().alias("file"))

    def value(params: Column, accession: str) -> Column:
        return F.try_element_at(F.transform(F.filter(params, lambda p: p["_accession"] == accession), lambda p: p["_value"]), F.lit(1))

    ion = F.expr("precursorList.precursor[0].selectedIonList.selectedIon[0].cvParam")
    ms2 = rows.where(value(F.col("cvParam"), "MS:1000511") == "2")
    arrays = F.transform(
        F.col("binaryDataArrayList.binaryDataArray"),
        lambda a: F.struct(F.exists(a["cvParam"], lambda p: p["_accession"] == "MS:1000514").alias("is_mz"), F.exists(a["cvParam"], lambda p: p["_accession"] == "MS:1000574").alias("zip"), F.when(F.exists(a["cvParam"], lambda p: p["_accession"] == "MS:1000523"), 64).otherwise(32).alias("bits"), a["binary"].alias("data")),
    )
    scan = F.coalesce(F.nullif(F.regexp_extract("_id", r"scan=([0-9]+)", 1), F.lit("")).try_cast("int"), (F.col("_index") + 1).try_cast("int"))
    flat = ms2.select("file", scan.alias("scan"), value(ion, "MS:1000041").try_cast("int").alias("charge"), value(ion, "MS:1000744").try_cast("double").alias("parent_mz"), value(F.expr("scanList.scan[0].cvParam"), "MS:1000016").alias("rtime"), arrays.alias("arrays"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            peaks = []
            for arrays_ in f["arrays"]:
                by = {bool(a["is_mz"]): decode_array(a["data"], a["bits"], a["zip"]) for a in (arrays_ if arrays_ is not None else [])}
                mz, inten = by.get(True, np.zeros(0)), by.get(False, np.zeros(0))
                peaks.append([{"mz": float(m), "inten": float(i), "z": 0} for m, i in zip(mz, inten, strict=False)])
            yield pd.DataFrame({"file": f["file"], "scan": f["scan"], "charge": f["charge"], "parent_mz": f["parent_mz"], "scan_type": None, "rtime": f["rtime"], "peaks": peaks})

    return flat.mapInPandas(decode, SCAN_SCHEMA).where(F.size("peaks") > 0)


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Scans of MGF files: a record an ion block."""
    records = spark.read.option("lineSep", "END IONS").text(path).select(_file_name().alias("file"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))

    def after(name: str) -> Column:
        return F.try_element_at(F.transform(F.filter("lines", lambda x: x.startswith(name + "=")), lambda x: F.substring(x, len(name) + 2, 10_000)), F.lit(1))

    peak = F.transform(F.filter("lines", lambda x: x.rlike("^[0-9]")), lambda x: F.struct(F.split(x, r"\s+")[0].try_cast("double").alias("mz"), F.try_element_at(F.split(x, r"\s+"), F.lit(2)).try_cast("double").alias("inten"), F.coalesce(F.regexp_extract(F.coalesce(F.try_element_at(F.split(x, r"\s+"), F.lit(3)), F.lit("0")), "^([0-9]+)", 1).try_cast("int"), F.lit(0)).alias("z")))
    out = records.select("file", after("SCANS").try_cast("int").alias("scan"), F.regexp_extract(F.coalesce(after("CHARGE"), F.lit("")), "^([0-9]+)", 1).try_cast("int").alias("charge"), F.split(after("PEPMASS"), r"\s+")[0].try_cast("double").alias("parent_mz"), F.lit(None).cast("string").alias("scan_type"), after("RTINSECONDS").alias("rtime"), peak.alias("peaks"))
    return out.where(F.size("peaks") > 0)


def write_ft2(scans: DataFrame, path: str) -> None:
    """Scans as text in the layout that read_ft2 reads; a part file a partition."""
    lines = F.concat_ws(
        "\n",
        F.concat_ws("\t", F.lit("S"), "scan", "parent_mz"),
        F.when(F.col("charge").isNotNull(), F.concat_ws("\t", F.lit("Z"), "charge", F.lit("0"))),
        F.when(F.col("scan_type").isNotNull(), F.concat_ws("\t", F.lit("I"), F.lit("ScanType"), "scan_type")),
        F.when(F.col("rtime").isNotNull(), F.concat_ws("\t", F.lit("I"), F.lit("RetentionTime"), "rtime")),
        F.array_join(F.transform("peaks", lambda p: F.concat_ws("\t", p["mz"].cast("string"), p["inten"].cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), p["z"].cast("string"))), "\n"),
    )
    scans.select(lines.alias("value")).write.text(path)
