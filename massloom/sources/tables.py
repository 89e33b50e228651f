"""Sequence files and the text tables between stages; Parquet is what the library itself keeps."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.operators.digest import RESIDUES, clean_sequence


def read_fasta(spark: SparkSession, path: str | list[str], legal: str = RESIDUES) -> DataFrame:
    """protein_id (header up to white space), descr, seq (lines joined, other characters removed); records without residues are left out."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\s*>", "").alias("value"))
    head = F.split_part(F.col("value"), F.lit("\n"), F.lit(1))
    seq = clean_sequence(F.regexp_replace("value", r"^[^\n]*", ""), legal)
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("protein_id"), F.regexp_extract(head, r"^\S*\s*(.*)$", 1).alias("descr"), seq.alias("seq")).where("protein_id <> '' and seq <> ''")


def write_fasta(proteins: DataFrame, path: str) -> None:
    proteins.select(F.concat(F.lit(">"), "protein_id", F.lit("\n"), "seq").alias("value")).write.text(path)


def needed_descriptions(fasta: DataFrame, needed: DataFrame) -> DataFrame:
    """Descriptions of needed proteins (protein_id), with # as $ and tabs as spaces."""
    return fasta.join(needed.select("protein_id").distinct(), "protein_id", "left_semi").select("protein_id", F.translate("descr", "#\t", "$ ").alias("descr"))


def read_table(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A tab-separated table with a header and # comments, with its file's name and the run (files in order of their paths)."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", schema=schema, quote="").select("*", F.col("_metadata.file_path").alias("_path"))
    files = rows.select("_path").distinct().withColumn("run", F.concat(F.lit("Run"), F.dense_rank().over(Window.orderBy("_path"))))  # a row a file
    return rows.join(F.broadcast(files), "_path").withColumn("source", F.element_at(F.split("_path", "/"), -1)).drop("_path")


def write_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="")


def parents_of_children(lines: DataFrame, by: Sequence[str], order: Column, parent: str = "+", child: str = "*") -> DataFrame:
    """Child rows (marker in column `marker`) each with its parent's fields: column parent (array), fields (array).

    lines: marker, fields. The nearest parent row above a child in its file is its parent.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("parent", F.last(F.when(F.col("marker") == parent, F.col("fields")), ignorenulls=True).over(w))
    return filled.where(F.col("marker") == child)


def read_hierarchical(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of a file of + and * lines: file, parent, fields.

    Each + line begins a record with its * lines, so that no order across records is needed.
    """
    records = spark.read.option("lineSep", "\n+").text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: ~x.startswith("#") & (x != "")).alias("lines"))
    # what comes before the first + line of a file is comments and headers
    own = F.filter("lines", lambda x: ~x.startswith("*\t"))
    parent = F.try_element_at(own, F.lit(-1))
    fields = F.split(F.regexp_replace(parent, r"^\+?\t", ""), "\t")
    children = F.transform(F.filter("lines", lambda x: x.startswith("*\t")), lambda x: F.split(F.substring(x, 3, 1_000_000), "\t"))
    rows = records.select("file", fields.alias("parent"), F.explode(children).alias("fields"))
    return rows.where(F.col("fields")[0] != "")


def candidates(rows: DataFrame, sip: bool = False) -> DataFrame:
    """Typed candidates of read_hierarchical's rows of a search output; with sip, the three scores are in the other order."""
    p, f = F.col("parent"), F.col("fields")
    scores = ("wdp", "xcorr", "mvh") if sip else ("mvh", "xcorr", "wdp")
    return rows.where((F.size("parent") >= 7) & (F.size("fields") >= 7) & f[2].try_cast("double").isNotNull()).select(
        p[0].alias("filename"), p[1].try_cast("int").alias("scan"), p[2].try_cast("int").alias("charge"), p[3].try_cast("double").alias("measured_mass"), p[4].alias("scan_type"), p[5].alias("search_name"), p[6].alias("rtime"),
        f[0].alias("identified"), f[1].alias("original"), f[2].try_cast("double").alias("calculated_mass"), *(f[3 + i].try_cast("double").alias(s) for i, s in enumerate(scores)), items(f[6]).alias("proteins"),
    )


def items(text: Column) -> Column:
    """{a,b} or a,b as distinct trimmed items."""
    parts = F.transform(F.split(F.regexp_replace(text, r"^\s*\{|\}\s*$", ""), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def braces(list_: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(list_, ","), F.lit("}"))


def shortened(column: Column, most: int) -> Column:
    """At most `most` characters, with dots where some were cut."""
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("..."))).otherwise(column)


def hierarchical_text(parents: DataFrame, children: DataFrame, key: Sequence[str], parent_fields: Sequence[str], child_fields: Sequence[str]) -> DataFrame:
    """One text value a parent: its + line and its children's * lines in order; parents in no order."""
    line = F.concat_ws("\t", F.lit("*"), *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in child_fields))
    lists = children.groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    head = F.concat_ws("\t", F.lit("+"), *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in parent_fields))
    return parents.join(lists, list(key), "left").select(F.concat_ws("\n", head, F.array_join("_lines", "\n")).alias("value"))


def pepxml_hits(psms: DataFrame, score: str, most: int = 5) -> DataFrame:
    """spectrum_query elements (text) with the best hits of each scan by one score. psms: filename, scan, charge, measured_mass, peptide, calculated_mass, proteins, score columns."""
    key = ["filename", "scan", "charge", "measured_mass"]
    w = Window.partitionBy(*key).orderBy(F.desc(score), "peptide")
    ranked = psms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

    def quoted(c: Column) -> Column:
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit(">"), F.lit("&gt;"))

    hit = F.format_string(
        '<search_hit hit_rank="%d" peptide="%s" protein="%s" num_tot_proteins="%d" calc_neutral_pep_mass="%.5f" massdiff="%.5f"><search_score name=' + quoteattr(score) + ' value="%.6f"/></search_hit>',
        "rank", quoted(F.col("peptide")), quoted(F.coalesce(F.try_element_at("proteins", F.lit(1)), F.lit(""))), F.size("proteins"), "calculated_mass", F.col("measured_mass") - F.col("calculated_mass"), F.col(score),
    )
    hits = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", hit.alias("xml")))).alias("hits"))
    head = F.format_string('<spectrum_query spectrum="%s.%d.%d.%d" start_scan="%d" end_scan="%d" precursor_neutral_mass="%.5f" assumed_charge="%d"><search_result>', quoted(F.col("filename")), "scan", "scan", "charge", "scan", "scan", "measured_mass", "charge")
    return hits.select(F.concat(head, F.array_join(F.transform("hits", lambda h: h["xml"]), ""), F.lit("</search_result></spectrum_query>")).alias("value"))


def percolator_rows(psms: DataFrame, features: Sequence[str], is_target: Column) -> DataFrame:
    """Rows for an external re-scorer: id, label (1 or -1), scan, features, peptide, proteins."""
    name = F.concat_ws(".", "filename", "scan", "charge")
    return psms.select(name.alias("id"), F.when(is_target, 1).otherwise(-1).alias("label"), "scan", *features, "peptide", F.array_join("proteins", "\t").alias("proteins"))
