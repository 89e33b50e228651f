"""The library's entities as fixed projections of the driver's tables, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with the SQL that DuckDB runs to check them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Matches of peptides to scans.
PSM = "(SELECT l_returnflag AS file, l_orderkey AS scan, least(l_linenumber, 3) AS z, l_linenumber AS line, l_partkey AS pep, l_suppkey AS protein, l_extendedprice AS mvh, l_quantity AS xcorr, l_discount AS wdp, l_tax AS pct, l_shipdate AS shipped FROM lineitem)"
#: What orders matches of equal score: the whole row.
TIES = "pep, protein, line, mvh, xcorr, wdp, pct, file, shipped"
#: Labels: protein numbers ending in 0 are test decoys, in 1 training decoys.
LABEL = "CASE WHEN protein % 10 = 0 THEN 3 WHEN protein % 10 = 1 THEN 2 ELSE 1 END"


def psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("file"), c("l_orderkey").alias("scan"), F.least("l_linenumber", F.lit(3)).alias("z"), c("l_linenumber").alias("line"), c("l_partkey").alias("pep"), c("l_suppkey").alias("protein"),
        c("l_extendedprice").alias("mvh"), c("l_quantity").alias("xcorr"), c("l_discount").alias("wdp"), c("l_tax").alias("pct"), c("l_shipdate").alias("shipped"),
    )


def ties() -> list[Column]:
    return [F.col(c) for c in TIES.split(", ")]


def is_test() -> Column:
    return F.col("protein") % 10 == 0


def is_train() -> Column:
    return F.col("protein") % 10 == 1


def is_forward() -> Column:
    return ~is_test() & ~is_train()


#: Spectra: one a vector, with peaks 10 apart from 100.
SCANS = "(SELECT vec_id AS scan, label % 3 + 1 AS z, embedding FROM embeddings)"
PEAKS = "(SELECT scan, z, i - 1 AS place, 100.0 + 10 * (i - 1) AS mz, CAST(abs(embedding[i]) AS DOUBLE) AS inten FROM (SELECT vec_id AS scan, label % 3 + 1 AS z, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = F.transform("embedding", lambda x, i: F.struct((F.lit(100.0) + i * 10).alias("mz"), F.abs(x).cast("double").alias("inten")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scan"), (F.col("label") % 3 + 1).alias("z"), peaks.alias("peaks"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark, sf_dir).select("scan", "z", F.posexplode("peaks").alias("place", "p")).select("scan", "z", "place", "p.mz", "p.inten")


#: Proteins: the documents' letters that are residues.
PROTEINS = "(SELECT CAST(doc_id AS VARCHAR) AS protein_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)"


def sequences(texts: DataFrame, key: str) -> DataFrame:
    """The same of any table with a text."""
    seq = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    return texts.where("text is not null").select(F.col(key).cast("string").alias("protein_id"), seq.alias("seq"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"), "doc_id")


EDGES = "(SELECT DISTINCT l_suppkey AS protein, l_partkey AS peptide FROM lineitem)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_partkey").alias("peptide")).distinct()
