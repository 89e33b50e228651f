"""Work on tables that are bucketed and sorted by a key, whose joins and groups by it need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a table; tables that are joined have the same number.
BUCKETS = 32


def bucketed(df: DataFrame, key: Sequence[str], buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """df as a table of the warehouse, bucketed and sorted by key, reread. It is shuffled once, here; a task writes the buckets that it holds."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, *key).write.format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return df.sparkSession.table(name)


def with_scan(matches: DataFrame, scans: DataFrame, key: Sequence[str]) -> DataFrame:
    """matches with the columns of their scans (key unique there); the job fails at a match whose scan is missing."""
    marked = scans.withColumn("_there", F.lit(True))
    joined = matches.join(marked, list(key), "left")
    missing = F.raise_error(F.concat(F.lit("no scan for "), F.to_json(F.struct(*key))))
    return joined.where(F.when(F.col("_there"), True).otherwise(missing.cast("boolean"))).drop("_there")


def merge_searches(matches: DataFrame, key: Sequence[str], peptide: str, search: str, score: str, most: int, ties: Sequence[Column] = ()) -> DataFrame:
    """Candidates of each scan over all searches: a row for each peptide with its best score, the searches that found it (sorted) and its rank, the first `most`.

    A peptide found by several searches is one candidate. Ties go to the smallest peptide, or as `ties` say. Null scores come last.
    """
    merged = matches.groupBy(*key, peptide).agg(F.max(score).alias(score), F.array_sort(F.collect_set(search)).alias("searches"))
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(score), *(ties or [F.col(peptide)]))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
