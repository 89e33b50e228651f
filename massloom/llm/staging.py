"""Intermediate tables, written to the shared folder so that they outlive any executor."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of 8-byte keys that may be broadcast (16 MB); beyond it a shuffled join is used.
BROADCAST_KEYS = 2_000_000
#: Bytes of a row group of a staged table: a task holds one to write it.
ROW_GROUP_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where unset (tests), a folder in the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and return it reread, with its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def semi_by_key(df: DataFrame, keys: DataFrame, on: Column, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Left-semi join; keys (staged, one 8-byte column) are broadcast only if counted to be few."""
    return df.join(F.broadcast(keys) if keys.count() <= limit else keys, on, "left_semi")


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column of taken is called so (in any case)."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out
