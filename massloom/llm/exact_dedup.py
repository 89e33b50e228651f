"""Exact dedup by a 128-bit content hash and a comparison of bytes, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.staging import fresh_names, release, stage

#: Groups of copies up to which their answers are broadcast (about 100 bytes each); beyond, a shuffled join is used.
BROADCAST_GROUPS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """text with A-Z alone lower-cased; texts of ASCII alone, told by their length, take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def content_key(text: Column) -> Column:
    """128 bits of a text's content."""
    return F.unhex(F.md5(text))


def _hashed(docs: DataFrame, normalise: Callable[[Column], Column], content_hash: Callable[[Column], Column]) -> DataFrame:
    texts = docs.select("doc_id", normalise(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.withColumn("content", content_hash(F.col("text")))


def exact_copies(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = ascii_lower, content_hash: Callable[[Column], Column] = content_key, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Each document (doc_id, text) with the one that stays of those with an equal normalised text.

    Returns a row per row of docs: doc_id, keep_id (smallest or largest doc_id of the group),
    group_size (rows of the group), kept (doc_id = keep_id), text_sha256 (of the normalised text).

    Hashes of the whole texts are counted; texts whose hash comes once are of no group. The
    others are grouped by hash and text, so that Spark's aggregation compares their bytes, and
    copies meet in their own task before anything is shuffled. Texts that share a hash but
    not their bytes are joined by hash and text; the rest by hash alone, which moves no text.

    Null texts count as empty, and all empty texts are copies. Rows without an id count in
    group_size and stay only if no row of the group has an id. Rows that repeat id and text get
    the same answer. Other columns are ignored; an empty table gives an empty result.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    spark = docs.sparkSession
    texts = _hashed(docs, normalise, content_hash)
    hashed, hashed_path = stage(texts.select("doc_id", "content", F.unhex(F.sha2("text", 256)).alias("sha")), "exact-hashed")
    repeated, repeated_path = stage(hashed.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content"), "exact-repeated")
    few = repeated.count() <= broadcast_groups

    def compared(among: DataFrame) -> DataFrame:
        return among.groupBy("content", "text").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))

    groups, groups_path = stage(compared(texts.join(F.broadcast(repeated), "content", "left_semi") if few else texts).select("content", "group_size", "keep_id"), "exact-groups")
    release(spark, repeated_path)
    variants = groups.groupBy("content").agg(F.count("*").alias("variants"), F.max("group_size").alias("group_size"), best("keep_id").alias("keep_id"))
    sole = variants.where("variants = 1 and group_size > 1").select("content", "group_size", "keep_id")
    clashing, clashing_path = stage(variants.where("variants > 1").select("content"), "exact-clashing")
    clashes = not clashing.isEmpty()
    plain = hashed.join(clashing, "content", "left_anti") if clashes else hashed
    answered = plain.join(F.broadcast(sole) if few else sole, "content", "left")
    answered = answered.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    if clashes:
        among = texts.join(clashing, "content", "left_semi")
        told = among.join(compared(among), ["content", "text"]).withColumn("sha", F.unhex(F.sha2("text", 256)))
        answered = answered.unionByName(told.drop("text"))
    else:
        release(spark, clashing_path)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return answered.select("doc_id", "keep_id", size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = ascii_lower, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """docs, all columns, without the rows that exact_copies drops; rows equal in id and text stay or go together."""
    gone, _ = stage(exact_copies(docs, keep, normalise, broadcast_groups=broadcast_groups).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct(), "exact-gone")
    (sha,) = fresh_names([*docs.columns, "gone_id", "gone_sha"], "sha")
    named = docs.withColumn(sha, F.sha2(normalise(F.coalesce("text", F.lit(""))), 256))
    gone = gone.toDF(*fresh_names(named.columns, *gone.columns))
    same = named["doc_id"].eqNullSafe(gone[gone.columns[0]]) & (named[sha] == gone[gone.columns[1]])
    return named.join(F.broadcast(gone) if gone.count() <= broadcast_groups else gone, same, "left_anti").drop(sha)
