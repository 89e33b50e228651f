"""Importance resampling towards a target distribution, by the gains of hashed n-gram buckets.

A block's distinct n-grams are a dictionary: each is counted and hashed once, however often
it comes. The CRC of an n-gram follows from those of its words, which are joined without
writing the n-gram out. Only bucket totals leave a block, and a document's counts stay beside
its id until the gains are known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from massloom.llm.fill_in_middle import hash_part
from massloom.llm.staging import release, stage
from massloom.llm.words import blocks, give_back, string_bytes

#: Buckets of hashed features; words in the longest feature; bytes of text in a block.
BUCKETS, LONGEST, BLOCK_BYTES = 10_000, 3, 2 << 20
#: Words that a document needs to be drawn.
LEAST_WORDS = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BIT = np.uint32(1) << np.arange(32, dtype=np.uint32)
#: The reversed polynomial of CRC-32, as zlib has it.
_POLYNOMIAL = np.uint32(0xEDB88320)


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its value on each bit, applied to values."""
    on = (values[..., None] & _BIT) != 0
    return np.bitwise_xor.reduce(np.where(on, columns, np.uint32(0)), axis=-1)


@lru_cache(4096)
def _zeros(n: int) -> np.ndarray:
    """What n zero bytes behind a text do to its CRC, as a linear map."""
    if n == 0:
        return _BIT.copy()
    if n == 1:
        one = _BIT.copy()
        for _ in range(8):
            one = np.where(one & np.uint32(1), (one >> np.uint32(1)) ^ _POLYNOMIAL, one >> np.uint32(1))
        return one
    half = _zeros(n // 2)
    whole = _apply(half, half)
    return _apply(_zeros(1), whole) if n % 2 else whole


@lru_cache(1024)
def _shift_table(n: int) -> np.ndarray:
    """The same map by the value of each of the four bytes: 4 x 256."""
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(_zeros(n), byte << np.uint32(8 * k)) for k in range(4)])


def join_crcs(first: np.ndarray, then: np.ndarray, table: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts first + then: table stacks the shift tables, length says which of them is that of `then`'s bytes."""
    out = then.copy()
    for k in range(4):
        out ^= table[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def block_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number of each word, the distinct words, words before each row) of a string column without nulls.

    A-Z are lower-cased; words are runs of ASCII letters, digits and characters beyond ASCII.
    """
    data, ends = string_bytes(column)
    data = _LOWER[data]
    n = len(data)
    word = _IN_WORD[data]
    new_row = np.zeros(n + 1, bool)
    new_row[ends] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | new_row[1:n]
    starts = np.flatnonzero(start)
    letters = np.concatenate(([0], np.cumsum(word)))
    offsets = np.concatenate((letters[starts], letters[-1:])).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(starts, ends)


def block_features(column: pa.Array, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(CRC of each distinct feature, how often it comes, distinct feature of each occurrence, row of each occurrence, words of each row) of a block.

    Features are runs of 1 to longest words of a row, joined by a space.
    """
    ids, distinct, rows = block_words(column)
    n_words = np.diff(rows)
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    if not len(ids):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint32), none, none, none, n_words
    texts = distinct.to_pylist()
    crc = np.array([zlib.crc32(w) for w in texts], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in texts], np.uint32)
    lengths, which = np.unique(np.array([len(w) + 1 for w in texts]), return_inverse=True)
    table = np.stack([_shift_table(int(k)) for k in lengths])
    crcs, counts, places, owners, known = [crc], [np.bincount(ids, minlength=len(crc))], [ids], [row_of], len(crc)
    run, run_crc = ids, crc
    for n in range(2, longest + 1):
        at = np.flatnonzero(row_of[: max(len(ids) - n + 1, 0)] == row_of[n - 1 :])
        # run holds, at each word, the number of the run of n - 1 words that begins there
        keys, first, number, count = np.unique(run[at] * len(texts) + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        last = ids[at[first] + n - 1]
        joined = join_crcs(run_crc[run[at[first]]], spaced[last], table, which[last])
        crcs.append(joined)
        counts.append(count)
        places.append(number + known)
        owners.append(row_of[at])
        known += len(keys)
        run = np.zeros(len(ids), np.int64)
        run[at] = number
        run_crc = joined
    return np.concatenate(crcs), np.concatenate(counts), np.concatenate(places), np.concatenate(owners), n_words


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in blocks of about BLOCK_BYTES of text; a longer text is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        for a, e in blocks(b.column("text"), BLOCK_BYTES):
            part = b.slice(a, e - a)
            n = int(string_bytes(part.column("text"))[1][-1])
            if held and size + n > BLOCK_BYTES:
                yield block()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield block()


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, rows: bool = True) -> DataFrame:
    """Per-document feature counts and the totals of all: doc_id, n_words, n_features, steps, totals.

    A row for each row of texts (doc_id, text without nulls), if `rows`, with totals null. steps holds the buckets of all its
    features in order, repeats and all, each as its distance from the one before, so that the
    counts stay small on disk. Besides, a row for each task whose only value is totals, the features of each bucket there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for block in _gathered(batches):
            crcs, counts, places, owners, n_words = block_features(block.column("text"), longest)
            bucket = (crcs % np.uint32(buckets)).astype(np.int64)
            totals += np.bincount(bucket, counts, buckets).astype(np.int64)
            if rows:
                both = np.sort(owners * buckets + bucket[places])
                sizes = np.bincount(owners, minlength=block.num_rows)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                value = both % buckets
                steps = np.diff(value, prepend=0)
                first = ends[:-1][sizes > 0]
                steps[first] = value[first]
                out = [block.column("doc_id"), pa.array(n_words), pa.array(sizes), pa.LargeListArray.from_arrays(ends, pa.array(steps.astype(np.int32))).cast(pa.list_(pa.int32())), pa.nulls(block.num_rows, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names)
        if totals.any():
            schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_features", pa.int64()), ("steps", pa.list_(pa.int32())), ("totals", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema][:-1] + [pa.array([totals], schema.field("totals").type)], schema=schema)
        give_back()

    names = ["doc_id", "n_words", "n_features", "steps", "totals"]
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, steps array<int>, totals array<long>")


def bucket_totals(counts: DataFrame, name: str) -> DataFrame:
    """Features of each bucket of a result of feature_counts: bucket and the named count; buckets without any may be absent."""
    return counts.where("totals is not null").select(F.posexplode("totals").alias("bucket", name)).groupBy("bucket").agg(F.sum(name).alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Gain of each bucket in thousandths, rounded down: the log of its smoothed share in target over that in source (bucket, s and bucket, t)."""
    both = source.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(source, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets).cast("double"))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # sums is one row


def _weights(counts: DataFrame, gains: np.ndarray) -> DataFrame:
    """Sum of the gains of each document's features, from its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("steps")
            steps, ends = column.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(b.column("n_features").to_numpy())))
            running = np.cumsum(steps)
            # the running sum goes on over rows: less what came before each row
            before = np.concatenate(([0], running))[ends[:-1]]
            value = running - np.repeat(before, np.diff(ends))
            sums = np.concatenate(([0], np.cumsum(gains[value])))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "n_words", "n_features")] + [pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[str], most: int, rank: str = "rank") -> DataFrame:
    """rows with their rank from 1 in the order of sort expressions, null beyond `most`: ranges of the order are ranked by themselves, the rows before them added."""
    keys = [F.expr(o) if not o.endswith(" desc") else F.expr(o.removesuffix(" desc")).desc() for o in order]
    dealt, _ = stage(rows.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()), "resample-ranges")
    offsets, total = {}, 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("range_").count().collect()):  # one row a range
        offsets[part] = total
        total += n
    some = [p for p, n in offsets.items() if n < most]
    before = dealt.sparkSession.createDataFrame([(p, offsets[p]) for p in some], "range_ int, before long")
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*keys))
    near = dealt.join(F.broadcast(before), "range_").withColumn(rank, within + F.col("before"))
    near = near.withColumn(rank, F.when(F.col(rank) <= most, F.col(rank))).drop("before")
    rest = dealt.join(F.broadcast(before), "range_", "left_anti").withColumn(rank, F.lit(None).cast("long"))
    return near.unionByName(rest).drop("range_")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Draw percent of docs (doc_id, text) so that their n-grams resemble those of target (a column text).

    Returns a row per row of docs: doc_id, n_features, weight (sum of the gains of its features,
    in thousandths), score (weight plus Gumbel noise from the hash of seed and doc_id), rank
    (from 1 in order of score, ties to the smaller doc_id; null if not drawn).

    Features are runs of 1 to `longest` words, repeats counted, dealt to buckets by CRC-32. A
    block's distinct features are counted and hashed once each; all documents of docs and
    target count. floor(percent * N / 100) of the N documents with at least least_words words are drawn.

    Null and empty texts have no features: weight 0, never drawn. Rows without an id are left
    out of everything; rows that repeat an id are documents of their own with the same noise.
    Texts are whole, however long. Other columns are ignored; empty docs give an empty result,
    an empty target gives the gains of its smoothing.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts, counts_path = stage(feature_counts(texts, buckets, longest), "resample-counts")
    aims = target.select(F.lit(0).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gains = bucket_gains(bucket_totals(counts, "s"), bucket_totals(feature_counts(aims, buckets, longest, rows=False), "t"), buckets)
    by_bucket = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():  # `buckets` rows
        by_bucket[bucket] = gain
    draw = (hash_part(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 0) + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(draw)))
    scored, _ = stage(_weights(counts.where("totals is null").drop("totals"), by_bucket).withColumn("score", F.col("weight") + noise), "resample-scored")
    release(spark, counts_path)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(able, ["score desc", "doc_id"], able.count() * percent // 100)
    out = drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
