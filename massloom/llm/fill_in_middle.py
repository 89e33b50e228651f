"""Fill-in-the-middle transformation: cuts at ranks of units, found by counting chunks and rescanning only those that own a cut."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk; each is read with the one byte before it.
CHUNK = 4096

#: (byte before, byte) -> whether a unit starts at byte.
Predicate = Callable[[np.ndarray, np.ndarray], np.ndarray]


def code_points(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Units are code points: a byte that continues none starts one."""
    return (here & 0xC0) != 0x80


def words(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Units are words, each with the white space behind it."""
    return ((before == 32) | ((before >= 9) & (before <= 13))) & ~((here == 32) | ((here >= 9) & (here <= 13)))


def _starts(chunk: bytes, first: bool, predicate: Predicate) -> np.ndarray:
    """Whether a unit starts at each byte of a chunk, which begins with the byte before it unless it is a text's first."""
    data = np.frombuffer(chunk, np.uint8)
    if first:
        data = np.concatenate((np.full(1, 32, np.uint8), data))
    found = predicate(data[:-1], data[1:])
    if first and len(found):
        found = found.copy()
        found[0] = True
    return found


def chunk_counts(text: Column, predicate: Predicate = code_points, chunk: int = CHUNK) -> Column:
    """Units that start in each chunk of a text given as binary: array<int>, empty for an empty text."""

    @F.pandas_udf("array<int>")
    def count(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            out.append(np.array([np.count_nonzero(_starts(t[max(a - 1, 0) : a + chunk], a == 0, predicate)) for a in range(0, len(t), chunk)], np.int32))
        return pd.Series(out, dtype=object)

    return count(text)


def owning_chunk(counts: Column, rank: Column) -> Column:
    """The chunk in which the unit of this rank (from 0) starts and the units before it there: struct(chunk, rank); chunk is -1 beyond the last unit."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("rank"))

    def step(state: Column, n: Column) -> Column:
        here = (state["chunk"] < 0) & (state["seen"] + n > rank)
        return F.struct((state["seen"] + n).alias("seen"), (state["at"] + 1).alias("at"), F.when(here, state["at"]).otherwise(state["chunk"]).alias("chunk"), F.when(here, rank - state["seen"]).otherwise(state["rank"]).alias("rank"))

    done = F.aggregate(counts, start, step)
    return F.struct(done["chunk"].alias("chunk"), done["rank"].alias("rank"))


def cut_offset(text: Column, owner: Column, predicate: Predicate = code_points, chunk: int = CHUNK) -> Column:
    """Byte at which the unit that owner (of owning_chunk) names starts: only its chunk is sent and scanned again."""

    @F.pandas_udf("int")
    def within(parts: pd.Series, firsts: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(_starts(p, f, predicate))[r]) if r >= 0 else 0 for p, f, r in zip(parts, firsts, ranks, strict=True)], dtype="int32")

    first, some = owner["chunk"] == 0, owner["chunk"] >= 0
    part = F.when(some, F.substring(text, F.when(first, F.lit(1)).otherwise(owner["chunk"] * chunk), F.when(first, F.lit(chunk)).otherwise(F.lit(chunk + 1)))).otherwise(F.lit(b""))
    place = within(part, first, F.when(some, owner["rank"]).otherwise(F.lit(-1).cast("long")))
    return F.when(some, owner["chunk"].cast("long") * chunk + place).otherwise(F.octet_length(text).cast("long"))


def hash_part(digest: Column, i: int) -> Column:
    """The i-th (from 0) group of 8 hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), predicate: Predicate = code_points, chunk: int = CHUNK) -> DataFrame:
    """Documents (doc_id, text) with their middle moved to the end: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Both cuts are ranks of units drawn from the hash of seed and doc_id. Units are told by
    pairs of adjacent bytes, so chunks that overlap by one byte count theirs each by itself;
    the running sum of a text's counts names the chunk that owns a rank, and only that
    chunk is scanned again for the place. Cuts and output are made by Spark's functions.

    form: plain (output is the text) if the text is empty or holds a marker, and for 100 -
    percent of documents; else spm (suffix first) for spm_percent of documents, else psm. prefix_chars and
    middle_chars are null if plain. Null texts count as empty, a null id as an empty one;
    rows that repeat are cut alike; other columns are ignored; a text is cut whatever its
    length, in one row, as its output is one value.
    """
    prefix_mark, suffix_mark, middle_mark = (F.lit(m.encode()) for m in markers)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("string"), digest.alias("digest"))
    plain = (F.col("string") == "") | (hash_part(F.col("digest"), 2) % 100 >= percent)
    for m in markers:
        plain |= F.col("string").contains(m)
    text = text.select("doc_id", "digest", plain.alias("plain"), F.col("string").cast("binary").alias("text"))
    text = text.withColumn("counts", chunk_counts(F.col("text"), predicate, chunk))
    text = text.withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))
    draws = [hash_part(F.col("digest"), i) % (F.col("n") + 1) for i in (0, 1)]
    text = text.withColumn("low", F.least(*draws)).withColumn("high", F.greatest(*draws))
    text = text.withColumn("low_at", owning_chunk(F.col("counts"), F.col("low"))).withColumn("high_at", owning_chunk(F.col("counts"), F.col("high"))).drop("counts")
    text = text.withColumn("from", cut_offset(F.col("text"), F.col("low_at"), predicate, chunk)).withColumn("to", cut_offset(F.col("text"), F.col("high_at"), predicate, chunk))
    cut = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = cut(F.lit(0), F.col("from")), cut(F.col("from"), F.col("to")), cut(F.col("to"), F.octet_length("text"))
    form = F.when(F.col("plain"), "plain").when(hash_part(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))
        .otherwise(F.concat(suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
    )
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return text.withColumn("form", form).select("doc_id", "n", "form", chars(F.col("low")).alias("prefix_chars"), chars(F.col("high") - F.col("low")).alias("middle_chars"), output.cast("string").alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of this form was made of; exact, as a text that holds a marker is plain."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers))
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
