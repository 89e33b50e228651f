"""Log-probabilities of texts by a bigram model whose quantised counts sit in a Bloom filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.staging import release, stage
from massloom.llm.words import blocks, mix, word_hashes

#: Size that a broadcast filter can't exceed; where it might, the filter stays in its slices, and n-grams are shuffled to them.
FILTER_BYTES = 64 << 20
BITS_PER_KEY, PROBES = 10, 4
#: Counts are held as levels: 1 for a count of 1, then one more for every factor of LEVEL_BASE.
LEVEL_BASE, LEVELS = 1.5, 64
#: Pseudo-count with which a word's probability after another is drawn to its own.
PRIOR = 20.0
#: Bytes of text for which one slice of the counts is planned, and of a block of texts whose n-grams are sent together.
SLICE_BYTES, BLOCK_TEXT = 8 << 20, 1 << 20

END = np.uint64(0x5DEECE66D1234567)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count of at least 1."""
    return np.searchsorted(level_floor(np.arange(1, LEVELS + 1)), counts, "right")


def level_floor(levels: np.ndarray) -> np.ndarray:
    """Smallest count of each level; 0 for level 0."""
    return np.where(levels > 0, np.ceil(LEVEL_BASE ** (np.maximum(levels, 1) - 1.0) - 1e-9), 0.0)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)


def token_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens before each row): the words of each text, then one end."""
    words, rows = word_hashes(column)
    n = len(column)
    rows = rows + np.arange(n + 1)
    tokens = np.empty(len(words) + n, np.uint64)
    ends = rows[1:] - 1
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = words
    tokens[ends] = END
    return tokens, rows


def bigrams(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token before each token, 48-bit key of the pair, in the upper bits); a text's first token comes after an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[rows[:-1]] = END
    return before, mix(before * _NEXT + tokens) & ~np.uint64(0xFFFF)


class BloomCounts:
    """Levels of n-grams: key and level are probed together, from level 1 up to the first miss.

    slices: filters of equal ranges of the key space, in order, each of its own size.
    """

    def __init__(self, slices: list[np.ndarray]):
        size = np.array([len(s) for s in slices], np.int64)
        self.bits = np.concatenate(slices)
        self.start, self.size = (np.cumsum(size) - size) * 8, size * 8

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            if not len(left):
                break
            at = slice_of(keys[left], len(self.size))
            hit = np.ones(len(left), bool)
            for place in probes(keys[left], level, self.size[at].astype(np.uint64)):
                place = place + self.start[at]
                hit &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            left = left[hit]
            found[left] = level
        return found


def probes(keys: np.ndarray, level: int, bits: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    h = mix(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    step = (h >> np.uint64(33)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) % bits).astype(np.int64)


def filter_slice(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of n-grams with counts over 0: BITS_PER_KEY bits for each level of each."""
    keys, levels = keys[counts > 0], level_of(counts[counts > 0])
    bits = max(64, int(levels.sum()) * BITS_PER_KEY // 8 * 8)
    on = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in probes(keys[levels >= level], level, np.uint64(bits)):
            on[at] = True
    return np.packbits(on, bitorder="little")


_GRAMS = "kind int, slice int, block long, keys binary, counts binary"
_MERGED = "kind int, slice int, block long, levels binary, counts binary, bits binary, keys binary, distinct long, total long"
WORDS, PAIRS = 1, 2


def gram_rows(tokens: np.ndarray, rows: np.ndarray, held: np.ndarray, block: int, slices: int) -> Iterator[pa.RecordBatch]:
    """The distinct words and pairs of a block of texts by slice, with how often texts that are not held out have them."""
    learned = np.repeat(~held, np.diff(rows))
    for kind, keys in ((WORDS, tokens), (PAIRS, bigrams(tokens, rows)[1])):
        k, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, learned, len(k)).astype(np.uint32)
        place = slice_of(k, slices)
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(k) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(cut), kind, np.int32)), pa.array(place[cut].astype(np.int32)), pa.array(np.full(len(cut), block)), pa.array([_sent(k[s:e], kind) for s, e in zip(cut, ends, strict=True)], pa.binary()), pa.array([_short(n[s:e]) for s, e in zip(cut, ends, strict=True)], pa.binary())],
            [f.split()[0] for f in _GRAMS.split(", ")],
        )


def _sent(keys: np.ndarray, kind: int) -> bytes:
    return keys.astype("<u8").tobytes() if kind == WORDS else keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _received(packed: bytes, kind: int) -> np.ndarray:
    if kind == WORDS:
        return np.frombuffer(packed, "<u8").astype(np.uint64)
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _short(n: np.ndarray) -> bytes:
    """n (not negative) in as few bytes as hold the largest."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


def _long(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // max(n, 1) or 1}").astype(np.int64)


def merge_grams(table: pa.Table, reply: bool) -> pa.Table:
    """Count the n-grams of one slice over all blocks and build its filter.

    Returns a row with the filter (bits) and, of words, their counts; with reply instead a row
    for each block with the levels that the filter gives for its keys and, of words, the counts.
    """
    kind = table.column("kind")[0].as_py()
    keys = [_received(x, kind) for x in table.column("keys").to_pylist()]
    size = np.array([len(k) for k in keys])
    counts = [_long(x, n) for x, n in zip(table.column("counts").to_pylist(), size, strict=True)]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)  # exact up to 2**53
    bits = filter_slice(distinct, total)
    out = {"kind": [kind], "slice": [table.column("slice")[0].as_py()], "block": [None], "levels": [None], "counts": [None], "bits": [None], "keys": [None], "distinct": [int((total > 0).sum())], "total": [int(total.sum())]}
    if not reply:
        out["bits"] = [bits.tobytes()]
        if kind == WORDS:
            out["keys"], out["counts"] = [distinct[total > 0].tobytes()], [total[total > 0].tobytes()]
    else:
        levels = BloomCounts([bits]).levels(distinct).astype(np.uint8)
        for block, part in zip(table.column("block").to_pylist(), np.split(at, np.cumsum(size)[:-1]), strict=True):
            row = (kind, out["slice"][0], block, levels[part].tobytes(), _short(total[part]) if kind == WORDS else None, None, None, 0, 0)
            for c, v in zip(out.values(), row, strict=True):
                c.append(v)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


@dataclass(frozen=True)
class Tally:
    """What all texts that are learned from hold: tokens and distinct words."""

    tokens: int
    words: int

    @property
    def all_words(self) -> int:
        return self.tokens + self.words + 1


def scores(tokens: np.ndarray, rows: np.ndarray, word_level: Callable[[np.ndarray], np.ndarray], pair_level: Callable[[np.ndarray], np.ndarray], tally: Tally) -> np.ndarray:
    """score of each text: the sum of its tokens' log10 probabilities after the token before."""
    before, pairs = bigrams(tokens, rows)
    word, where = np.unique(np.append(tokens, END), return_inverse=True)  # a first token comes after an end
    level = word_level(word)
    own = (level_floor(level) + 1) / tally.all_words
    high = np.where(level > 0, level_floor(level + 1) - 1, 0)
    where, context = where[:-1], high[np.searchsorted(word, before)]
    pair, pair_at = np.unique(pairs, return_inverse=True)
    # a pair is at most as frequent as its words: so much for false hits
    both = np.minimum(level_floor(pair_level(pair))[pair_at], np.minimum(high[where], context))
    return np.add.reduceat(np.log10((both + PRIOR * own[where]) / (context + PRIOR)), rows[:-1])


def base_scores(tokens: np.ndarray, rows: np.ndarray, counts: Callable[[np.ndarray], np.ndarray], tally: Tally) -> tuple[np.ndarray, np.ndarray]:
    """(n_known, base_score) of each text, by exact counts."""
    word, where = np.unique(tokens, return_inverse=True)
    c = counts(word)
    return np.add.reduceat((c[where] > 0).astype(np.int64), rows[:-1]), np.add.reduceat(np.log10(c + 1.0)[where], rows[:-1]) - np.diff(rows) * np.log10(tally.all_words)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _tally(merged: DataFrame) -> Tally:
    words, tokens = merged.where((F.col("kind") == WORDS) & F.col("block").isNull()).agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Tally(int(tokens), int(words))


_SCORES = "n_tokens long, n_known long, base_score double, score double"


def _scored(ids: pa.Array, held: pa.Array, tokens: np.ndarray, rows: np.ndarray, base: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> list[pa.Array]:
    return [ids, held, pa.array(np.diff(rows)), pa.array(base[0]), pa.array(base[1]), pa.array(score)]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def broadcast_scores(rows: DataFrame, slices: int, kind: str) -> tuple[DataFrame, Tally]:
    """Score by a filter and word counts that are small enough to be broadcast."""
    spark = rows.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_TEXT):
                tokens, starts = token_arrays(batch.column(1).slice(a, b - a))
                yield from gram_rows(tokens, starts, np.zeros(b - a, bool), 0, slices)

    grams = rows.where(~F.col("held_out")).mapInArrow(gather, _GRAMS)
    merged, path = stage(grams.groupBy("kind", "slice").applyInArrow(lambda table: merge_grams(table, False), _MERGED), "lm-merged")
    tally = _tally(merged)
    filters = {k: [np.zeros(8, np.uint8)] * slices for k in (WORDS, PAIRS)}
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, at, bits, words, n in merged.orderBy("kind", "slice").select("kind", "slice", "bits", "keys", "counts").toLocalIterator():  # at most FILTER_BYTES
        filters[k][at] = np.frombuffer(bits, np.uint8)
        if k == WORDS:
            keys.append(np.frombuffer(words, np.uint64))
            counts.append(np.frombuffer(n, np.int64))
    release(spark, path)
    known = spark.sparkContext.broadcast((*(BloomCounts(filters[k]) for k in (WORDS, PAIRS)), np.concatenate(keys), np.concatenate(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, keys, counts = known.value

        def exact(word: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(word), np.int64)
            at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
            return np.where(keys[at] == word, counts[at], 0)

        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_TEXT):
                tokens, starts = token_arrays(batch.column(1).slice(a, b - a))
                found = _scored(batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), tokens, starts, base_scores(tokens, starts, exact, tally), scores(tokens, starts, words.levels, pairs.levels, tally))
                yield pa.RecordBatch.from_arrays(found, ["doc_id", "held_out", *_names(_SCORES)])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, {_SCORES}"), tally


def shuffled_scores(rows: DataFrame, slices: int, kind: str) -> tuple[DataFrame, Tally]:
    """Score by a filter that stays in its slices: the same scores as by broadcast_scores.

    Texts are held as blocks of word numbers. Each block sends its distinct n-grams with their
    counts to the slices, once; a slice adds the counts up, builds its filter, probes it for
    what each block has sent, and answers with a byte for each n-gram.
    """
    spark = rows.sparkSession
    schema = f"block long, ids array<{kind}>, held array<boolean>, starts array<long>, words binary, tokens binary"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_TEXT):
                tokens, starts = token_arrays(batch.column(1).slice(a, b - a))
                words, at = np.unique(tokens, return_inverse=True)
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(starts))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *one, pa.array([words.tobytes()], pa.binary()), pa.array([at.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32).tobytes()], pa.binary())], ["block", "ids", "held", "starts", "words", "tokens"])
                block += 1

    def read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, words = np.array(row["starts"], np.int64), np.frombuffer(row["words"], np.uint64)
        return words[np.frombuffer(row["tokens"], np.uint16 if len(words) <= 1 << 16 else np.uint32)], starts, np.array(row["held"], bool)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "held", "starts", "words", "tokens")}
                yield from gram_rows(*read(row), row["block"], slices)

    numbered, _ = stage(rows.mapInArrow(number, schema), "lm-tokens")
    grams = numbered.select("block", "held", "starts", "words", "tokens").mapInArrow(gather, _GRAMS)
    merged, _ = stage(grams.groupBy("kind", "slice").applyInArrow(lambda table: merge_grams(table, True), _MERGED), "lm-answers")
    tally = _tally(merged)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("slice")
        out = []
        for i in range(len(texts)):
            row = {c: texts.column(c)[i].as_py() for c in ("starts", "words", "tokens", "held")}
            tokens, starts, _ = read(row)
            of = {k: answers.filter(pa.compute.equal(answers.column("kind"), k)) for k in (WORDS, PAIRS)}  # slices are in the order of keys
            words, pairs = (np.frombuffer(b"".join(of[k].column("levels").to_pylist()), np.uint8).astype(np.int64) for k in (WORDS, PAIRS))
            counts = np.concatenate([_long(n, len(k)) for n, k in zip(of[WORDS].column("counts").to_pylist(), of[WORDS].column("levels").to_pylist(), strict=True)])
            found = (base_scores(tokens, starts, lambda _, c=counts: c, tally), scores(tokens, starts, lambda _, w=words: w, lambda _, p=pairs: p, tally))
            ids, held = (texts.column(c).combine_chunks().slice(i, 1).flatten() for c in ("ids", "held"))
            out.append(pa.Table.from_arrays(_scored(ids, held, tokens, starts, *found), ["doc_id", "held_out", *_names(_SCORES)]))
        return pa.concat_tables(out) if out else pa.table({n: [] for n in ["doc_id", "held_out", *_names(_SCORES)]})

    answers = merged.where(F.col("block").isNotNull()).select("kind", "slice", "block", "levels", "counts")
    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, {_SCORES}"), tally


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every row of docs (doc_id, text), learning from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    All training texts are counted, in slices of the key space. base_score uses the exact
    counts. score is a bigram model: the filter gives the level of a pair and of its first
    word; P(w | v) = (low(v w) + PRIOR * P(w)) / (high(v) + PRIOR) with the smallest count of
    the pair's level, the largest of the word's, and P(w) = (low(w) + 1) / (N + V + 1), so that
    quantising never makes the probabilities sum to over 1. The filter holds all n-grams. It
    is broadcast where the texts are so short that it can't exceed FILTER_BYTES (a token adds
    at most a level of a word and one of a pair); else n-grams are sent to its slices.

    Null and empty texts are one end. Rows without a doc_id are training rows; repeated rows
    count each time. Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    slices = max(16, -(-size // SLICE_BYTES))
    most_tokens = size // 2 + 2 * n
    small = 2 * most_tokens * BITS_PER_KEY // 8 <= FILTER_BYTES
    scored, tally = (broadcast_scores if small else shuffled_scores)(rows, slices, kind)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tally.tokens).cast("long").alias("train_tokens"), "base_score", "score")
