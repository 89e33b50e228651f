"""Best-fit packing of token sequences by bulk-synchronous rounds of sweeps over ranges of sizes."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.staging import fresh_names, release, stage
from massloom.llm.token_counts import byte_letters
from massloom.llm.words import blocks, give_back, range_hashes, string_bytes

#: Pre-tokens whose ids a task keeps; when full it starts anew. Affects speed only.
CACHE_PRETOKENS = 200_000


class PretokenEncoder:
    """Ids of whole texts as the tokenizers library gives them, from the ids of each distinct pre-token.

    In plain texts (see plain_rows) numpy finds the pre-tokens of a whole block and puts their
    ids together; the merges of a pre-token are done by tiktoken, with the ranks of the
    vocabulary file. Other texts, and all texts if the file's ids aren't its ranks, go to the
    tokenizers library as they are.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        # texts without any special string's first characters need no search
        self.hint = os.path.commonprefix(special).encode() if special else None
        self.merger = rank_merger(path)
        self.forget()

    @cached_property
    def tokenizer(self):  # noqa: ANN201
        """The library's tokenizer, read where the first text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column without nulls, ids before each text: rows + 1)."""
        data, ends = string_bytes(column)
        kind = byte_kinds(data)
        easy = plain_rows(kind, ends)
        if self.merger is None:
            easy[:] = False
        elif self.hint is not None and data.tobytes().find(self.hint) >= 0:
            easy &= np.array([not self.special.search(t) for t in column.to_pylist()], bool)
        rows = np.flatnonzero(easy)
        ids, own = self.plain(data, kind, ends, rows)
        if own is None:  # two pre-tokens of one hash
            easy[:] = False
            ids, own, rows = np.zeros(0, np.uint32), np.zeros(0, np.int64), rows[:0]
        counts = np.zeros(len(column), np.int64)
        parts: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(~easy).tolist():
            parts[i] = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
            counts[i] = len(parts[i])
        counts[rows] = own
        before = np.concatenate(([0], np.cumsum(counts)))
        if not parts:
            return ids, before
        out = np.empty(before[-1], np.uint32)
        out[np.repeat(easy, counts)] = ids
        for i, x in parts.items():
            out[before[i] : before[i + 1]] = x
        return out, before

    def plain(self, data: np.ndarray, kind: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(ids of the given rows one after another, their counts); no counts if two pre-tokens have the same hash."""
        begin, end, row = pretokens(kind, ends)
        mine = np.zeros(len(ends) - 1, bool)
        mine[rows] = True
        if not mine.all():
            keep = mine[row]
            begin, end, row = begin[keep], end[keep], row[keep]
        hashes = range_hashes(data, begin, end)
        _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        if not same_bytes(data, begin, end, first[at]):
            return np.zeros(0, np.uint32), None
        if len(self.slots) > CACHE_PRETOKENS:
            self.forget()
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        slot = list(map(self.slots.get, keys))
        new = [i for i, s in enumerate(slot) if s is None]
        if new:
            found = [self.merger(keys[i].decode()) for i in new]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))))
            for i in new:
                slot[i] = self.slots[keys[i]] = len(self.slots)
        used = np.array(slot, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        size = self.size[used]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.start[used] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.bincount(row, size, len(ends) - 1).astype(np.int64)[rows]


def rank_merger(path: str) -> Callable[[str], list[int]] | None:
    """Merges of one pre-token by tiktoken, if the file is a byte-level vocabulary whose ids are in the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    kinds = [spec.get("pre_tokenizer") or {}]
    if model.get("type") != "BPE" or spec.get("normalizer") or kinds[0].get("type") != "ByteLevel" or kinds[0].get("add_prefix_space") or not kinds[0].get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get("".join(p)) for p in pairs]
    if len(ranks) != 256 + len(made) or any(i != 256 + k for k, i in enumerate(made)):
        return None
    return tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def same_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each range has the same bytes as the range at place `like`."""
    size = end - begin
    if (size[like] != size).any():
        return False
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return bool((data[place] == data[place + np.repeat(begin[like] - begin, size)]).all())


_LETTER, _DIGIT, _OTHER, _BLANK, _LINE, _ODD = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[32], _KIND[10] = _BLANK, _LINE
_KIND[[*range(0, 10), *range(11, 32), 39, 127, *range(128, 256)]] = _ODD  # control bytes, the apostrophe, and beyond ASCII


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte; letters from U+00C0 to U+00FF (0xC3 and a byte, but for two signs) are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = _LETTER
    kind[lead + 1] = _LETTER
    return kind


def plain_rows(kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows without odd bytes and with single spaces and line ends as the only white space."""
    white = (kind == _BLANK) | (kind == _LINE)
    bad = kind == _ODD
    bad[1:] |= white[1:] & white[:-1]
    total = np.concatenate(([0], np.cumsum(bad)))
    return total[ends[1:]] == total[ends[:-1]]


def pretokens(kind: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row) of the byte-level pre-tokens of plain rows: runs of one kind, each with a space before it."""
    if not len(kind):
        return (np.zeros(0, np.int64),) * 3
    begins = np.ones(len(kind), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & ((kind[:-1] != _BLANK) | (kind[1:] == _LINE))
    begins[ends[:-1][ends[:-1] < len(kind)]] = True
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(kind))
    return begin, end, np.searchsorted(ends, begin, "right") - 1


@lru_cache(1)
def encoder_of(vocabulary: str) -> PretokenEncoder:
    """One encoder a worker process; a task leaves no pre-tokens in it, as workers outlive tasks and count as memory."""
    return PretokenEncoder(vocabulary)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, block_bytes: int = 1 << 19) -> DataFrame:
    """Pieces of at most capacity ids of every document and its end_id: doc_id, piece, start, length, ids_crc32.

    Only documents of more than capacity ids are cut; their first piece takes what is left
    over, so that all others are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            at: list[int] = []
            rows: list[tuple[int, int, int, int]] = []
            for a, b in blocks(texts, block_bytes):
                found, before = encoder.encode(texts.slice(a, b - a))
                for k, (s, e) in enumerate(zip(before.tolist(), before[1:].tolist(), strict=False), a):
                    ids = np.append(found[s:e], np.uint32(end_id)).astype("<u4").tobytes()
                    total = e - s + 1
                    bounds = [0, *range(total % capacity or capacity, total + 1, capacity)]
                    for piece, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        at.append(k)
                        rows.append((piece, x, y - x, zlib.crc32(ids[4 * x : 4 * y])))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        encoder.forget()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


_RUN_ROW = "kind int, size int, first long, n long, per long, sequence long, offset int"
_PIECES, _GAPS, _PLACED = 0, 1, 2
#: Pieces of which fewer than so many fit into a sequence open sequences in rounds of their own.
CLASSES = 6
#: Ranges of sizes that are swept apart.
RANGES = 8


def best_fit(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int) -> tuple[list, list, list]:
    """Sweep the runs of one range of sizes: (pieces left, gaps left, placed).

    pieces: runs (length, first rank, n); gaps: runs (gap, first sequence, n). From the longest
    length down, a run of pieces goes to its successor among the gaps, the smallest that
    fits; conflicts among its pieces are resolved by rank (`per` neighbours share a gap); the
    gaps are updated, and what is left of the run goes to the next successor. placed: runs
    (length, first rank, n, per, first sequence, offset).
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    left, placed = [], []

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(sizes, gap)
            runs[gap].append((first, n))

    for gap in sorted(gaps, reverse=True):
        give(*gap)
    for length, rank, total in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while total:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                left.append((length, rank, total))
                break
            gap = sizes[i]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], sizes[i]
            per = gap // length
            full = min(n, total // per)
            if full:
                placed.append((length, rank, full * per, per, first, capacity - gap))
                rank, total = rank + full * per, total - full * per
                give(gap - per * length, first, full)
            rest = min(total, per) if full < n else 0
            if rest:
                placed.append((length, rank, rest, rest, first + full, capacity - gap))
                rank, total = rank + rest, total - rest
                give(gap - rest * length, first + full, 1)
            give(gap, first + full + bool(rest), n - full - bool(rest))
    return left, [(gap, first, n) for gap, found in runs.items() for first, n in found], placed


def _sweep(table: pa.Table, capacity: int) -> pa.Table:
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "size", "first", "n")), strict=True))
    left, gaps, placed = best_fit([r[1:] for r in rows if r[0] == _PIECES], [r[1:] for r in rows if r[0] == _GAPS], capacity)
    out = [(_PIECES, *x, 0, 0, 0) for x in left] + [(_GAPS, *x, 0, 0, 0) for x in gaps] + [(_PLACED, *x) for x in placed]
    columns = zip(*out, strict=True) if out else [()] * 7
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in _RUN_ROW.split(", ")])


def best_fit_rounds(runs: DataFrame, capacity: int) -> DataFrame:
    """Placements (kind = _PLACED) of all runs of pieces (_RUN_ROW), by bulk-synchronous rounds.

    Equal pieces, and sequences with equal gaps, are one row, so both tables have thousands of
    rows whatever the input's size. In a round the longest pieces left open sequences of their
    own: those of which as few fit into a sequence as of the longest, or those of more than
    half its length if these are many; then pieces and
    gaps are dealt to ranges of sizes, each swept by best_fit on its own. What finds no gap in
    its range meets what is left of all ranges, a row for each run, in one more sweep. The
    next round takes the pieces that no gap fits.
    """
    spark = runs.sparkSession
    now, path = stage(runs, "packing-runs")
    opened = 0
    done: list[DataFrame] = []
    while (longest := now.where(F.col("kind") == _PIECES).agg(F.max("size")).first()[0]) is not None:
        pieces = now.where(F.col("kind") == _PIECES)
        # a row for each length at least; ranks of one length are dealt out in order
        share = capacity // longest
        least = capacity // (share + 1) + 1 if share < CLASSES else longest // 2 + 1
        opening = pieces.where(F.col("size") >= least).orderBy(F.desc("size"), "first").collect()  # thousands at most
        placed, gaps = [], []
        for r in opening:
            per = capacity // r.size
            full, rest = divmod(r.n, per)
            for n, each, first in ((full, per, r.first), (1 if rest else 0, rest, r.first + full * per)):
                if n:
                    placed.append((_PLACED, r.size, first, n * each, each, opened, 0))
                    if capacity > each * r.size:
                        gaps.append((_GAPS, capacity - each * r.size, opened, n, 0, 0, 0))
                    opened += n
        rows = now.where((F.col("kind") == _GAPS) | ((F.col("kind") == _PIECES) & (F.col("size") < least)))
        if gaps:
            rows = rows.unionByName(spark.createDataFrame(gaps, _RUN_ROW))
        for width in (max(1, capacity // RANGES), capacity):
            swept = rows.where(F.col("kind") != _PLACED).groupBy(F.floor((F.col("size") - 1) / width)).applyInArrow(lambda table: _sweep(table, capacity), _RUN_ROW)
            rows = rows.where(F.col("kind") == _PLACED).unionByName(swept)
        after, after_path = stage(rows.unionByName(spark.createDataFrame(placed, _RUN_ROW)), "packing-runs")
        done.append(after.where(F.col("kind") == _PLACED))
        release(spark, *([path] if len(done) == 1 else []))
        now = after.where(F.col("kind") != _PLACED)
    return reduce(DataFrame.unionByName, done) if done else now


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (with a column length, 1 to capacity) so that few sequences are needed.

    The pieces are range-sorted by length; ranks within a length follow from each range's
    own order and the ranges' counts (as many rows as ranges and lengths together). Repeated
    rows are packed each. An empty table gives an empty result; other columns are kept,
    except that columns named sequence_id and offset are overwritten.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    part_name, place_name = fresh_names(pieces.columns, "part", "place")
    keyed, keyed_path = stage(pieces, "packing-pieces")
    names = keyed.columns
    at_length = names.index("length")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            length = np.asarray(batch.column(at_length))
            starts = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1]))) if len(length) else np.zeros(0, int)
            n = np.diff(np.append(starts, len(length)))
            place = np.arange(len(length)) - np.repeat(starts, n)
            for s, k in zip(starts.tolist(), n.tolist(), strict=True):
                place[s : s + k] += seen[int(length[s])]
                seen[int(length[s])] += k
            yield batch.append_column(place_name, pa.array(place, pa.int64()))

    key = F.xxhash64(*names)  # deals out a run of equal lengths
    ranged = keyed.repartitionByRange("length", key).withColumn(part_name, F.spark_partition_id()).sortWithinPartitions("length")
    at_part = len(names)
    ranged = ranged.mapInArrow(places, _ddl(ranged) + f", `{place_name}` bigint")
    ranged, _ = stage(ranged, "packing-ranged")
    release(spark, keyed_path)
    counts = ranged.groupBy("length", part_name).count().orderBy("length", part_name).collect()
    totals: Counter = Counter()
    before: dict[tuple[int, int], int] = {}
    for length, part, n in counts:
        before[length, part] = totals[length]
        totals[length] += n
    runs = spark.createDataFrame([(_PIECES, int(length), 0, n, 0, 0, 0) for length, n in totals.items()], _RUN_ROW)
    plan: dict[int, list[tuple]] = {}
    for x in best_fit_rounds(runs, capacity).orderBy("size", "first").toLocalIterator():  # thousands of rows
        plan.setdefault(x.size, []).append((x.first, x.per, x.sequence, x.offset))
    known = spark.sparkContext.broadcast((before, {k: np.array(v, np.int64).T for k, v in plan.items()}))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, rounds = known.value
        for batch in batches:
            length, part, place = (np.asarray(batch.column(i)) for i in (at_length, at_part, at_part + 1))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            both = length * (1 << 32) + part
            for k in np.unique(both):
                rows = np.flatnonzero(both == k)
                n = int(k >> 32)
                low, per, first, filled = rounds[n]
                rank = place[rows] + offsets[n, int(k & 0xFFFFFFFF)]
                i = np.searchsorted(low, rank, "right") - 1
                sequence[rows] = first[i] + (rank - low[i]) // per[i]
                offset[rows] = filled[i] + (rank - low[i]) % per[i] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_part], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranged.mapInArrow(assign, _ddl(keyed) + ", sequence_id bigint, offset bigint")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenise docs (doc_id, text), cut what is longer than capacity, and pack all pieces.

    Null and empty texts are their end_id alone. Returns a row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset.
    """
    return pack(token_pieces(docs, vocabulary, end_id, capacity), capacity)
