"""Token counts by rank-synchronous merging of pre-tokens held as ragged numpy arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker keeps; when full it starts anew. Affects speed only.
CACHE_WORDS = 400_000
#: Characters that str.split() takes for white space and the vocabulary's pattern does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class RankMerger:
    """Byte-pair merges with an end-of-word suffix, applied to many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["byte_fallback"]:
            raise ValueError(f"{path}: not a plain BPE vocabulary")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = len(vocab)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), made
        self.counts: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """Pieces of a text without special strings, after NFC and lower case."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def merged_counts(self, pretokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token. In every round each sequence merges all places of its lowest-rank pair."""
        if not pretokens:
            return np.zeros(0, np.int64)
        raw = [p.encode() for p in pretokens]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), size)
        result = np.ones(len(raw), np.int64)
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank_of[at], none)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(np.append(rank, none), starts)
            length = np.diff(np.append(starts, len(owner)))
            alive = lowest < none
            result[owner[starts[~alive]]] = length[~alive]
            if not alive.any():
                return result
            hit = rank == np.repeat(lowest, length)[:-1]
            hit &= rank < none
            where = np.flatnonzero(hit)
            fresh = np.concatenate(([True], np.diff(where) != 1))  # a run of overlapping places merges every other one
            run_start = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))]
            where = where[(where - run_start) % 2 == 0]
            symbols[where] = self.made[rank[where]]
            keep = np.repeat(alive, length)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            result[owner] = 1
        return result

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        parts: list[tuple[int, list[str], list[int | None]]] = []
        new: dict[str, None] = {}
        known = self.counts.get
        for text in texts:
            special = len(self.special_pattern.findall(text)) if "<|" in text else 0
            words: list[str] = []
            for piece in self.special_pattern.split(text) if special else [text]:
                words += self.pretokens(piece) if _ODD_SPACE.search(piece) else piece.split()
            counts = list(map(known, words))
            if None in counts:
                new.update((w, None) for w, n in zip(words, counts, strict=True) if n is None)
            parts.append((special, words, counts))
        if new:
            fresh = self.word_counts(list(new))
            if len(self.counts) + len(fresh) > CACHE_WORDS:
                self.counts.clear()
            self.counts.update(fresh)
            for _, words, counts in parts:
                if None in counts:
                    counts[:] = [fresh[w] if n is None else n for w, n in zip(words, counts, strict=True)]
        return [special + sum(counts) for special, _, counts in parts]

    def word_counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word (no white space inside)."""
        pieces = [self.pretokens(w) for w in words]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        total = np.concatenate(([0], np.cumsum(self.merged_counts([x for p in pieces for x in p]))))
        return dict(zip(words, np.diff(total[np.concatenate(([0], ends))]).tolist(), strict=True))


@lru_cache(1)
def merger_of(vocabulary: str) -> RankMerger:
    """One merger a worker process, so that its counts serve all its tasks."""
    return RankMerger(vocabulary)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    stands = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [stands[b] for b in range(256)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int, block_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs (doc_id, text).

    vocabulary is the path of a BPE vocabulary file, on every worker. Null and empty texts
    have 0 bytes and 0 tokens; null ids and repeated rows come out as they went in; other
    columns are ignored; an empty table gives an empty result. Whole texts are counted,
    about block_chars characters at a time (one longer text alone).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            held: list[str] = []
            chars = 0
            for text in texts:
                held.append(text)
                chars += len(text)
                if chars >= block_chars:
                    counts += merger.count(held)
                    held, chars = [], 0
            counts += merger.count(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    known = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
