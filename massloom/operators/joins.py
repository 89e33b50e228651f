"""Joins by tolerance, by nearness, by offset and by membership."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of peptides, all together, up to which each task holds them as one tree of prefixes (some 20 MB there), and letters of
#: sequences that are looked up in it at once.
TREE_LETTERS, BLOCK_LETTERS = 250_000, 1 << 20


def merged_windows(offsets: Sequence[float], half_width: float) -> list[tuple[float, float]]:
    """Mass windows around offsets, those that touch as one."""
    out: list[tuple[float, float]] = []
    for o in sorted(offsets):
        low, high = o - half_width, o + half_width
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: Column, high: Column, width: float, salt: int = 1) -> DataFrame:
    """Join points to ranges with low <= point <= high by bins of the given width, which both sides are dealt by.

    A range is copied to each bin that it touches, a point is in one bin, so no pair comes
    twice. With salt > 1, points of a bin are dealt over that many tasks and ranges copied to
    each: for bins that hold much of all points. Both sides are shuffled: a broadcast is chosen by the size before
    rows are copied to bins, and so may be many times larger than it seems.
    """
    bins = F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))
    left = points.withColumn("_bin", F.floor(F.col(point) / width).cast("long"))
    right = ranges.withColumn("_low", low).withColumn("_high", high).withColumn("_bin", F.explode(bins))
    keys = ["_bin"]
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salt)))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        keys.append("_salt")
    return left.join(right.hint("merge"), keys).where(F.col(point).between(F.col("_low"), F.col("_high"))).drop(*keys, "_low", "_high")


def multi_window_join(scans: DataFrame, peptides: DataFrame, scan_mass: str, peptide_mass: str, offsets: Sequence[float], half_width: float) -> DataFrame:
    """Scans whose mass lies in any of the windows around a peptide's mass; each pair once, however windows touch."""
    windows = merged_windows(offsets, half_width)
    spread = peptides.withColumn("_w", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows))))
    joined = range_join(scans, spread, scan_mass, F.col(peptide_mass) + F.col("_w.a"), F.col(peptide_mass) + F.col("_w.b"), 2 * half_width)
    return joined.drop("_w")


def best_in_tolerance(queries: DataFrame, peaks: DataFrame, key: Sequence[str], query: str, peak: str, tolerance: float, best: Sequence[Column], row: Sequence[str], strict: bool = False) -> DataFrame:
    """For each query (columns row) the first peak by `best` of those of its key within tolerance; queries without are absent."""
    left = queries.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(query) / tolerance).cast("long") + d for d in (-1, 0, 1)))))
    right = peaks.withColumn("_bin", F.floor(F.col(peak) / tolerance).cast("long"))
    distance = F.abs(F.col(query) - F.col(peak))
    near = left.hint("merge").join(right, [*key, "_bin"]).where(distance < tolerance if strict else distance <= tolerance).drop("_bin")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(*row).orderBy(*best))).where("_r = 1").drop("_r")


def at_offset(df: DataFrame, by: Sequence[str], order: Sequence[Column], offset: int, columns: Sequence[str], suffix: str) -> DataFrame:
    """Each row with the given columns of the row `offset` places on in its group (null beyond the ends)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *(F.lead(c, offset).over(w).alias(c + suffix) for c in columns))


def first_use(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; later ones find it used."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def merge_lists(df: DataFrame, key: Sequence[str], item: str, name: str) -> DataFrame:
    """Sorted distinct items of each key."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(item)).alias(name))


def missing_keys(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of left that right lacks: where a lookup must be complete, none may be left."""
    return left.select(*key).distinct().join(right.select(*key).distinct(), list(key), "left_anti")


def peptides_in_proteins(proteins: DataFrame, peptides: DataFrame, k: int = 6) -> DataFrame:
    """(protein_id, peptide) where the protein's seq holds the peptide: joined by the peptide's first k residues, then compared.

    Peptides of fewer than k residues are joined by runs of their own length.
    """

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("seq") - n + 1, F.lit(1)))
        return F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("seq", i, F.lit(n)))))

    long = peptides.where(F.length("peptide") >= k).withColumn("_k", F.substring("peptide", 1, k))
    out = proteins.select("protein_id", "seq", runs(k).alias("_k")).join(long, "_k").where(F.expr("instr(seq, peptide) > 0")).select("protein_id", "peptide")
    for n in range(1, k):
        part = peptides.where(F.length("peptide") == n)
        out = out.unionByName(proteins.select("protein_id", runs(n).alias("peptide")).join(part, "peptide").select("protein_id", "peptide"))
    return out.distinct()


def all_in_tolerance(queries: DataFrame, peaks: DataFrame, key: Sequence[str], query: str, peak: str, tolerance: float) -> DataFrame:
    """Each query with every peak of its key that is nearer than tolerance."""
    left = queries.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(query) / tolerance).cast("long") + d for d in (-1, 0, 1)))))
    right = peaks.withColumn("_bin", F.floor(F.col(peak) / tolerance).cast("long"))
    return left.hint("merge").join(right, [*key, "_bin"]).where(F.abs(F.col(query) - F.col(peak)) < tolerance).drop("_bin")


def at_levels(scans: DataFrame, levels: int = 100) -> DataFrame:
    """Each scan once for each enrichment level from 0 on: the workload of a sweep, made row by row without a join."""
    return scans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))


def unbraced(df: DataFrame, group: str, item: str) -> DataFrame:
    """A row for each item of a group text {a,b}; a text without braces is its only item."""
    return df.withColumn(item, F.explode(F.split(F.regexp_replace(group, r"^\{|\}$", ""), ",")))


def kmers(text: Column, k: int) -> Column:
    """Distinct runs of k letters of a text, found in one pass; none of a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def rarest_kmers(proteins: DataFrame, peptides: DataFrame, k: int = 6) -> DataFrame:
    """Peptides of k letters or more with their rarest run of k: peptide, kmer, holders (proteins that hold it).

    Peptides with a run that no protein holds are left out, as nothing can hold them.
    """
    wanted = peptides.select("peptide").distinct().select("peptide", F.explode(kmers(F.col("peptide"), k)).alias("kmer"))
    held = proteins.select("protein_id", F.explode(kmers(F.col("seq"), k)).alias("kmer")).join(wanted.select("kmer").distinct(), "kmer", "left_semi")
    counts = held.groupBy("kmer").agg(F.count("*").alias("holders"))
    best = wanted.join(counts, "kmer", "left").groupBy("peptide").agg(F.min(F.struct(F.coalesce("holders", F.lit(0).cast("long")).alias("holders"), "kmer")).alias("best"))
    return best.where("best.holders > 0").select("peptide", "best.kmer", "best.holders")


class PrefixTree:
    """Texts as a tree of their UTF-8 bytes, nodes by depth, and all places of others at which they begin."""

    def __init__(self, texts: Sequence[str]) -> None:
        parts = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        starts = np.cumsum(lengths) - lengths
        # 0: any byte that no text has; UTF-8 has fewer than 255
        self.kind = np.zeros(256, np.uint8)
        self.kind[np.unique(data)] = np.arange(1, len(np.unique(data)) + 1)
        self.kinds = int(self.kind.max(initial=0)) + 1
        children, self.text = [], np.full(int(lengths.sum()) + 1, -1)
        node, n = np.zeros(len(texts), np.int64), 1
        for depth in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > depth)
            edge, which = np.unique(node[on] * self.kinds + self.kind[data[starts[on] + depth]], return_inverse=True)
            children.append((edge, n + np.arange(len(edge))))
            node[on] = n + which
            n += len(edge)
            self.text[node[on[lengths[on] == depth + 1]]] = on[lengths[on] == depth + 1]
        self.child = np.zeros(n * self.kinds, np.int32)
        for edge, below in children:
            self.child[edge] = below
        self.text = self.text[:n]

    def found(self, data: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of all texts that begin at places from first to before last of data (kinds of bytes, a 0 at the end)."""
        at = np.arange(first, last)
        node = self.child[data[first:last]]
        places, texts, depth = [], [], 1
        while True:
            alive = np.flatnonzero(node)
            at, node = at[alive], node[alive]
            if not len(at):
                break
            text = self.text[node]
            ends = np.flatnonzero(text >= 0)
            places.append(at[ends])
            texts.append(text[ends])
            # a path ends at the 0 behind its sequence, so none runs over the end
            node = self.child[node.astype(np.int64) * self.kinds + data[at + depth]]
            depth += 1
        none = [np.zeros(0, np.int64)]
        return np.concatenate(places or none), np.concatenate(texts or none)


def few_in_proteins(proteins: DataFrame, peptides: Sequence[str]) -> DataFrame:
    """(protein_id, peptide) where the protein's seq holds the peptide, for few peptides (distinct, none empty): sequences stay where they are."""
    kind = proteins.schema["protein_id"].dataType.simpleString()
    names = list(peptides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known = PrefixTree(names), pa.array(names, pa.string())
        for b in batches:
            seqs = [s.encode() for s in b.column("seq").to_pylist()]
            lengths = np.array([len(s) + 1 for s in seqs], np.int64)
            starts = np.cumsum(lengths) - lengths
            data = tree.kind[np.frombuffer(b"\0".join([*seqs, b""]), np.uint8)]
            data[starts + lengths - 1] = 0
            for first in range(0, len(data), BLOCK_LETTERS):
                place, text = tree.found(data, first, min(first + BLOCK_LETTERS, len(data)))
                pairs = np.unique((np.searchsorted(starts, place, "right") - 1) * len(names) + text)
                yield pa.RecordBatch.from_arrays([b.column("protein_id").take(pa.array(pairs // len(names))), known.take(pa.array(pairs % len(names)))], ["protein_id", "peptide"])

    return proteins.where("seq <> ''").select("protein_id", "seq").mapInArrow(run, f"protein_id {kind}, peptide string")


def peptide_search(proteins: DataFrame, peptides: DataFrame, k: int = 6, most_letters: int = TREE_LETTERS) -> DataFrame:
    """(protein_id, peptide) where the protein's seq holds the peptide; each pair once.

    Peptides of up to TREE_LETTERS letters in all are one tree in each task, down which sequences are followed where they are. Beyond
    that both sides are shuffled: a peptide is looked for only in the proteins that hold its rarest run of k letters, so that a run
    that all proteins share brings no pairs together. Sequences are joined to these candidates last.
    Shorter peptides are joined by runs of their own length. Null and empty peptides and
    sequences match nothing; repeated rows count once.
    """
    whole = proteins.where("protein_id is not null and seq is not null")
    wanted = peptides.where("peptide <> ''").select("peptide").distinct()
    if (wanted.agg(F.sum(F.octet_length("peptide"))).first()[0] or 0) <= most_letters:
        return few_in_proteins(whole, [r.peptide for r in wanted.collect()]).distinct()
    keys = rarest_kmers(whole, wanted.where(F.length("peptide") >= k), k)
    held = whole.select("protein_id", F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    near = held.join(keys.select("kmer", "peptide"), "kmer").select("protein_id", "peptide").distinct()
    out = whole.select("protein_id", "seq").join(near, "protein_id").where(F.expr("instr(seq, peptide) > 0")).select("protein_id", "peptide")
    for n in range(1, k):
        part = wanted.where(F.length("peptide") == n)
        out = out.unionByName(whole.select("protein_id", F.explode(kmers(F.col("seq"), n)).alias("peptide")).join(part, "peptide").select("protein_id", "peptide"))
    return out.distinct()
