"""Near-duplicate documents: an LSH forest of sorted minhash signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.llm.components import components, forest
from massloom.llm.staging import BROADCAST_KEYS, release, semi_by_key, stage
from massloom.llm.words import blocks, give_back, mix, sequence_hash, shingle_hashes, word_hashes

#: The forest: trees (sorted orders), minhashes in each tree's key, and the depth at which regions begin.
TREES, DEPTH, BASE_DEPTH = 16, 8, 2
HASHES = TREES * DEPTH
#: A region of at most this many signatures is compared pair by pair; a larger one is taken deeper, and its
#: signatures are compared with so many next in order at any depth. That links most of a large region; what is
#: left apart in it is compared pair by pair afterwards (see dense_links).
REGION, NEIGHBOURS = 12, 3
#: Signatures planned for one range of the sorted orders, which a task sweeps at once (80 bytes each).
RANGE_ROWS = 1 << 16
#: Signatures of a large region in one chunk; pairs of chunks are compared by separate tasks.
CHUNK = 4096
#: Documents and bytes of shingles in one block; the links between two blocks are confirmed together.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Shingles that are compared as the columns of a matrix at once.
SLAB = 2048
#: Candidates need this similarity by 2-bit sketches of the 128 minhashes, over five standard errors below 0.75.
SKETCH_SIMILARITY = 0.5

_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_LOW_BITS = np.uint64(0x5555555555555555)


def _binary(values: np.ndarray, width: int) -> pa.Array:
    flat = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, flat]).cast(pa.binary())


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column without nulls; of texts of fewer than k words, one hash of all."""
    for a, b in blocks(column):
        words, rows = word_hashes(column.slice(a, b - a))
        runs, ends = shingle_hashes(words, rows, k)
        for i in range(b - a):
            if ends[i] < ends[i + 1]:
                yield np.unique(runs[ends[i] : ends[i + 1]])
            elif rows[i] < rows[i + 1]:
                yield np.array([sequence_hash(words[rows[i] : rows[i + 1]])])
            else:
                yield np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (x[i : i + 2048] * _A + _B).min(axis=1), out=least)
    return least


def sketches(signatures: np.ndarray) -> np.ndarray:
    """The lowest two bits of every minhash, 128 of them in four 64-bit values."""
    bits = (signatures & np.uint32(3)).astype(np.uint8).reshape(len(signatures), -1, 4)
    packed = bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6
    return np.ascontiguousarray(packed).view(np.uint64)


def sketch_similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x ^ y
    differing = np.bitwise_count((d | d >> np.uint64(1)) & _LOW_BITS).sum(axis=1)
    return (1 - differing / HASHES - 0.25) / 0.75


def sweep(tree: np.ndarray, keys: np.ndarray, sketch: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (a < b, similarity by sketch) among signatures sorted by tree, key and id.

    Neighbours' longest common prefixes cut the order into regions. Each region starts at
    BASE_DEPTH and goes deeper until it holds at most REGION signatures.
    """
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.zeros(0)
    same = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    depth = np.full(n, DEPTH + 1)
    for d in range(DEPTH, BASE_DEPTH - 1, -1):
        region = np.concatenate(([0], np.cumsum(prefix < d)))
        depth[np.bincount(region)[region] <= REGION] = d
    left, right = [], []
    shared = np.full(n, DEPTH)
    for j in range(1, min(REGION, n)):
        shared = np.minimum(shared[: n - j], prefix[j - 1 :])
        near = shared >= (np.minimum(depth[: n - j], BASE_DEPTH) if j <= NEIGHBOURS else depth[: n - j])
        at = np.flatnonzero(near)
        left.append(at)
        right.append(at + j)
    i, j = np.concatenate(left), np.concatenate(right)
    similarity = sketch_similarity(sketch[i], sketch[j])
    fit = (similarity >= SKETCH_SIMILARITY) & (ids[i] != ids[j])
    a, b = ids[i[fit]], ids[j[fit]]
    return np.minimum(a, b), np.maximum(a, b), similarity[fit]


def dense_rows(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which sorted signatures are in regions of over REGION at BASE_DEPTH, or in the first or last one, which may go on elsewhere."""
    same = (keys[1:, :BASE_DEPTH] == keys[:-1, :BASE_DEPTH]).all(axis=1) & (tree[1:] == tree[:-1])
    region = np.concatenate(([0], np.cumsum(~same)))
    return (np.bincount(region)[region] > REGION) | (region == 0) | (region == region[-1])


def _signed(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, low, high, signature = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                size.append(len(s))
                m = mix(s)
                low.append(m.sum().view(np.int64))
                high.append(np.bitwise_xor.reduce(mix(m + np.uint64(1))).view(np.int64))
                signature.append(minhashes(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(np.array(x, np.int64)) for x in (size, low, high)), pa.array(signature, pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
            )
        give_back()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, HASHES)
        sketch = _binary(sketches(signatures), HASHES // 4)
        for t in range(TREES):
            key = signatures[:, t * DEPTH : (t + 1) * DEPTH].astype(">u4")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), _binary(key, 4 * DEPTH), batch.column(0), sketch], ["tree", "key", "id", "sketch"])


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u4").reshape(-1, DEPTH)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, HASHES // 32)
    return table.column("tree").to_numpy(), keys, sketch, table.column("id").to_numpy()


_SWEPT = "a long, b long, similarity double, boundary int, tree int, key binary, id long, sketch binary"
#: The boundary of rows that are in a region too large for the sweep (or maybe so, at the ends of a range).
DENSE = -2


def _sweep_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates within one range of the order, the signatures at its two ends for the sweep across boundaries, and those of large regions."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    a, b, similarity = sweep(*_arrays(table))
    n, none = len(a), pa.nulls
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(similarity), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.int64()), none(n, pa.binary())], names=["a", "b", "similarity", "boundary", "tree", "key", "id", "sketch"])
    at = TaskContext.get().partitionId()
    dense = table.filter(pa.array(dense_rows(*_arrays(table)[:2])))
    for boundary, ends in ((at - 1, table.slice(0, REGION)), (at, table.slice(max(0, len(table) - REGION))), (DENSE, dense)):
        n = len(ends)
        if not n:
            continue
        ends = ends.combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), none(n, pa.float64()), pa.array(np.full(n, boundary, np.int32)), *(ends.column(c) for c in ("tree", "key", "id", "sketch"))], names=["a", "b", "similarity", "boundary", "tree", "key", "id", "sketch"])


def _sweep_boundary(table: pa.Table) -> pa.Table:
    table = table.sort_by([("tree", "ascending"), ("key", "ascending"), ("id", "ascending")])
    a, b, similarity = sweep(*_arrays(table))
    return pa.table({"a": a, "b": b, "similarity": similarity})


def _hashed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), k)], pa.binary())], ["id", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((x, y)))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda batches: _similar(batches, percent), "a long, b long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its partition and the sum of the last column before it there."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        cost = np.asarray(batch.column(batch.num_columns - 1))
        before = total + np.cumsum(cost) - cost
        total += int(cost.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(before)], [*batch.schema.names, "part", "before"])


def cut(df: DataFrame, keys: list[str], cost: Column, most: int, name: str, label: str) -> tuple[DataFrame, str]:
    """df in order of keys, with a number (column name) that grows by one each time the costs so far pass a multiple of most, and a staged path.

    Costs are summed in each range of the order, and the ranges' sums run up, so the pieces don't depend on how many ranges there are.
    """
    dealt = df.withColumn("cost", cost.cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt, path = stage(dealt.mapInArrow(_running, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", part int, before long"), label)
    sums = dealt.groupBy("part").agg(F.sum("cost").alias("sum"))
    ahead = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return dealt.join(F.broadcast(ahead), "part").withColumn(name, F.floor((F.col("ahead") + F.col("before")) / most)).drop("part", "before", "cost", "ahead"), path


def _compare_chunks(table: pa.Table) -> pa.Table:
    """Documents that may be similar to one of another component, by the two blocks (x <= y) of such a pair, between two chunks of a region (or within one).

    All pairs are compared, but a document comes once for each block that it must meet, however many pairs there are.
    """
    chunk, ids, root, block = (table.column(c).to_numpy() for c in ("chunk", "id", "root", "block"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    names, at = np.unique(block, return_inverse=True)
    meets = np.zeros((len(ids), len(names)), bool)
    right_sketch, right_root, right_at = sketch[right], root[right], at[right]
    for x in left:
        near = np.flatnonzero((sketch_similarity(sketch[x], right_sketch) >= SKETCH_SIMILARITY) & (right_root != root[x]))
        meets[x, right_at[near]] = True
        meets[right[near], at[x]] = True
    doc, other = np.nonzero(meets)
    return pa.table({"x": np.minimum(block[doc], names[other]), "y": np.maximum(block[doc], names[other]), "id": ids[doc]})


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every set of x and every set of y.

    Elements that many hold are multiplied as matrices, so many columns at once; those of few are counted pair by pair.
    """
    out = np.zeros((len(x), len(y)), np.float32)
    row, word = zip(*((np.repeat(np.arange(len(s)), [len(v) for v in s]), np.concatenate(s)) for s in (x, y)), strict=True)
    words = np.intersect1d(*word)
    if not len(words):
        return out
    sides = []
    for r, w in zip(row, word, strict=True):
        at = np.minimum(np.searchsorted(words, w), len(words) - 1)
        fit = words[at] == w
        order = np.argsort(at[fit], kind="stable")
        sides.append((r[fit][order], at[fit][order]))
    held = [np.bincount(w, minlength=len(words)) for _, w in sides]
    often = held[0] * held[1] > out.size // 256
    columns = np.flatnonzero(often)
    for s in range(0, len(columns), SLAB):
        part = columns[s : s + SLAB]
        place = np.full(len(words), -1)
        place[part] = np.arange(len(part))
        dense = []
        for (r, w), n in zip(sides, out.shape, strict=True):
            m = np.zeros((n, len(part)), np.float32)
            k = place[w] >= 0
            m[r[k], place[w[k]]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    rare = ~often[sides[0][1]]
    r, w = sides[0][0][rare], sides[0][1][rare]
    first = np.cumsum(held[1]) - held[1]
    n = held[1][w]
    done = np.concatenate(([0], np.cumsum(n)))
    a = 0
    while a < len(r):
        b = max(a + 1, int(np.searchsorted(done, done[a] + (1 << 20), "right")) - 1)
        place = np.arange(done[b] - done[a]) + np.repeat(first[w[a:b]] - done[a:b] + done[a], n[a:b])
        out += np.bincount(np.repeat(r[a:b], n[a:b]) * len(y) + sides[1][0][place], minlength=out.size).reshape(out.shape)
        a = b
    return out


def confirm_block(table: pa.Table, percent: int) -> pa.Table:
    """Links between the documents of two blocks x and y (id, block, root, shingles) that join different components: a forest of them."""
    ids, block, root = (table.column(c).to_numpy() for c in ("id", "block", "root"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("shingles").chunks for x in c]
    left, right = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("x", "y"))
    if not len(left) or not len(right):
        return pa.table({"a": ids[:0], "b": ids[:0]})
    common = common_counts([sets[k] for k in left], [sets[k] for k in right])
    sizes = np.array([len(x) for x in sets])
    similar = 100 * common >= percent * (sizes[left][:, None] + sizes[right] - common)
    i, j = np.nonzero(similar & (root[left][:, None] != root[right]))
    a, b = forest(ids[left[i]], ids[right[j]])
    return pa.table({"a": a, "b": b})


def dense_links(dense: DataFrame, roots: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components (roots: node, root) in the large regions of all trees: rows tree, key, id, sketch; sizes: id, n_shingles.

    All pairs of a region in different components are compared by sketch, and those that may
    be similar on full sets. A region is ordered by component and cut into chunks, so pairs of
    chunks of one component cost nothing, and pairs of chunks are spread over the tasks. Documents of
    like regions are in the same blocks. Sketches only tell which documents two blocks must
    compare; all these are then compared at once, so that rows grow with documents and blocks, not with pairs.
    """
    spark = dense.sparkSession
    region = ["tree", "region"]
    placed, placed_path = stage(dense.join(roots, F.col("id") == F.col("node"), "left").select("tree", F.substring("key", 1, 4 * BASE_DEPTH).alias("region"), "id", "sketch", F.coalesce("root", "id").alias("root")), "near-dense")
    apart = placed.groupBy(*region).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*region)
    open_, open_path = stage(placed.join(apart, region, "left_semi"), "near-open")
    home = open_.groupBy("id").agg(F.min(F.xxhash64(*region)).alias("home"))
    block, block_path = cut(home.join(sizes, "id"), ["home", "id"], F.greatest(F.col("n_shingles") * 8, F.lit(BLOCK_BYTES // BLOCK_DOCS)), BLOCK_BYTES, "block", "near-blocks")
    block = block.select("id", "block")
    live, live_path = cut(open_.join(block, "id").select(*region, "id", "root", "block", "sketch"), [*region, "root", "id"], F.lit(1), CHUNK, "chunk", "near-live")
    release(spark, placed_path)
    chunks = live.groupBy(*region, "chunk").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    pairs = chunks.select(*region, F.col("chunk").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i")).join(chunks.select(*region, F.col("chunk").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j")), region)
    pairs = pairs.where("i <= j and least(low_i, low_j) <> greatest(high_i, high_j)")
    members = pairs.select(*region, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk")).join(live, [*region, "chunk"])
    needed, needed_path = stage(members.groupBy(*region, "i", "j").applyInArrow(_compare_chunks, "x long, y long, id long").distinct(), "near-apart")
    ends, ends_path = stage(needed.select("id").distinct(), "near-ends")
    hashed = semi_by_key(texts, ends, F.col("doc_id") == F.col("id")).mapInArrow(lambda batches: _hashed(batches, k), "id long, shingles binary")
    root = live.groupBy("id").agg(F.first("root").alias("root"))
    sets, sets_path = stage(hashed.join(block, "id").join(root, "id"), "near-hashed")
    links, _ = stage(needed.join(sets, "id").groupBy("x", "y").applyInArrow(lambda table: confirm_block(table, percent), "a long, b long"), "near-third")
    release(spark, open_path, block_path, live_path, needed_path, ends_path, sets_path)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Link documents (doc_id, text) whose sets of k-word shingles have a Jaccard similarity of percent / 100 or more.

    Returns a row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable over links), kept (doc_id = component_id).

    Equal sets are one node from the start, so groups of copies of any size cost one
    signature. Nodes' signatures are sorted in TREES orders; candidates are neighbours by
    longest common prefix (see sweep), linear in the number of nodes. Each node's best
    candidate among smaller ids is confirmed first; what candidates then still join two
    components are confirmed, too. Links are confirmed on full sets; two sets at the
    threshold are missed as candidates by all trees with a probability of about 1e-6.

    Null and empty texts have an empty set and are linked with nothing; rows without a
    doc_id are returned with a null component_id. Rows repeating a doc_id are linked as
    their texts are. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed, signed_path = stage(_signed(texts, k), "near-signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    nodes, nodes_path = stage(usable.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("first")).select("set_a", "set_b", F.col("first.doc_id").alias("id"), F.col("first.n_shingles").alias("n_shingles"), F.col("first.signature").alias("signature")), "near-nodes")

    rows, rows_path = stage(nodes.select("id", "signature").mapInArrow(_forest_rows, "tree int, key binary, id long, sketch binary"), "near-forest")
    ranges = max(1, -(-TREES * nodes.count() // RANGE_ROWS))
    swept, swept_path = stage(rows.repartitionByRange(ranges, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").mapInArrow(_sweep_partition, _SWEPT), "near-swept")
    release(spark, rows_path)
    across = swept.where(f"boundary <> {DENSE}").groupBy("boundary").applyInArrow(_sweep_boundary, "a long, b long, similarity double")
    found = swept.where("a is not null").select("a", "b", "similarity").unionByName(across)
    pairs, pairs_path = stage(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "near-pairs")
    dense, dense_path = stage(swept.where(f"boundary = {DENSE}").select("tree", "key", "id", "sketch"), "near-large")
    release(spark, swept_path)

    ends, ends_path = stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "near-ends")
    sets, sets_path = stage(semi_by_key(texts, ends, F.col("doc_id") == F.col("id")).mapInArrow(lambda batches: _hashed(batches, k), "id long, shingles binary"), "near-sets")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("similarity", F.xxhash64("a", "b"))).alias("a"))
    first, first_path = stage(confirm(best, sets, percent), "near-first")
    roots, used = components(first, "near-first")
    to = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")}
    apart = pairs.join(to["a"], "a", "left").join(to["b"], "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    apart = apart.join(best.select("a", "b"), ["a", "b"], "left_anti")
    second, second_path = stage(confirm(apart, sets, percent), "near-second")
    release(spark, sets_path, pairs_path, ends_path, *used)
    known = first.unionByName(second)
    roots, used = components(known, "near-swept-all")
    third = dense_links(dense, roots, nodes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), texts, k, percent)
    if not third.isEmpty():
        release(spark, *used)
        roots, _ = components(known.unionByName(third), "near-all")
    release(spark, first_path, second_path, dense_path)

    members = nodes.select("set_a", "set_b", "id").join(roots, F.col("id") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("root", "id").alias("root"))
    linked = usable.select("doc_id", "n_shingles", "set_a", "set_b").join(members, ["set_a", "set_b"]).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each group of near_duplicates, the one of the smallest id. All columns stay; rows without a doc_id stay."""
    dropped, _ = stage(near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct(), "near-dropped")
    few = dropped.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(dropped) if few else dropped, docs["doc_id"].cast("long") == dropped["dropped_id"], "left_anti")
