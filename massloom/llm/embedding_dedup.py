"""Exact near-duplicate vectors: blocks of cover trees, traversed in pairs and pruned by covering radii."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.components import components
from massloom.llm.staging import release, stage

#: Expected vectors of a sample by hash, whose own cover tree gives the order in which all vectors are dealt into blocks; lengths of at most so many vectors are one block.
PIVOTS = 1024
#: Vectors in a block, and the most blocks; beyond BLOCK * MOST_BLOCKS vectors, blocks grow. MOST_BLOCKS bounds the centres that are broadcast.
BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 4096, 16, 4096
#: Radii of the nested levels under a block's root; below the last, members are compared at once.
LEVELS = (1.0, 0.5, 0.25)
_ROUNDING = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cover_levels(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the rows of x (unit vectors) in which each level's nodes are contiguous, and the nodes' first rows by level.

    Each node is split greedily into nodes of the next radius: its first member, then the
    first member not within that radius of a chosen one, and so on; a node's first row is
    its centre, and the centre of its first child.
    """
    order = np.arange(len(x))
    bounds = np.array([0, len(x)])
    starts = []
    for radius in LEVELS:
        least_cosine = 1 - radius * radius / 2
        new_order, cuts = [], [0]
        for a, b in zip(bounds, bounds[1:], strict=False):
            rest = order[a:b]
            if len(rest) > 64 and len(starts) == 0:
                rest = rest[np.argsort(-(x[rest] @ x[rest[0]]), kind="stable")]
            while len(rest):
                near = x[rest] @ x[rest[0]] >= least_cosine if len(rest) > 1 else np.ones(1, bool)
                near[0] = True
                new_order.append(rest[near])
                cuts.append(cuts[-1] + int(near.sum()))
                rest = rest[~near]
        order, bounds = np.concatenate(new_order), np.array(cuts)
        starts.append(bounds[:-1])
    return order, starts


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class Tree:
    """One block's cover tree: vectors in tree order, and by level the nodes' bounds and covering radii."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, starts: list[np.ndarray]):
        self.ids, self.weights, self.x, self.raw = ids, weights, units(raw), raw
        self.starts = starts
        self.ends = [np.append(s[1:], len(ids)) for s in starts]
        self.radius = []
        for s, e in zip(self.starts, self.ends, strict=True):
            distance = chord(np.einsum("ij,ij->i", self.x, np.repeat(self.x[s], e - s, axis=0)))
            self.radius.append(np.where(e - s == 1, 0.0, np.maximum.reduceat(distance, s) + _ROUNDING))
        self.child = [np.searchsorted(b, a) for a, b in zip(self.starts, self.starts[1:], strict=False)]


def node_pairs(p: Tree, q: Tree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of last-level nodes of p and q that may hold vectors within reach of each other."""
    i_all, j_all = [], []
    a, b = p.x[p.starts[0]], q.x[q.starts[0]]
    for k in range(0, len(a), 512):
        distance = a[k : k + 512] @ b.T
        # chord(c) <= bound is c >= 1 - bound**2 / 2
        widest = reach + p.radius[0][k : k + 512].max() + q.radius[0].max()
        i, j = np.nonzero(distance >= 1 - widest * widest / 2 - _ROUNDING)
        keep = chord(distance[i, j]) <= reach + p.radius[0][k + i] + q.radius[0][j] + _ROUNDING
        i_all.append(i[keep] + k)
        j_all.append(j[keep])
    i, j = np.concatenate(i_all), np.concatenate(j_all)
    for level in range(1, len(LEVELS)):
        pi, qj = np.append(p.child[level - 1], len(p.starts[level])), np.append(q.child[level - 1], len(q.starts[level]))
        i_all, j_all = [], []
        for k in range(0, len(i), 4096):
            left, right = i[k : k + 4096], j[k : k + 4096]
            ni, nj = pi[left + 1] - pi[left], qj[right + 1] - qj[right]
            many = ni * nj
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            inner = np.repeat(nj, many)
            ci, cj = np.repeat(pi[left], many) + at // inner, np.repeat(qj[right], many) + at % inner
            for s in range(0, len(ci), 1 << 16):
                u, v = ci[s : s + (1 << 16)], cj[s : s + (1 << 16)]
                d = chord(np.einsum("ij,ij->i", p.x[p.starts[level][u]], q.x[q.starts[level][v]]))
                keep = d <= reach + p.radius[level][u] + q.radius[level][v] + _ROUNDING
                i_all.append(u[keep])
                j_all.append(v[keep])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i_all, j_all))
    return i, j


def links(p: Tree, q: Tree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Weighted link counts of p's and q's vectors, and edges (ids) that connect all that is linked between them."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _ROUNDING
    n_p, n_q = np.zeros(len(p.ids), np.int64), np.zeros(len(q.ids), np.int64)
    edges = []
    last = len(LEVELS) - 1
    for u, v in zip(*node_pairs(p, q, reach), strict=True):
        if same and u > v:
            continue
        a, b = slice(p.starts[last][u], p.ends[last][u]), slice(q.starts[last][v], q.ends[last][v])
        own = same and u == v
        between = 0.0 if own else float(chord(p.x[a.start] @ q.x[b.start]))
        if between + p.radius[last][u] + q.radius[last][v] <= reach - 8 * _ROUNDING:
            # so near that all are linked with all
            n_p[a] += q.weights[b].sum() - (p.weights[a] if own else 0)
            if not own:
                (n_p if same else n_q)[b] += p.weights[a].sum()
            ids = np.unique(np.concatenate([p.ids[a], q.ids[b]]))
            edges.append((ids, np.full(len(ids), ids[0])))
            continue
        for k in range(a.start, a.stop, 2048):
            r = slice(k, min(k + 2048, a.stop))
            cosine = p.x[r] @ q.x[b].T
            linked = cosine >= threshold
            for i, j in np.argwhere(np.abs(cosine - threshold) < _ROUNDING):
                x, y = p.raw[r][i], q.raw[b][j]
                linked[i, j] = (x @ y) / math.sqrt((x @ x) * (y @ y)) >= threshold
            if same and u == v:
                linked[np.arange(r.stop - r.start), np.arange(r.start - b.start, r.stop - b.start)] = False
            rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(rows):
                continue
            n_p[r] += linked @ q.weights[b]
            if not (same and u == v):
                (n_p if same else n_q)[b] += p.weights[r] @ linked
            sub = linked[np.ix_(rows, columns)]
            row_ids, column_ids = p.ids[r][rows], q.ids[b][columns]
            far = np.iinfo(np.int64).max
            at_row, at_column = row_ids.copy(), column_ids.copy()
            while True:
                new_row = np.minimum(at_row, np.where(sub, at_column, far).min(axis=1))
                new_column = np.minimum(at_column, np.where(sub, new_row[:, None], far).min(axis=0))
                if (new_row == at_row).all() and (new_column == at_column).all():
                    break
                at_row, at_column = new_row, new_column
            edges += [(row_ids, at_row), (column_ids, at_column)]
    return n_p, n_q, edges


def _scaled(v: np.ndarray) -> np.ndarray:
    """v, or a power of two times v where its squares would leave the range of doubles."""
    top = np.abs(v).max()
    return v if 1e-140 < top < 1e140 else np.ldexp(v, -int(np.frexp(top)[1]))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of usable vectors as bytes of doubles; null for the others."""
    for batch in batches:
        out = []
        for x in batch.column(1):
            v = None if not x.is_valid or x.values.null_count else np.asarray(x.values, np.float64)
            out.append(_scaled(v).tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Link all pairs of vectors (vec_id, embedding) with a cosine of at least threshold (over 0), and no others.

    Returns a row per input row: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Equal vectors are one node with a weight. Nodes are dealt into equal blocks along the
    order of a cover tree over a bounded sample; every block has a cover tree with nested
    levels of halving radii. Pairs of blocks, then of nodes level by level, are dropped when
    the centres' distance less both covering radii exceeds the threshold's chord; members
    of what is left are compared in double precision. Vectors of different lengths are
    never linked. Squares that would leave the range of doubles are scaled first.

    Null or zero vectors, and those with null or non-finite components, link with nothing;
    rows without a vec_id are counted as none and returned with a null component_id. Rows
    repeating a vec_id count as separate vectors in n_links. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    read, _ = stage(vectors.select("vec_id", "embedding").mapInArrow(_usable, "vec_id long, vector binary"), "vectors")
    usable = read.where("vector is not null and vec_id is not null")
    nodes, nodes_path = stage(usable.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).withColumn("size", F.octet_length("vector")), "vector-nodes")
    counted, paths = [], [nodes_path]
    # every length listed has over PIVOTS vectors
    sizes = nodes.groupBy("size").agg(F.count("*").alias("n"))
    large = [r[0] for r in sizes.where(F.col("n") > PIVOTS).select("size").collect()]
    for size in large:
        counted.append(_linked(nodes.where(F.col("size") == size), size // 8, threshold, paths))
    counted.append(_linked_small(nodes.where(~F.col("size").isin(large)) if large else nodes, threshold))
    none = spark.createDataFrame([], "id long, n long, other long")
    linked = none
    for x in counted:
        linked = linked.unionByName(x)
    linked, linked_path = stage(linked, "vector-links")
    roots, _ = components(linked.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), "vector")
    n_links = linked.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    known = nodes.join(n_links, "id", "left").join(roots, F.col("id") == F.col("node"), "left").select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = usable.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = read.where("vector is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _pairs(n_p: np.ndarray, p_ids: np.ndarray, n_q: np.ndarray, q_ids: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """Columns id, n, other: link counts (other is null), and edges (n is 0)."""
    ids = np.concatenate([p_ids, q_ids, *(e[0] for e in edges)])
    count = np.concatenate([n_p, n_q, *(np.zeros(len(e[0]), np.int64) for e in edges)])
    other = np.concatenate([np.full(len(p_ids) + len(q_ids), -1), *(e[1] for e in edges)])
    is_count = np.arange(len(ids)) < len(p_ids) + len(q_ids)
    keep = np.where(is_count, count > 0, other != ids)
    return [pa.array(ids[keep]), pa.array(count[keep]), pa.array(other[keep], mask=is_count[keep])]


def _linked_small(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links among vectors of each length of at most PIVOTS vectors: one block a length, so any number of lengths is one job."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw, ids = _matrix(table.column("vector").combine_chunks()), table.column("id").to_numpy()
        order, starts = cover_levels(units(raw))
        tree = Tree(ids[order], table.column("weight").to_numpy()[order], raw[order], starts)
        n_p, n_q, edges = links(tree, tree, threshold, True)
        return pa.table(_pairs(n_p, tree.ids, n_q, tree.ids, edges), names=["id", "n", "other"])

    return nodes.groupBy("size").applyInArrow(compare, "id long, n long, other long")


def _linked(nodes: DataFrame, width: int, threshold: float, paths: list[str]) -> DataFrame:
    spark = nodes.sparkSession
    n = nodes.count()
    # about PIVOTS rows by a hash of the id: each is expected with PIVOTS in n
    sample = nodes.where(F.pmod(F.xxhash64("id"), F.lit(n)) < PIVOTS).select("id", "vector").toArrow().sort_by("id").combine_chunks()
    pivots = units(_matrix(sample.column("vector").combine_chunks()))
    pivots = pivots[cover_levels(pivots)[0]]
    known = spark.sparkContext.broadcast(pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                place = (units(_matrix(batch.column(0))) @ known.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], ["vector", "id", "weight", "place"])

    size = max(-(-n // LEAST_BLOCKS), 1) if n <= BLOCK * LEAST_BLOCKS else max(BLOCK, -(-n // MOST_BLOCKS))
    placed = nodes.select("vector", "id", "weight").mapInArrow(near, "vector binary, id long, weight long, place int")
    counts = dict(placed.groupBy("place").count().collect())
    ahead = np.cumsum([0, *(counts.get(k, 0) for k in range(len(pivots)))])
    # a pivot's vectors spread evenly by hash over the blocks that its share of the order covers
    first = F.element_at(F.lit([float(x) for x in ahead]), F.col("place") + 1)
    share = F.element_at(F.lit([float(x) for x in np.diff(ahead)]), F.col("place") + 1)
    block = F.floor((first + share * (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20))) / size).cast("int")

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("place", "ascending"), ("id", "ascending")]).combine_chunks()
        raw = _matrix(table.column("vector").combine_chunks())
        x = units(raw)
        order, starts = cover_levels(x)
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1)).max() + _ROUNDING
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                "ids": [table.column("id").to_numpy()[order].tobytes()],
                "weights": [table.column("weight").to_numpy()[order].tobytes()],
                "vectors": [raw[order].astype(np.float32).tobytes() if (raw == raw.astype(np.float32)).all() else raw[order].tobytes()],
                "starts": [b"".join(np.array([len(s), *s], np.int64).tobytes() for s in starts)],
                "centre": [centre.tobytes()],
                "radius": [radius],
            }
        )

    blocks, path = stage(placed.withColumn("block", block).groupBy("block").applyInArrow(build, "block int, ids binary, weights binary, vectors binary, starts binary, centre binary, radius double"), "vector-blocks")
    paths.append(path)
    heads = blocks.select("block", "centre", "radius").orderBy("block").collect()  # at most MOST_BLOCKS (and a few more)
    centres = spark.sparkContext.broadcast((np.array([h[0] for h in heads]), np.array([np.frombuffer(h[1], np.float64) for h in heads]), np.array([h[2] for h in heads])))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _ROUNDING

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, where, radius = centres.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                k = int(np.flatnonzero(names == b)[0])
                fit = np.sqrt(((where - where[k]) ** 2).sum(axis=1)) <= reach + radius + radius[k]
                others = names[fit & (names >= b)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), b, np.int32)), pa.array(others.astype(np.int32))], ["p", "q"])

    def tree(row: dict, side: str) -> Tree:
        ids = np.frombuffer(row[f"{side}_ids"], np.int64)
        vectors = row[f"{side}_vectors"]
        raw = np.frombuffer(vectors, np.float32 if len(vectors) == 4 * width * len(ids) else np.float64).astype(np.float64).reshape(len(ids), width)
        flat, starts = np.frombuffer(row[f"{side}_starts"], np.int64), []
        while len(flat):
            starts.append(flat[1 : 1 + flat[0]])
            flat = flat[1 + flat[0] :]
        return Tree(ids, np.frombuffer(row[f"{side}_weights"], np.int64), raw, starts)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                p, same = tree(row, "p"), row["p"] == row["q"]
                q = p if same else tree(row, "q")
                n_p, n_q, edges = links(p, q, threshold, same)
                yield pa.RecordBatch.from_arrays(_pairs(n_p, p.ids, n_q, q.ids, edges), ["id", "n", "other"])

    def sided(side: str) -> DataFrame:
        return blocks.select(F.col("block").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("ids", "weights", "vectors", "starts")))

    tasks = blocks.select("block").mapInArrow(partners, "p int, q int")
    # a row is one pair of blocks: dealt out one by one, as each is much work
    spread = max(spark.sparkContext.defaultParallelism, min(len(heads) * (len(heads) + 1) // 2, 4 * spark.sparkContext.defaultParallelism))
    return tasks.join(sided("p"), "p").join(sided("q"), "q").repartition(spread).mapInArrow(traverse, "id long, n long, other long")
