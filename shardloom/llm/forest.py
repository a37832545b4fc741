"""Forests of random-projection trees over vectors, for nearest-neighbour search and for near-duplicates.

Each inner node of a tree has a random direction and, as its threshold, the median of a sample's projections that
reach it. The upper levels are fitted on a bounded sample and go to the tasks with their code. Where the table needs
more than MAX_DEPTH levels for leaves of LEAF_ROWS rows, each leaf's own subtree is fitted on a sample of the leaf by
Spark, its thresholds meet the leaf's rows as a row ahead of them, and so on, level by level: leaves keep their size
however large the table is. A leaf that still holds many rows is cut into blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch, components

#: Rows that a forest is fitted on, at most.
SAMPLE = 20_000
LEAF_ROWS = 512
MAX_DEPTH = 10
BLOCK = 2048


@dataclass
class Forest:
    """Trees in heap order: node i has children 2i+1 and 2i+2."""

    depth: int
    directions: np.ndarray  # trees, nodes, dimensions
    thresholds: np.ndarray  # trees, nodes
    spill: float = 0.0

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int, seed: int | list[int], spill: float = 0.0) -> Forest:
        """Of ``depth`` levels, or fewer if the sample has less than 8 rows for a leaf."""
        depth = max(0, min(depth, int(math.log2(max(1, len(sample) / 8)))))
        nodes = (1 << depth) - 1
        directions = cls.draw(trees, nodes, sample.shape[1], seed)
        thresholds = np.zeros((trees, nodes))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for i in range(nodes):
                here = node == i
                if here.any():
                    p = sample[here] @ directions[t, i]
                    thresholds[t, i] = np.median(p)
                    node[here] = 2 * i + 1 + (p > thresholds[t, i])
        return cls(depth, directions, thresholds, spill)

    @staticmethod
    def draw(trees: int, nodes: int, dim: int, seed: int | list[int]) -> np.ndarray:
        directions = np.random.default_rng(seed).standard_normal((trees, nodes, dim))
        return directions / (np.linalg.norm(directions, axis=2, keepdims=True) if nodes else 1)

    @property
    def leaves(self) -> int:
        return self.directions.shape[0] << self.depth

    def margins(self, unit: np.ndarray) -> np.ndarray:
        """rows, trees, nodes: the signed distance of each row to each node's plane."""
        return np.einsum("rd,tnd->rtn", unit, self.directions, optimize=True) - self.thresholds[None]

    def deal(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: every row is in one leaf of each tree, or in more where it lies within ``spill`` of a plane."""
        margins, inner = self.margins(unit), (1 << self.depth) - 1
        rows, leaves = [], []
        for t in range(self.directions.shape[0]):
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                m = margins[row, t, node]
                right, left = m > -self.spill if self.spill else m > 0, m <= self.spill
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            leaves.append((t << self.depth) + node - inner)
        return np.concatenate(rows), np.concatenate(leaves)

    def search(self, unit: np.ndarray, budget: int) -> Iterator[list[tuple[int, float]]]:
        """For each row the first ``budget`` leaves of all trees by one shared queue, with their keys.

        A node's key is the squared distance that the planes on its path prove; the other side of a node is queued
        with its own plane's distance added.
        """
        inner = (1 << self.depth) - 1
        for m in self.margins(unit):
            queue = [(0.0, t, 0) for t in range(len(m))]
            found: list[tuple[int, float]] = []
            while queue and len(found) < budget:
                cost, t, node = heapq.heappop(queue)
                while node < inner:
                    x = m[t, node]
                    near = 2 * node + 1 + (x > 0)
                    heapq.heappush(queue, (cost + x * x, t, 4 * node + 3 - near))
                    node = near
                found.append(((t << self.depth) + node - inner, cost))
            yield found


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part: of the dimension, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame, col: str = "embedding") -> int:
    """The most frequent dimension, the larger one at a tie."""
    sizes = vectors.where(F.size(col) > 0).groupBy(F.size(col).alias("d")).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d")).alias("x")).first()
    return top.x.d if top.x else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / np.where(scale > 0, scale, 1)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, rows: int, dim: int, depth: int, trees: int, seed: int, spill: float = 0.0) -> Forest:
    """A forest fitted on SAMPLE rows at most of ``vectors`` (embedding), which has ``rows`` rows."""
    part = vectors.select("embedding")
    if rows > SAMPLE:
        part = part.sample(fraction=min(1.0, 1.1 * SAMPLE / rows), seed=seed).limit(SAMPLE)
    sample = np.array([r[0] for r in part.collect()], np.float64).reshape(-1, dim)
    return Forest.fit(unit(sample) if len(sample) else sample, depth, trees, seed, spill)


def levels(rows: int, leaf_rows: int = LEAF_ROWS, most: int = MAX_DEPTH) -> list[int]:
    """Depths of the parts of trees, from the top, that give leaves of ``leaf_rows`` rows."""
    depth, out = max(0, round(math.log2(max(1, rows) / leaf_rows))), []
    while depth > 0 or not out:
        out.append(min(depth, most))
        depth -= out[-1]
    return out


_DEALT = "leaf long, vec_id long, embedding array<double>, asks boolean, cost double"
_AHEAD = f"{_DEALT}, ahead binary"


def _leaves_of(forest: Forest, x: np.ndarray, asks: np.ndarray, cost: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, cost): all rows by the leaves that they are in, queries by those that they search."""
    row, leaf = forest.deal(x[~asks])
    rows, leaves, costs = [np.flatnonzero(~asks)[row]], [leaf], [np.zeros(len(row))]
    at = np.flatnonzero(asks)
    for i, found in zip(at.tolist(), forest.search(x[at], budget) if len(at) else (), strict=True):
        rows.append(np.full(len(found), i))
        leaves.append(np.array([f for f, _ in found], np.int64))
        costs.append(cost[i] + np.array([c for _, c in found]))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(costs)


def _emit(part: pa.RecordBatch, row: np.ndarray, leaf: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding, asks in the columns 1 to 3 of ``part``) with their leaves."""
    for a in range(0, len(row), 10_000):
        at = pa.array(row[a : a + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(leaf[a : a + 10_000], pa.int64()), *(part.column(i).take(at) for i in (1, 2, 3)), pa.array(cost[a : a + 10_000])], ["leaf", "vec_id", "embedding", "asks", "cost"])


def _place(forest: Forest, dim: int, budget: int):
    """The rows of (leaf, vec_id, embedding, asks, cost) by their leaves of a whole forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                asks = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                yield from _emit(part, *_leaves_of(forest, unit(matrix(part.column(2), dim)), asks, part.column(4).to_numpy(zero_copy_only=False), budget))

    return run


def _subtree(dim: int, depth: int, seed: int):
    """The thresholds of one leaf's subtree, from a sample of the leaf, as the row that goes ahead of its rows."""

    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        forest = Forest.fit(unit(matrix(table.column("embedding").combine_chunks(), dim)), depth, 1, [seed, leaf])
        row = {"leaf": leaf, "vec_id": None, "embedding": None, "asks": False, "cost": None, "ahead": forest.thresholds.astype("<f8").tobytes()}
        return pa.Table.from_pylist([row], schema=table.schema.append(pa.field("ahead", pa.binary())))

    return run


def _deepen(dim: int, depth: int, seed: int, spill: float, budget: int):
    """Rows sorted by leaf, each leaf's thresholds ahead, to the leaves of its subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, of = None, None
        for batch in batches:
            leaves, ahead = batch.column(0).to_numpy(), batch.column(5)
            for lo in [0, *(np.flatnonzero(leaves[1:] != leaves[:-1]) + 1).tolist()] if len(batch) else []:
                hi = lo + int(np.searchsorted(leaves[lo:], leaves[lo], side="right"))
                while lo < hi:
                    if ahead[lo].is_valid:
                        thresholds = np.frombuffer(ahead[lo].as_py(), "<f8")[None]
                        of, nodes = int(leaves[lo]), thresholds.shape[1]
                        forest = Forest((nodes + 1).bit_length() - 1, Forest.draw(1, nodes, dim, [seed, of]), thresholds, spill)
                        lo += 1
                        continue
                    part = batch.slice(lo, min(hi - lo, 2000))
                    lo += len(part)
                    asks = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                    sub = forest if of == leaves[lo - 1] else Forest(0, np.zeros((1, 0, dim)), np.zeros((1, 0)), spill)
                    row, leaf, cost = _leaves_of(sub, unit(matrix(part.column(2), dim)), asks, part.column(4).to_numpy(zero_copy_only=False), budget)
                    yield from _emit(part, row, (int(leaves[lo - 1]) << depth) + leaf, cost)

    return run


def deal_to_leaves(scratch: Scratch, vectors: DataFrame, rows: int, dim: int, trees: int, seed: int, spill: float = 0.0, leaf_rows: int = LEAF_ROWS, most: int = MAX_DEPTH, budget: int = 0) -> tuple[DataFrame, int]:
    """(leaf, vec_id, embedding, asks, cost of all rows of ``vectors``, how many leaves there are).

    Rows that ask are given the ``budget`` leaves with the least keys of one queue over all trees: a part of a tree
    gives the least of each leaf above, and the least of all parts are those that one queue would have reached.
    """
    depths = levels(rows, leaf_rows, most)
    forest = fit(vectors.where("not asks"), rows, dim, depths[0], trees, seed, spill)
    leaves = forest.leaves << sum(depths[1:])
    dealt = vectors.select(F.lit(0).cast("long").alias("leaf"), "vec_id", "embedding", "asks", F.lit(0.0).alias("cost")).mapInArrow(_place(forest, dim, budget or leaves), _DEALT)
    held = forest.leaves
    for i, depth in enumerate(depths[1:], 1):
        dealt = scratch.keep(dealt)
        share = min(1.0, 16.0 * (1 << depth) * held / max(1, rows * trees))
        some = dealt.where(~F.col("asks") & (F.pmod(F.xxhash64(F.lit(i), "vec_id", "leaf"), F.lit(1_000_000)) < int(share * 1_000_000)))
        ahead = some.groupBy("leaf").applyInArrow(_subtree(dim, depth, seed + i), _AHEAD)
        both = dealt.withColumn("ahead", F.lit(None).cast("binary")).union(ahead)
        both = both.repartition("leaf").sortWithinPartitions("leaf", F.col("ahead").isNull())
        dealt = both.mapInArrow(_deepen(dim, depth, seed + i, spill, budget or leaves), _DEALT)
        held <<= depth
        if budget:
            place = F.row_number().over(Window.partitionBy("vec_id").orderBy("cost", "leaf"))
            kept = dealt.where("asks").withColumn("_i", place).where(F.col("_i") <= budget).drop("_i")
            dealt = dealt.where("not asks").union(kept)
    return dealt, leaves


# nearest neighbours


def _nearest(k: int):
    """The ``k`` nearest nodes of a block for each node that asks, itself included, ties to the smaller id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, asks = pdf[~pdf["asks"]].sort_values("vec_id"), pdf[pdf["asks"]]
        out: dict[str, list] = {"query": [], "node": [], "score": []}
        if len(rows) and len(asks):
            ids, x = rows.vec_id.to_numpy(), unit(np.stack(rows.embedding.to_numpy()).astype(np.float64))
            for lo in range(0, len(asks), 256):
                part = asks.iloc[lo : lo + 256]
                q = unit(np.stack(part.embedding.to_numpy()).astype(np.float64))
                near = q @ x.T
                kth = -np.partition(-near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                for i, query in enumerate(part.vec_id):
                    at = np.flatnonzero(near[i] >= kth[i] - 1e-12)
                    score = (x[at] * q[i]).sum(axis=1)  # the same sum for equal vectors, wherever they are
                    best = np.lexsort((ids[at], -score))[:k]
                    out["query"] += [query] * len(best)
                    out["node"] += ids[at][best].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query": "int64", "node": "int64", "score": "float64"})

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 5, trees: int = 8, share: float = 0.15, leaves: int | None = None, seed: int = 3, most: int = MAX_DEPTH, leaf_rows: int = LEAF_ROWS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row where ``queries`` holds.

    Nearness is the cosine in double precision; ties go to the smaller id, and a query's own id is no candidate. Each
    query visits ``share`` of all leaves, or ``leaves`` of them, in the order of one queue over all trees; every row of
    a visited leaf is scored exactly. Equal vectors are one node with its k + 1 smallest ids, more can't be among the
    nearest, and are searched for once. Vectors that are null, zero, of another dimension than most, or have null or
    non-finite components take no part, nor do rows with a null id; an id's rows count once, with the least of their vectors. Fewer rows than
    ``k`` give what there is. Other columns don't matter, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    dim = max(1, dimension(named))
    rows = named.where(usable(F.col("embedding"), dim) & F.col("vec_id").isNotNull())
    rows = scratch.keep(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")))
    # limited before the shuffle: no more than k + 1 rows of a vector leave a task
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    first = first.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = scratch.keep(first)
    wanted = rows.where("asks").join(nodes.select("embedding", "node"), "embedding").select(F.col("vec_id").alias("query_id"), "node")
    wanted = scratch.keep(wanted)
    n = nodes.count()
    both = nodes.select(F.col("node").alias("vec_id"), "embedding", F.lit(False).alias("asks"))
    asking = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("vec_id"), "embedding", F.lit(True).alias("asks"))
    total = trees << sum(levels(n, leaf_rows, most))
    budget = max(1, leaves if leaves else math.ceil(share * total))
    dealt, _ = deal_to_leaves(scratch, scratch.keep(both.union(asking)), n, dim, trees, seed, 0.0, leaf_rows, most, budget)
    both = scratch.keep(dealt.select("leaf", "vec_id", "embedding", "asks"))
    blocks = both.groupBy("leaf").agg(F.ceil(F.count(F.when(~F.col("asks"), 1)) / BLOCK).cast("int").alias("nr"), F.ceil(F.count(F.when(F.col("asks"), 1)) / BLOCK).cast("int").alias("nq"))
    blocks = blocks.where("nr > 0 and nq > 0")
    spot = lambda m: F.array(F.pmod(F.xxhash64("vec_id"), F.col(m)).cast("int"))
    every = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    placed = both.join(blocks, "leaf")
    placed = placed.withColumn("i", F.explode(F.when(F.col("asks"), every("nr")).otherwise(spot("nr"))))
    placed = placed.withColumn("j", F.explode(F.when(F.col("asks"), spot("nq")).otherwise(every("nq")))).drop("nr", "nq")
    found = placed.groupBy("leaf", "i", "j").applyInPandas(_nearest(k + 1), "query long, node long, score double")
    found = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    # of each node the k + 1 nearest ids: its own may be among them
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    found = found.withColumn("_i", place).where(F.col("_i") <= k + 1).join(nodes.select("node", "ids"), "node")
    found = found.select("query", (-F.col("score")).alias("minus"), F.explode("ids").alias("vec_id"))
    found = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("minus", "vec_id"))).alias("top"))
    best = wanted.join(found, wanted.node == found.query)
    out = best.select("query_id", F.posexplode(F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


# near-duplicates


def _earlier(leaf: int, *sides: list) -> list[np.ndarray]:
    """For each row of some sides the leaves before ``leaf`` that several rows are in, as bits."""
    n = [len(x) for side in sides for x in side]
    row, flat = np.repeat(np.arange(len(n)), n), np.concatenate([np.asarray(x, np.int64) for side in sides for x in side])
    row, flat = row[flat < leaf], flat[flat < leaf]
    names, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    slot = np.cumsum(count > 1) - 1
    held = np.zeros((len(n), max(1, int((count > 1).sum()))), np.uint8)
    use = (count > 1)[code]
    held[row[use], slot[code[use]]] = 1
    packed = np.packbits(held, axis=1)
    return np.split(packed, np.cumsum([len(side) for side in sides])[:-1])


def _linked(threshold: float):
    """For each vector of a block pair: copies linked in this leaf and in no earlier one, and the smallest linked id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = (int(pdf[c].iloc[0]) for c in ("leaf", "i", "j"))
        left, right = (pdf[pdf.own == s] if i != j else pdf for s in (i, j))
        out = []
        if len(left) and len(right):
            a, b = (unit(np.stack(p.embedding.to_numpy()).astype(np.float64)) for p in (left, right))
            bits = _earlier(leaf, left.leaves.tolist(), right.leaves.tolist())
            ids, copies = [p.vec_id.to_numpy() for p in (left, right)], [p.copies.to_numpy() for p in (left, right)]
            sums, least = [np.zeros(len(p), np.int64) for p in (left, right)], [x.copy() for x in ids]
            for lo in range(0, len(a), 256):
                x, y = np.nonzero(a[lo : lo + 256] @ b.T >= threshold)
                x += lo
                apart = ids[0][x] != ids[1][y]
                x, y = x[apart], y[apart]
                for c in range(0, len(x), 1 << 16):  # bounded memory where all are linked
                    p, q = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
                    np.minimum.at(least[0], p, ids[1][q])
                    np.minimum.at(least[1], q, ids[0][p])
                    new = ~(bits[0][p] & bits[1][q]).any(axis=1)
                    np.add.at(sums[0], p[new], copies[1][q[new]])
                    if i != j:
                        np.add.at(sums[1], q[new], copies[0][p[new]])
            for s in (0, 1) if i != j else (0,):
                hit = (sums[s] > 0) | (least[s] < ids[s])
                out.append(pd.DataFrame({"vec_id": ids[s][hit], "links": sums[s][hit], "least": least[s][hit]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("vec_id", "links", "least")})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, trees: int = 4, seed: int = 9, most: int = MAX_DEPTH, leaf_rows: int = LEAF_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Rows are linked when their cosine in double precision is at least ``threshold``. A forest whose splits overlap
    proposes pairs: a row within the spill of a plane goes to both sides, so that a tree parts a pair at the threshold
    with a chance of about 0.7 % a level. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable. Equal vectors are one node with a count, and links are counted where they are found, in
    the first leaf that has both, never listed. Vectors that are null, zero, of another dimension than most, or have
    null or non-finite components stay alone, as do rows with a null id (component null, kept); repeated rows share their
    component, and an id's other vectors are linked with it as other rows would be, but not counted. Other columns
    don't matter, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession, "vector-dedup")
    named = scratch.keep(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")))
    dim = max(1, dimension(named))
    live = usable(F.col("embedding"), dim) & F.col("vec_id").isNotNull()
    nodes = scratch.keep(named.where(live).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "embedding", "copies"))
    n = nodes.count()
    spill = 0.76 * math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(dim)
    dealt, _ = deal_to_leaves(scratch, nodes.select("vec_id", "embedding", F.lit(False).alias("asks")), n, dim, trees, seed, spill, leaf_rows, most)
    leaves = scratch.keep(dealt.select("vec_id", "leaf").groupBy("vec_id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")))
    blocks = leaves.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    placed = nodes.join(leaves, "vec_id").select("*", F.explode("leaves").alias("leaf")).join(blocks, "leaf")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = placed.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).drop("o", "nb")
    found = scratch.keep(placed.groupBy("leaf", "i", "j").applyInPandas(_linked(threshold), "vec_id long, links long, least long"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    group = components(scratch, found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")).where("a <> b"))
    marks = nodes.join(links, "vec_id", "left").join(group, nodes.vec_id == group.node, "left")
    marks = marks.select(F.col("embedding").alias("_e"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    out = named.join(marks, (named.embedding == marks["_e"]) & live, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
