"""Near-duplicate texts by bottom-k sketches.

One hash function gives each document the k smallest hashes of its word shingles. Inverted lists over the retained
values that any sufficiently similar partner must share propose pairs, the sketch of the union estimates their
Jaccard similarity, and the whole shingle sets decide.

A group of many copies never becomes all its pairs: equal sets are one node, each list is compared with one hub (its
most typical member), long lists that still join several components with hubs outside their largest one as long as
that joins components, and what is then left is compared in blocks, the members outside the largest component against
all: sketches first, then the whole sets of those that have a likely partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch, components
from shardloom.llm.textbytes import mix, shingle_sets

#: The chance that a pair right at the threshold shares too few retained values to be proposed, or is misjudged.
MISS = 1e-7
#: Members of lists that hang together and are compared at once, at most, whatever that saves; and of one side of a block of sketches.
BLOCK = 2048
#: A list is long, and gets further hubs, with more members.
LONG = 512
#: Shingles on one side of a block of whole sets, about, beside those of one text.
BLOCK_SHINGLES = 200_000
#: Members of one side whose overlaps with a block's other side are held at once, and pairs counted at once, about.
STRIPE, PAIRS = 256, 1_000_000
#: A value that more than one in so many pairs share is counted by a product of matrices.
DENSE = 50
#: A list's members that meet its hub in one task, about; longer lists are dealt to more tasks.
SALT_ROWS = 4096
#: Nodes that are broadcast to find their texts, at most (three longs each); more meet them by shuffle.
BROADCAST_NODES = 500_000
#: Rounds of further hubs for long lists, at most, before what is left is compared in blocks.
ROUNDS = 3


def least_shared(k: int, threshold: float, miss: float = MISS) -> int:
    """The largest c with P(Binomial(k, threshold) < c) <= miss."""
    tail = 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if tail > miss:
            return c
    return k


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, low = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                one.append(int(mix(s).sum(dtype=np.uint64)))
                two.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                low.append(s[:k].view(np.int64))
            ends = np.cumsum([0, *map(len, low)], dtype=np.int32)
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "sketch"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), width)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the sets on both sides, sizes of all their intersections).

    Values that many pairs share are counted by products of matrices, the others pair by pair: work and memory are
    bounded by the number of pairs and the sets' mean size.
    """
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    n, m = len(left), len(right)
    flat, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sides = [(np.repeat(np.arange(n), sizes[0]), codes[: sizes[0].sum()]), (np.repeat(np.arange(m), sizes[1]), codes[sizes[0].sum() :])]
    a, b = (np.bincount(c, minlength=len(flat)) for _, c in sides)
    often = a * b * DENSE > n * m
    number = np.where(often, np.cumsum(often) - 1, -1)
    inter = np.zeros((n, m), np.int64)
    for lo in range(0, int(often.sum()), 1024):
        grids = [np.zeros((size, 1024), np.float32) for size in (n, m)]
        for grid, (row, code) in zip(grids, sides, strict=True):
            use = (number[code] >= lo) & (number[code] < lo + 1024)
            grid[row[use], number[code[use]] - lo] = 1
        inter += (grids[0] @ grids[1].T).astype(np.int64)
    (row, code), (other, theirs) = sides
    use = ~often[code] & (b[code] > 0)
    row, code = row[use], code[use]
    other, first, times = other[np.argsort(theirs, kind="stable")], np.cumsum(b) - b, b[code]
    ends, lo = np.cumsum(times), 0
    while lo < len(code):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - times[lo] + PAIRS, side="right")))
        t = times[lo:hi]
        at = np.repeat(first[code[lo:hi]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        inter += np.bincount(np.repeat(row[lo:hi], t) * m + other[at], minlength=n * m).reshape(n, m)
        lo = hi
    return *sizes, inter


def _partners(k: int, percent: int, least: int):
    """The members of one block pair whose sketches allow for a link with a member of another component.

    They are given by smaller pairs of blocks (a, b) whose whole sets fit into a task: in each those that have a likely
    partner there, likely partners being placed near each other.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = []
        if len(left) and len(right):
            enough = np.zeros((len(left), len(right)), bool)
            m, theirs = right.n_shingles.to_numpy()[None, :], right.c.to_numpy()[None, :]
            for lo in range(0, len(left), STRIPE):
                some = left.iloc[lo : lo + STRIPE]
                a, b, inter = _overlaps(list(some["sketch"]), list(right["sketch"]))
                union = a[:, None] + b[None, :] - inter
                likely = inter >= np.where(union < k, -(-union * percent // 100), least)
                n = some.n_shingles.to_numpy()[:, None]
                enough[lo : lo + STRIPE] = likely & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (some.c.to_numpy()[:, None] != theirs)
            at = []
            for side, table in ((enough, left), (enough.T, right)):
                who = np.flatnonzero(side.any(axis=1))
                who = who[np.argsort(side[who].argmax(axis=1), kind="stable")] if len(who) else who
                at.append((who, np.cumsum(table.n_shingles.to_numpy()[who]) // BLOCK_SHINGLES))
            (one, part_one), (two, part_two) = at
            for a in np.unique(part_one):
                for b in np.unique(part_two):
                    i, j = one[part_one == a], two[part_two == b]
                    cell = enough[np.ix_(i, j)]
                    for table, who in ((left, i[cell.any(axis=1)]), (right, j[cell.any(axis=0)])):
                        out.append(table.iloc[who][["whole", "u", "i", "j", "side", "node"]].assign(a=a, b=b))
        empty = pdf.iloc[:0][["whole", "u", "i", "j", "side", "node"]].assign(a=0, b=0)
        return pd.concat(out) if out else empty

    return run


def _block_links(num: int, den: int):
    """Links between the members on side 0 and those on side 1 of one block pair.

    Gives each member that is linked with a smaller one, through others of the block too, with one member of its group:
    as good as all its links for components, and no more rows than members.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.drop_duplicates(["node", "side"])
        left, right = rows[rows.side == 0].reset_index(drop=True), rows[rows.side == 1].reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        ids, root = np.unique(np.concatenate([left.node.to_numpy(), right.node.to_numpy()]), return_inverse=True)
        mine, theirs = root[: len(left)], root[len(left) :]
        root = np.arange(len(ids))
        for lo in range(0, len(left), STRIPE):
            a, b, inter = _overlaps(list(left.shingles[lo : lo + STRIPE]), list(right.shingles))
            linked = den * inter >= num * (a[:, None] + b[None, :] - inter)
            for x, partners in zip(mine[lo : lo + STRIPE], linked, strict=True):
                roots = np.unique(root[np.append(theirs[partners], x)])
                if len(roots) > 1:
                    hit = np.zeros(len(ids), bool)
                    hit[roots] = True
                    root[hit[root]] = roots[0]
        keep = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[keep], "b": ids[root[keep]]})

    return run


def _salts(m: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(m) - 1))


def _salt(m: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(m)).cast("int")


def _by_list(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (v, m, ...) with what ``table`` (v, m, ...) has for their list; long lists are spread by m salts."""
    return rows.withColumn("ls", _salt("m")).join(table.withColumn("ls", _salts("m")).drop("m"), ["v", "ls"], how).drop("ls")


def _mixed(rows: DataFrame) -> DataFrame:
    """The (v, node, c, m, ...) rows of those lists that several components share, one list for each set of members."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)]
    lists = rows.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("m").alias("m"), F.count("*").alias("n"), *marks).where("lo <> hi")
    lists = lists.groupBy("x0", "x1", "n").agg(F.min_by(F.struct("v", "m"), "v").alias("x")).select("x.v", "x.m")
    return _by_list(rows, lists, "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, k: int = 64, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, chosen for every row of ``docs``.

    Two rows are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct ``width``-word shingles
    (A-Z lower-cased, words parted by blanks; a shorter text is one shingle). ``component_id`` is the smallest id
    reachable and ``kept`` marks the rows that have it. Each row is judged by its own text: rows with one id and other
    texts are linked only if their sets are. ``chosen`` marks one (doc_id, text) of each component, told by
    ``text_hash`` (xxhash64 of the text): repeated rows share it. Null and wordless texts have no shingles and stay
    alone; a row with a null id stays alone too (component null) and is kept and chosen. A very long text is one set,
    whole. Other columns of ``docs`` are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    t = percent / 100
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, sketch array<long>"
    sketches = scratch.keep(source.mapInArrow(_sketches(width, k), schema))

    # one node for each set of shingles, numbered once and for all in a kept table
    live = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    some = sketches.where(live)
    fingerprint = ["fp1", "fp2", "n_shingles"]
    nodes = some.groupBy(*fingerprint).agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.min_by("sketch", F.struct("doc_id", "text_hash")).alias("sketch"))
    nodes = nodes.select(*fingerprint, F.col("x.doc_id").alias("rep"), F.col("x.text_hash").alias("text_hash"), "sketch", F.monotonically_increasing_id().alias("node"))
    nodes = scratch.keep(nodes)

    # inverted lists of those retained values that any partner must share: the rarest of each sketch
    values = nodes.select("node", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    c = least_shared(k, t)
    # a whole sketch meets whole ones only if its largest partner, of n / t shingles, is whole too; else values are cut off
    whole = F.size("sketch") * 100 <= k * percent
    need = F.when(whole, F.ceil(F.size("sketch") * t)).otherwise(F.least(F.lit(c), F.ceil(F.size("sketch") * t))).cast("int")
    rare = values.join(often, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum(F.log2("df")).alias("typical"))
    rare = rare.join(nodes.select("node", F.size("sketch").alias("s"), (F.size("sketch") - need + 1).alias("p")), "node")
    room = F.greatest(F.lit(0), F.col("p") - (F.col("s") - F.size("vs")))
    lists = rare.select("node", (F.col("typical") / F.col("s")).alias("typical"), F.explode(F.slice("vs", F.lit(1), room)).alias("x"))
    lists = scratch.keep(lists.select("node", "typical", F.col("x.v").alias("v"), F.ceil(F.col("x.df") / SALT_ROWS).cast("int").alias("m")))

    def with_hubs(members: DataFrame, candidates: DataFrame) -> DataFrame:
        """(node, hub, m, salt): each member with its list's hub, the most typical candidate; long lists are salted."""
        hubs = candidates.groupBy("v").agg(F.max_by("node", F.struct("typical", "node")).alias("hub"), F.max("m").alias("lm"))
        most = hubs.groupBy("hub").agg(F.max("lm").alias("hm"))
        pairs = _by_list(members, hubs.join(most, "hub").select("v", "hub", "hm", F.col("lm").alias("m"))).where("node <> hub")
        return pairs.select("node", "hub", "hm", _salt("hm").alias("hs")).distinct()

    def beside_hub(pairs: DataFrame, table: DataFrame) -> DataFrame:
        """The pairs with the columns of ``table`` (node, ...) for both: those of the hub, as _h, once for each salt."""
        of_hub = table.join(pairs.select(F.col("hub").alias("node"), "hm").distinct(), "node").withColumn("hs", _salts("hm")).drop("hm")
        of_hub = of_hub.select(F.col("node").alias("hub"), "hs", *(F.col(x).alias(f"{x}_h") for x in table.columns if x != "node"))
        return pairs.join(table, "node").join(of_hub, ["hub", "hs"])

    # most nodes are in no list: what follows reads the listed ones only
    listed = scratch.keep(lists.select("node").distinct())
    few = listed.count() <= BROADCAST_NODES
    held = scratch.keep(nodes.join(F.broadcast(listed) if few else listed, "node", "left_semi").drop("fp1", "fp2"))

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs that the sketch of their union makes likely."""
        both = beside_hub(pairs, held.select("node", "sketch", "n_shingles"))
        union = F.slice(F.array_sort(F.array_union("sketch", "sketch_h")), 1, k)
        shared = F.size(F.array_intersect(F.array_intersect(union, "sketch"), "sketch_h"))
        short = F.least("n_shingles", "n_shingles_h") * 100 >= F.greatest("n_shingles", "n_shingles_h") * percent
        enough = F.when(F.size(union) < k, F.ceil(F.size(union) * t)).otherwise(F.lit(c))
        return both.where(short & (shared >= enough)).select("node", "hub", "hm", "hs")

    # each member against its list's most typical one
    close = scratch.keep(likely(scratch.keep(with_hubs(lists, lists))))

    # the whole set of each listed node, from one of its rows
    wanted = held.select("node", F.col("rep").alias("doc_id"), "text_hash")
    again = some.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    # while the listed ones are few, only their texts travel
    wanted = F.broadcast(wanted) if few else wanted
    texts = source.join(wanted, ["doc_id", "text_hash"]).select("node", "text")
    if again.limit(1).count():
        again = scratch.keep(again)
        once = wanted.join(again, ["doc_id", "text_hash"], "left_anti")
        repeated = source.join(wanted.join(again, ["doc_id", "text_hash"]), ["doc_id", "text_hash"])
        texts = source.join(once, ["doc_id", "text_hash"]).select("node", "text").union(repeated.groupBy("node").agg(F.first("text").alias("text")))
    sets = scratch.keep(texts.mapInArrow(_full_sets(width), "node long, shingles array<long>"))

    def linked(pairs: DataFrame) -> DataFrame:
        i = F.size(F.array_intersect("shingles", "shingles_h"))
        checked = beside_hub(pairs, sets).withColumn("i", i)
        return checked.where(F.col("i") * 100 >= percent * (F.size("shingles") + F.size("shingles_h") - F.col("i"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))

    def merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
        """(node, c) after further links (a, b), and the number of pairs of components that these join."""
        new = links.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").where("x <> y")
        new = scratch.keep(new.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        n = new.count()
        if n:
            heads = components(scratch, new).toDF("c", "head")
            labels = scratch.keep(labels.join(heads, "c", "left").select("node", F.coalesce("head", "c").alias("c")))
        return labels, n

    # the component of each listed node
    labels, _ = merged(listed.select("node", F.col("node").alias("c")), scratch.keep(linked(close)))

    # lists that still join several components
    opened = scratch.keep(_mixed(lists.join(labels, "node")))
    for _ in range(rounds):
        counts = opened.groupBy("v", "c").agg(F.count("*").alias("n"), F.max("m").alias("m"))
        main = counts.groupBy("v").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("m").alias("m"))
        long = _by_list(opened, main.where(F.col("all") > LONG))
        if not long.limit(1).count():
            break
        apart = counts.select("c").distinct().count()
        more = likely(scratch.keep(with_hubs(long.select(*opened.columns), long.where("c <> main").select(*opened.columns))))
        labels, n = merged(labels, scratch.keep(linked(scratch.keep(more))))
        if n:
            opened = scratch.keep(opened.drop("c").join(labels, "node"))
        # hubs that join few of the components don't close lists: the rest is left to blocks
        if n * 10 < apart:
            break
        opened = scratch.keep(_mixed(opened))
    if opened.limit(1).count():
        # lists that hang together are compared at once if they have few members or that takes fewer pairs than list by list
        heads = opened.groupBy("v").agg(F.min("node").alias("b"), F.max("m").alias("m"))
        group = components(scratch, _by_list(opened, heads).select(F.col("node").alias("a"), "b")).toDF("node", "g")
        members = scratch.keep(group.join(labels, "node"))
        of_group = opened.join(members.select("node", "g"), "node")

        def work(rows: DataFrame, *unit: str) -> DataFrame:
            """The members of each unit, and the pairs of those outside its largest component with all."""
            counts = rows.groupBy(*unit, "c").agg(F.count("*").alias("n"))
            return counts.groupBy(*unit).agg(F.sum("n").alias("all"), ((F.sum("n") - F.max("n")) * F.sum("n")).alias("pairs"))

        by_list = work(of_group, "g", "v").groupBy("g").agg(F.sum("pairs").alias("by_list"))
        way = scratch.keep(work(members, "g").join(by_list, "g").select("g", ((F.col("all") <= BLOCK) | (F.col("pairs") <= F.col("by_list"))).alias("whole")))
        small = members.join(way.where("whole"), "g").select("whole", F.col("g").alias("u"), "node", "c")
        large = of_group.join(way.where("not whole"), "g").select("whole", F.col("v").alias("u"), "node", "c")
        units = small.union(large)
        unit = ["whole", "u"]
        counts = units.groupBy(*unit, "c").agg(F.count("*").alias("n"))
        counts = counts.groupBy(*unit).agg(F.max_by(F.struct("c", "n"), F.struct("n", "c")).alias("main"), F.sum("n").alias("all"))
        parts = lambda n: F.ceil(n / BLOCK).cast("int")
        blocks = counts.select(*unit, F.col("main.c").alias("main"), parts(F.col("all") - F.col("main.n")).alias("left"), parts(F.col("all")).alias("right"))
        # the members outside the largest component against all members
        placed = scratch.keep(units.join(blocks.where("left > 0"), unit))
        one = placed.where("c <> main").select(*unit, "node", "c", F.lit(0).alias("side"), _salt("left").alias("i"), _salts("right").alias("j"))
        two = placed.select(*unit, "node", "c", F.lit(1).alias("side"), _salt("right").alias("j"), _salts("left").alias("i")).select(*one.columns)
        both = one.union(two).join(held.select("node", "sketch", "n_shingles"), "node")
        hopeful = both.groupBy(*unit, "i", "j").applyInPandas(_partners(k, percent, c), "whole boolean, u long, i int, j int, side int, node long, a long, b long")
        hopeful = scratch.keep(hopeful)
        hopeful = F.broadcast(hopeful) if hopeful.count() <= BROADCAST_NODES // 4 else hopeful
        late = hopeful.join(sets, "node").groupBy(*unit, "i", "j", "a", "b").applyInPandas(_block_links(percent, 100), "a long, b long")
        labels, _ = merged(labels, scratch.keep(late))

    # the component's least row stands for it
    grouped = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("c", "node"))
    least = grouped.groupBy("component").agg(F.min(F.struct("rep", "text_hash")).alias("least"))
    ids = grouped.join(least, "component").select(*fingerprint, "least")
    rows = some.drop("sketch").join(ids, fingerprint)
    chosen = (F.col("doc_id") == F.col("least.rep")) & (F.col("text_hash") == F.col("least.text_hash"))
    rows = rows.select("doc_id", "n_shingles", F.col("least.rep").alias("component_id"), (F.col("doc_id") == F.col("least.rep")).alias("kept"), "text_hash", chosen.alias("chosen"))
    alone = sketches.where(~live).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash", F.lit(True).alias("chosen"))
    result = scratch.keep(rows.union(alone))
    scratch.clear(result)
    return result
