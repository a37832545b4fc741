"""Packing documents into token windows with lexically similar neighbours.

Term statistics are counted over all documents. Each document gets routing terms, consistent weighted samples of its
terms, and documents sorted by them are cut into shards of bounded size, so that documents with the same rare terms
meet in one shard however many shards there are. In each shard a BM25 inverted index over token ids returns, for the
document that opens a window, its best neighbours among the unused ones; they fill the window greedily, and the last
one is cut where the window ends and opens the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch
from shardloom.llm.textbytes import mix
from shardloom.llm.tokens import encoder

#: Ids and rows in the index of one shard, about, and ids in a range of the order, which one task packs shard by shard.
SHARD_IDS = 500_000
SHARD_ROWS = 2048
RANGE_IDS = 8_000_000
ROUTES = 3
K1, B = 1.2, 0.75
_IDS = "doc_id long, n long, spread long, ids binary"
_PIECES = "doc_id long, ids binary, start long, length long, doc_tokens long, sequence_id long, offset long"


def bm25_idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


class Bm25:
    """An inverted index over a shard's documents; ``idf`` by id and ``mean`` length are those of all documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(self.n), lengths)
        flat = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        pair, tf = np.unique(flat * max(1, self.n) + owner, return_counts=True)
        term, self.doc = np.divmod(pair, max(1, self.n))
        self.start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.start, len(term)])
        slot = np.repeat(np.arange(len(self.start)), self.size)
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        # by document, its terms that others of the shard have too
        shared = self.size[slot] > 1
        order = np.argsort(self.doc[shared], kind="stable")
        self.terms = slot[shared][order]
        self.of = np.searchsorted(self.doc[shared][order], np.arange(self.n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed by their scores for all of its terms, ties by place."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        start, size = self.start[terms], self.size[terms]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def pack_shard(docs: list[np.ndarray], index: Bm25, window: int, sequence: int = 0, offset: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of one shard's documents, from an open window on.

    The first unused document is a window's seed; where no unused neighbour of it is left, the next one takes its place.
    """
    used, following, queue = np.zeros(len(docs), dtype=bool), 0, iter(())
    while True:
        doc = next((int(d) for d in queue if not used[d]), None)
        seed = doc is None
        if seed:
            while following < len(docs) and used[following]:
                following += 1
            if following == len(docs):
                return
            doc = following
        used[doc] = True
        start = 0
        while start < len(docs[doc]):
            if offset == window:
                sequence, offset, seed = sequence + 1, 0, True
            length = min(window - offset, len(docs[doc]) - start)
            yield doc, start, length, sequence, offset
            start, offset = start + length, offset + length
        if seed:  # it opened this window, or its queue had ended
            queue = iter(index.neighbours(doc, used)) if offset < window else iter(())


def _type(width: int) -> str:
    return "<u2" if width == 2 else "<u4"


def _encode(path: str, end_id: int, width: int):
    """Each row's ids with the end id, and a number that spreads equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, row = np.array([end_id], np.uint32), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = [np.concatenate([x, end]).astype(_type(width)) for x in encoder(path).batch(batch.column(1))]
            spread = mix(np.arange(row, row + len(ids), dtype=np.uint64)).view(np.int64)
            row += len(ids)
            lengths = pa.array(np.array(list(map(len, ids)), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, pa.array(spread), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "spread", "ids"])

    return run


def _frequencies(vocabulary: int, width: int):
    """(term, documents that have it) of a task's documents; the end id at the end of each doesn't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                df[np.unique(np.frombuffer(ids, _type(width))[:-1])] += 1
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    return run


def routing_ranks(df: np.ndarray, n_docs: int, seed: int) -> np.ndarray:
    """ROUTES ranks of each term: a document's routing terms are those of least rank.

    Exponential draws divided by weights: two documents have the same routing term with a chance that is their
    weighted Jaccard similarity. Terms of one document route nothing.
    """
    draws = np.random.default_rng(seed).exponential(size=(ROUTES, len(df)))
    return np.where(df > 1, draws / np.maximum(bm25_idf(df, n_docs), 1e-9), np.inf)


def _routed(ranks: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = np.full((len(batch), len(ranks)), -1, np.int32)
            for i, ids in enumerate(batch.column(3).to_pylist()):
                terms = np.unique(np.frombuffer(ids, _type(width))[:-1])
                if len(terms):
                    rank = ranks[:, terms]
                    routes[i] = np.where(np.isfinite(rank.min(axis=1)), terms[rank.argmin(axis=1)], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(r)) for r in routes.T)], [*batch.schema.names, *(f"r{k}" for k in range(len(ranks)))])

    return run


def _pack(window: int, idf: np.ndarray, mean: float, width: int):
    """Packs a range of the order shard by shard; the window that is open at a shard's end goes on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence, offset = TaskContext.get().partitionId() << 40, 0, 0
        docs: list[np.ndarray] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, offset, docs, names
            pieces = np.array(list(pack_shard(docs, Bm25([d[:-1] for d in docs], idf, mean), window, sequence, offset)), np.int64).reshape(-1, 5)
            doc, start, length, at, place = pieces.T
            sequence, offset = int(at[-1]), int(place[-1] + length[-1])
            ids = pa.array([docs[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)], pa.binary())
            total = np.array([len(d) for d in docs], np.int64)[doc]
            columns = [pa.array(names, pa.int64()).take(pa.array(doc)), ids, *(pa.array(np.ascontiguousarray(c)) for c in (start, length, total, base + at, place))]
            docs, names = [], []
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECES.split(", ")])

        held = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(doc_id)
                docs.append(np.frombuffer(ids, _type(width)))
                held += len(docs[-1])
                if held >= SHARD_IDS or len(docs) >= SHARD_ROWS:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, seed: int = 5, range_ids: int = RANGE_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), start, length, doc_tokens, sequence_id, offset: one row for each piece.

    A document is its text's ids by the tokenizer file ``tokenizer`` and ``end_id``; each id lies in one piece, pieces
    lie gapless in sequences of at most ``window`` ids, and each range of the order (about ``range_ids`` ids) has one
    sequence at most that isn't full. Null and empty texts are one id; a very long text runs through as many sequences
    as it needs and is a shard of its own; null ids and repeated rows are documents of their own (a document's pieces
    are told from those of another row with its id by their sequences only); an empty table gives no pieces. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    coded = scratch.keep(rows.mapInArrow(_encode(tokenizer, end_id, width), _IDS))
    n_docs, n_ids = coded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row at most for each id of the vocabulary, whatever the corpus
    counts = coded.select("ids").mapInArrow(_frequencies(vocabulary, width), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(vocabulary, np.int64)
    for term, n in counts.toLocalIterator():
        df[term] = n
    routes = [f"r{k}" for k in range(ROUTES)]
    routed = coded.mapInArrow(_routed(routing_ranks(df, n_docs, seed), width), f"{_IDS}, {', '.join(f'{r} int' for r in routes)}")
    order = [*routes, "spread"]
    ranged = routed.repartitionByRange(max(1, -(-n_ids // range_ids)), *order).sortWithinPartitions(*order)
    mean = (n_ids - n_docs) / max(1, n_docs)
    return ranged.select("doc_id", "ids").mapInArrow(_pack(window, bm25_idf(df, n_docs), mean, width), _PIECES)
