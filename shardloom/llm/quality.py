"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, each encoded by the make-up of its bytes and by its words. Gated attention, learnt from
document labels alone, weighs the passages, and the weighted passage representation is scored. The model is fitted on
a bounded sample of labelled documents; every passage of every document is encoded and scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shardloom.llm.textbytes import SMALL_SLICE, prefix_hashes, slices, span_hashes, words

PASSAGE_WORDS = 64
#: Labelled documents that the model is fitted on, about, at most.
TRAIN_DOCS = 4000
#: Passages of one document that it is fitted on, at most, evenly spread; scoring takes all.
TRAIN_PASSAGES = 32
HIDDEN, GATE, STEPS, BATCH, RATE, DECAY = 24, 12, 600, 256, 0.01, 1e-4

# classes of bytes: each ASCII sign for itself, then letters by case, digits, blanks, other control, beyond ASCII
_CLASS = np.zeros(256, np.int64)
_SIGNS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_CLASS[_SIGNS] = np.arange(len(_SIGNS))
_N = len(_SIGNS)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[:33], _CLASS[127] = _N, _N + 1, _N + 2, _N + 3, _N + 3
_CLASS[128:192], _CLASS[192:] = _N + 4, _N + 5
_CLASS[10] = _N + 6
CLASSES = _N + 7
#: Words are hashed to so many shares of a passage's words.
HASHED = 64
FEATURES = CLASSES + 6 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(encodings, first passage of each row with the total at the end); a row has one passage at least."""
    start, end, by_row = words(data, offsets)
    n_words = np.diff(by_row)
    per_row = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per_row)])
    total = int(first[-1])
    word_row = np.repeat(np.arange(len(n_words)), n_words)
    word_passage = first[:-1][word_row] + (np.arange(len(start)) - by_row[:-1][word_row]) // PASSAGE_WORDS
    out = np.zeros((total, FEATURES), np.float32)
    if not len(data):
        return out, first
    # a passage has the bytes from its first word on, a row's first passage those before too
    opening = np.flatnonzero(np.r_[True, word_passage[1:] != word_passage[:-1]]) if len(start) else np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, np.int64)
    head = np.zeros(len(data) + 1, bool)
    later = opening[word_passage[opening] > first[:-1][word_row[opening]]] if len(opening) else opening
    edge[start[later]] = 1
    head[offsets[:-1]] = True
    of_row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    steps = np.cumsum(edge[:-1])
    of_passage = first[:-1][of_row] + steps - np.concatenate([[0], steps])[offsets[:-1]][of_row]
    counts = np.bincount(of_passage * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES)
    size = counts.sum(axis=1)
    out[:, :CLASSES] = counts / np.maximum(size, 1)[:, None]
    if len(start):
        codes = span_hashes(prefix_hashes(data), start, end)
        n = np.bincount(word_passage, minlength=total)
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == codes[:-1]) & (word_passage[1:] == word_passage[:-1])
        order = np.lexsort((codes, word_passage))
        new = np.r_[True, (codes[order][1:] != codes[order][:-1]) | (word_passage[order][1:] != word_passage[order][:-1])]
        length = (end - start).astype(np.float64)
        some = np.maximum(n, 1)
        out[:, CLASSES] = np.bincount(word_passage, again, total) / some
        out[:, CLASSES + 1] = np.bincount(word_passage[order], new, total) / some
        mean = np.bincount(word_passage, length, total) / some
        out[:, CLASSES + 2] = np.log1p(mean)
        out[:, CLASSES + 3] = np.log1p(np.maximum(np.bincount(word_passage, length**2, total) / some - mean**2, 0))
        out[:, CLASSES + 4] = np.log1p(n)
        hashed = np.bincount(word_passage * HASHED + (codes % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED)
        out[:, CLASSES + 6 :] = np.sqrt(hashed.reshape(total, HASHED) / some[:, None])
    out[:, CLASSES + 5] = np.log1p(size)
    return out, first


@dataclass
class Model:
    """Gated attention over passages: h = relu(xW), a = softmax(u . tanh(hV) * sigmoid(hG)), score = sigmoid(c . sum a h)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 1) -> Model:
        """x: passages, first: each bag's first passage (with the total at the end), y: 0 or 1 by bag; by Adam on all bags."""
        rng = np.random.default_rng(seed)
        f = x.shape[1]
        mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(f), np.ones(f))
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        p = {
            "W": rng.normal(0, (2 / f) ** 0.5, (f, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "G": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": np.zeros(GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.array(np.log(rate / (1 - rate))),
        }
        model = cls(mean, scale, p)
        if not len(y):
            return model
        z, sizes = np.clip((x - mean) / scale, -8, 8), np.diff(first)
        m, v, order = {k: 0.0 for k in p}, {k: 0.0 for k in p}, np.zeros(0, np.int64)
        for step in range(1, STEPS + 1):
            if not len(order):
                order = rng.permutation(len(y))
            bags, order = order[:BATCH], order[BATCH:]
            n = sizes[bags]
            at = np.r_[0, np.cumsum(n)]
            grad = cls.gradient(p, z[np.repeat(first[bags] - at[:-1], n) + np.arange(at[-1])], at, y[bags])
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - RATE * (1 - step / (STEPS + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return model

    @classmethod
    def gradient(cls, p: dict[str, np.ndarray], z: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """The slopes of the mean log loss over some bags plus DECAY / 2 of the squared weights."""
        bag = np.repeat(np.arange(len(y)), np.diff(first))
        h = np.maximum(z @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        a = cls._softmax((t * g) @ p["u"], first, bag)
        rep = np.add.reduceat(h * a[:, None], first[:-1])
        err = (1 / (1 + np.exp(-(rep @ p["c"] + p["d"]))) - y) / len(y)
        back = err[bag, None] * p["c"]
        slope = (h * back).sum(axis=1)
        ds = a * (slope - np.bincount(bag, a * slope, len(y))[bag])
        dt, dg = ds[:, None] * p["u"] * g * (1 - t * t), ds[:, None] * p["u"] * t * g * (1 - g)
        dh = (a[:, None] * back + dt @ p["V"].T + dg @ p["G"].T) * (h > 0)
        grad = {"W": z.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "G": h.T @ dg, "u": (t * g).T @ ds, "c": rep.T @ err, "d": err.sum()}
        return {k: grad[k] + DECAY * p[k] * (k not in "bd") for k in p}

    @staticmethod
    def _softmax(s: np.ndarray, first: np.ndarray, bag: np.ndarray) -> np.ndarray:
        e = np.exp(s - np.maximum.reduceat(s, first[:-1])[bag])
        return e / np.add.reduceat(e, first[:-1])[bag]

    def score(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score by bag, attention by passage)."""
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ p["W"] + p["b"], 0)
        a = self._softmax((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["G"])))) @ p["u"], first, bag)
        rep = np.add.reduceat(h * a[:, None], first[:-1])
        return 1 / (1 + np.exp(-(rep @ p["c"] + p["d"]))), a


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels with the encodings of TRAIN_PASSAGES passages at most of each text."""
    for batch in batches:
        for row, data, offsets in slices(batch.column(1), SMALL_SLICE):
            x, first = passages(data, offsets)
            spread = [np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).astype(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(spread)), pa.array([x[at].astype("<f4").tobytes() for at in spread], pa.binary())], ["quality", "x"])


def _score(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(0), SMALL_SLICE):
                x, first = passages(data, offsets)
                score = model.score(x.astype(np.float64), first)[0]
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(score)) for c in batch.columns), pa.array(score)], [*batch.schema.names, name])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text modulo 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model learnt from labelled documents that aren't held out, ``train_docs`` of them or fewer (chosen by a hash).

    A document with several labels has their mean, rounded; null labels and ids don't count; an id's repeated rows
    count once, with the least text. Of a very long text TRAIN_PASSAGES passages are learnt from. So the driver gets
    about ``train_docs`` times TRAIN_PASSAGES encodings at most. Without labels or documents every score is one half
    or near it. Other columns of both tables don't matter, whatever their names.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("quality"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, train_docs / max(1, n))))
    # about train_docs rows, whatever the tables' sizes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "quality").agg(F.min("text").alias("text"))
    bags = rows.select("quality", "text").mapInArrow(_encode, "quality int, x binary").orderBy("quality", F.xxhash64("x")).collect()
    x = [np.frombuffer(b.x, "<f4").reshape(-1, FEATURES).astype(np.float64) for b in bags]
    first = np.cumsum([0, *map(len, x)])
    return Model.fit(np.concatenate(x) if x else np.zeros((0, FEATURES)), first, np.array([b.quality for b in bags], np.float64))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """``docs`` with a new column of scores (0 to 1): every passage of each text counts; a null or empty text is one empty passage.

    Rows are scored one by one, so repeated ones get equal scores; an empty table stays empty.
    """
    if score_col in docs.columns:
        raise ValueError(f"there is a column {score_col} already")
    columns = [text_col, *(c for c in docs.columns if c != text_col)]
    ordered = docs.select(*(F.col(f"`{c}`") for c in columns))
    schema = StructType([*ordered.schema.fields, StructField(score_col, DoubleType())])
    return ordered.mapInArrow(_score(model, score_col), schema).select(*(f"`{c}`" for c in docs.columns), score_col)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` by a model learnt from ``labels``; only texts are inputs.

    Null and empty texts are scored as one empty passage, very long ones by all their passages; repeated rows are
    scored alike; a row with a null id isn't held out.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = score_quality(rows, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
