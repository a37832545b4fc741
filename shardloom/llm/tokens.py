"""Token ids of whole texts by a tokenizer file, computed once for each distinct piece that a worker meets.

A text is cut before each single space that starts a piece and between an ASCII letter and ASCII punctuation other
than the apostrophe: byte-level and word BPE never join across such places, so the ids of a text are those of its
pieces. Pieces repeat; each is encoded once by the tokenizers library and remembered in the worker. The rare texts that
hold an added token (such as <|endoftext|>) are encoded as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from shardloom.llm.textbytes import _LOWER, SMALL_SLICE, prefix_hashes, slices, span_hashes

#: First bytes of characters that may be white space beyond ASCII, and ASCII control characters: no cut before them.
_NO_CUT = np.zeros(256, dtype=bool)
_NO_CUT[:0x21] = True
_NO_CUT[0x7F:0xC3] = True
_NO_CUT[[0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Pieces that a worker remembers before it starts afresh; bounds memory (about 40 bytes a piece), not results.
MEMORY_PIECES = 3_000_000
_RECENT = 200_000


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the pieces that follow each other in ``data``, by slices of about SMALL_SLICE bytes."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        first = start[i]
        j = max(i + 1, int(np.searchsorted(end, first + SMALL_SLICE, side="right")))
        out[i:j] = span_hashes(prefix_hashes(data[first : end[j - 1]]), start[i:j] - first, end[i:j] - first)
        i = j
    return out


class PieceEncoder:
    """Encodes batches of texts with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        # in lower case: which of them match is the library's choice
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """Slots of known pieces, else -1."""
        out = np.full(len(codes), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
            out = np.where(self.keys[at] == codes, self.slots[at], out)
        if self.recent:
            get = self.recent.get
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = get(int(codes[i]), -1)
        return out

    def _learn(self, codes: np.ndarray, texts: list[str]) -> np.ndarray:
        got = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        piece = np.array(got.word_ids, np.int64)
        ends = np.searchsorted(piece, np.arange(1, len(texts) + 1))
        n = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, len(self.flat) + ends])
        self.flat = np.concatenate([self.flat, np.array(got.ids, np.uint32)])
        slots = np.arange(n, n + len(texts))
        self.recent.update(zip(codes.tolist(), slots.tolist(), strict=True))
        if len(self.recent) > _RECENT:
            keys = np.concatenate([self.keys, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
            at = np.concatenate([self.slots, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots, self.recent = keys[order], at[order], {}
        return slots

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row's text, in order; none for a null or empty text."""
        for _, data, offsets in slices(column):
            whole = self._with_added(data, offsets)
            for i, ids in enumerate(self._rows(data, offsets)):
                yield whole.get(i, ids)

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """The ids of the rows that hold an added token, by row."""
        raw, hits = data.tobytes().lower(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                hits.append(at)
                at = raw.find(token, at + 1)
        rows = np.unique(np.searchsorted(offsets, np.array(hits, np.int64), "right") - 1).tolist()
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in rows]
        return {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in zip(rows, texts, strict=True)}

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            yield from (np.zeros(0, np.uint32) for _ in range(n))
            return
        if self.lower:
            data = _LOWER[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[:-2] = (data[:-1] == 0x20) & ~_NO_CUT[data[1:]]
        cut[1:-1] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        codes, distinct = pd.factorize(_codes(data, start, end))
        if len(self.starts) + len(distinct) > MEMORY_PIECES:
            self._forget()
        slots = self._find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.full(len(distinct), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()
            slots[new] = self._learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        at = slots[codes]
        begin = self.starts[at]
        lengths = self.starts[at + 1] - begin
        total = np.cumsum(lengths)
        ids = self.flat[np.repeat(begin - (total - lengths), lengths) + np.arange(total[-1])]
        by_row = np.concatenate([[0], total])[np.searchsorted(start, offsets)]
        for a, b in zip(by_row[:-1], by_row[1:], strict=True):
            yield ids[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    return PieceEncoder(path)
