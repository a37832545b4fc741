"""A run-length compressed Burrows-Wheeler index of many short strings, with sampled run ends.

Strings end in separators and equal suffixes stand in the strings' order. The transform is kept as runs; places in the
text are sampled at the two ends of each run only, which is enough to keep a place of the current match while
matching statistics stream over patterns: a pattern's next byte either continues the run at the current row, or the
row jumps to the nearest run of that byte above or below, whichever shares more with the pattern so far.
"""

from __future__ import annotations

import numpy as np


def _ranked(key: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of some keys, equal ones in their own order if it is the ``last`` one, and their dense ranks."""
    order = np.argsort(key, kind="stable" if last else "quicksort")
    ranks = np.zeros(len(key), np.int64)
    ranks[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
    return order, ranks


class RunLengthIndex:
    """``texts``: byte strings of at most 250 bytes; ``reach``: matches count up to this length (29 to 56)."""

    def __init__(self, texts: list[bytes], reach: int = 50):
        self.reach, lengths = reach, np.array([len(t) for t in texts], np.int64)
        pad = 256
        chars = np.frombuffer(b"".join(t + b"\0" for t in texts) + bytes(pad), np.uint8).astype(np.int16) + 1
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1 if len(texts) else 0
        chars[ends] = 0
        chars[n:] = 0
        self.text, self.n = chars, n
        self.owner = np.repeat(np.arange(len(texts)), lengths + 1)
        left = np.repeat(ends, lengths + 1) - np.arange(n)  # bytes before the separator
        # suffix ranks, cut at separators: of some first bytes, then of three times as many
        alphabet = np.flatnonzero(np.bincount(chars[:n], minlength=257)) if n else np.zeros(0, np.int64)
        code = np.zeros(257, np.int64)
        code[alphabet] = np.arange(len(alphabet)) + (0 if len(alphabet) and alphabet[0] == 0 else 1)
        bits = max(1, int(len(alphabet) + 1).bit_length())
        width, coded, key = min(reach, 63 // bits), np.r_[code[chars[:n]], np.zeros(64, np.int64)], np.zeros(n, np.int64)
        for k in range(width):
            key = key << bits | np.where(left > k, coded[k : k + n], 0)
        longest = lengths.max(initial=0)
        order, ranks = _ranked(key, width > longest)
        kept = {width: ranks}
        times = 3 if n < 2_000_000 else 2  # (n + 2) ** 3 fits in 63 bits
        while width <= longest:
            key = ranks.copy()
            for k in range(1, times):
                after = np.zeros(n, np.int64)
                after[: max(0, n - k * width)] = ranks[k * width :] + 1
                after[left <= k * width] = 0
                key = key * np.int64(n + 2) + after
            width *= times
            order, ranks = _ranked(key, width > longest)
            kept[width] = ranks
        # rows whose suffixes share ``reach`` bytes lie together: their pieces of a known width have equal ranks
        known = max((w for w in kept if w <= reach), default=0)
        differ = np.ones(n, bool)
        if n:
            differ[1:] = False
            for k in [*range(0, reach - known, known), reach - known]:
                piece = kept[known][np.minimum(order + k, n - 1)]
                differ[1:] |= piece[1:] != piece[:-1]
        self.block_start = np.flatnonzero(differ)
        self.block_owner = np.minimum.reduceat(self.owner[order], self.block_start) if n else np.zeros(0, np.int64)
        before = chars[order - 1].copy()
        if n:
            before[order == 0] = 0
        start = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if n else np.zeros(0, np.int64)
        self.run_start, self.run_char = start, before[start].astype(np.int64)
        run_end = np.r_[start[1:], n][: len(start)] - 1
        self.at_start, self.at_end = order[start], order[run_end]  # the only sampled places
        runs = np.arange(len(start))
        by_char = np.lexsort((runs, self.run_char))
        size = run_end - start + 1
        total = np.cumsum(size[by_char])
        self.first_row = np.zeros(len(start), np.int64)
        self.first_row[by_char] = total - size[by_char]  # the row of a run's first byte in the first column
        self.keys = (self.run_char * (len(start) + 1) + runs)[by_char]
        self.by_char = by_char

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def matching_statistics(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(length, row) by pattern and byte: the longest match that starts there, up to ``reach``, and a row that has it.

        All patterns stream together, from their last bytes to their first.
        """
        m, longest = len(patterns), max(map(len, patterns), default=0)
        lengths = np.array([len(p) for p in patterns], np.int64)
        # right-aligned, so that all patterns start at the same step; a reserve for comparisons follows
        grid = np.full((m, longest + self.reach), -1, np.int16)
        for i, p in enumerate(patterns):
            grid[i, longest - len(p) : longest] = np.frombuffer(p, np.uint8)
        grid[:, :longest] += grid[:, :longest] >= 0
        out, rows = np.zeros((m, longest), np.int16), np.zeros((m, longest), np.int64)
        if not self.n or not m:
            return out, rows
        row, place, length = np.zeros(m, np.int64), np.full(m, self.at_start[0]), np.zeros(m, np.int64)
        spread = np.arange(self.reach)

        def shared(lanes: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
            same = self.text[np.minimum(at[:, None] + spread, len(self.text) - 1)] == grid[lanes, i + 1 : i + 1 + self.reach]
            same &= np.cumprod(self.text[np.minimum(at[:, None] + spread, len(self.text) - 1)] > 0, axis=1).astype(bool)
            return np.where(same.all(axis=1), self.reach, np.argmin(same, axis=1))

        for i in range(longest - 1, -1, -1):
            live = np.flatnonzero(lengths >= longest - i)
            c, run = grid[live, i].astype(np.int64), np.searchsorted(self.run_start, row[live], side="right") - 1
            off = self.run_char[run] != c
            if off.any():
                lanes, cc, at = live[off], c[off], run[off]
                base = cc * (self.runs + 1)
                below = np.searchsorted(self.keys, base + at)
                up, down = np.maximum(below - 1, 0), np.minimum(below, self.runs - 1)
                has_up = self.keys[up] // (self.runs + 1) == cc
                has_up &= below > 0
                has_down = (self.keys[down] // (self.runs + 1) == cc) & (below < self.runs)
                up, down = self.by_char[up], self.by_char[down]
                reach_up = np.where(has_up, shared(lanes, self.at_end[up], i), -1)
                reach_down = np.where(has_down, shared(lanes, self.at_start[down], i), -1)
                take = reach_up >= reach_down
                best = np.maximum(reach_up, reach_down)
                new_run = np.where(take, up, down)
                gone = best < 0
                row[lanes] = np.where(gone, 0, np.where(take, np.r_[self.run_start[1:], self.n][up] - 1, self.run_start[down]))
                place[lanes] = np.where(gone, self.at_start[0], np.where(take, self.at_end[up], self.at_start[down]))
                length[lanes] = np.where(gone, -1, np.minimum(length[lanes], best))
                run[off] = np.where(gone, at, new_run)
            step = length[live] >= 0
            lanes, run = live[step], run[step]
            row[lanes] = self.first_row[run] + row[lanes] - self.run_start[run]
            place[lanes] -= 1
            length[lanes] += 1
            length[live[~step]] = 0
            np.minimum(length, self.reach, out=length)
            out[live, i], rows[live, i] = length[live], row[live]
        return out, rows

    def least_owner(self, rows: np.ndarray) -> np.ndarray:
        """The first of the strings that have the ``reach`` bytes at a row's suffix."""
        return self.block_owner[np.searchsorted(self.block_start, rows, side="right") - 1]
