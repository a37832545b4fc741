"""Anchors of a text's bytes: grams that any two equal strings of a given length select alike."""

from __future__ import annotations

import numpy as np

from shardloom.llm.textbytes import mix

GRAM = 24


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place (empty if there are fewer)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    middle = mix(words[8 : 8 + n] * np.uint64(0xD6E8FEB86659FD93) ^ mix(words[16 : 16 + n]))
    return mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ middle)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of ``width`` places, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def anchors(hashes: np.ndarray, length: int) -> np.ndarray:
    """Places of the grams that are the least of some window of all grams in ``length`` bytes.

    Which grams of a string of ``length`` bytes are chosen on its own account depends on its bytes alone, so equal
    strings have a chosen gram at the same place in both.
    """
    width = length - GRAM + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _slide(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == hashes)
