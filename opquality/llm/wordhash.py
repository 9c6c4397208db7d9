"""Words of a block of texts as byte ranges and 64-bit hashes, without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(1, dtype=np.uint64)
    grow = lambda m: np.concatenate((ones, np.cumprod(np.full((1 << bits) - 1, m, dtype=np.uint64))))
    return grow(MULTIPLIER), grow(INVERSE)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(max(20, int(len(data) - 1).bit_length()))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE_VALUES[data] * power[:len(data)])))
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def raw_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins. Nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[ends[0]:ends[-1]], ends - ends[0]


@dataclass
class Words:
    """Words of several texts: byte ranges, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray


def find_words(data: np.ndarray, text_at: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes b with is_word[b], none across two texts."""
    inside = is_word[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = text_at[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, text_at))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, from each word that has n - 1 after it."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + words[k:k + count]
    return mix(out + np.uint64(n))


def text_of_word(at: np.ndarray) -> np.ndarray:
    """The number of the text that each word stands in."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def run_bounds(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of each run of true flags."""
    padded = np.concatenate(([False], flags, [False]))
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return change[::2], change[1::2]


