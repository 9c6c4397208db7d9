"""Token ids of many texts, encoding each distinct word once.

Byte-level pre-tokenisation never reaches across a single space between two
characters that are not white space, and a piece that follows such a space begins
with it. So a text falls into units, its first word and " word" for the others, whose
ids do not depend on what stands around them. Texts in which a space touches other
white space are one unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IRREGULAR = f" {WHITE}|{WHITE} "
JOINED = 2048
# Words are made distinct within so many bytes of text; ids are handed out by smaller blocks.
# A worker holds some 50 times as much beside its vocabulary while it encodes words that are new to it.
SHARED_BYTES = 2 << 20
BLOCK_BYTES = 2 << 20
CACHED_WORDS = 1 << 18

# Ids of some texts, one after the other, and where each text's ids begin.
Encoded = tuple[np.ndarray, np.ndarray]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at starts and have these lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def bounds(lengths) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


class Cache:
    """Ids of words that came up again, for the texts to come; of bounded size."""

    def __init__(self, most: int = CACHED_WORDS):
        self.most = most
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, dtype=np.int64)
        self.at = np.zeros(1, dtype=np.int64)

    def find(self, words: pa.StringArray) -> np.ndarray:
        """The place of each word, -1 for those not held."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def add(self, words: pa.StringArray, chosen: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        chosen = chosen[:self.most - len(self.words)]
        if len(chosen):
            n = np.diff(at)[chosen]
            self.words = pa.concat_arrays([self.words, words.take(pa.array(chosen))])
            self.ids = np.concatenate((self.ids, ids[ragged(at[:-1][chosen], n)]))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n)))


def _encode_tails(words: list[str], encode: Callable[[list[str]], Encoded], token_bytes: np.ndarray) -> Encoded:
    """Ids of " word" for each word: many joined to a text, parted again by their bytes."""
    texts = [" " + " ".join(words[n:n + JOINED]) for n in range(0, len(words), JOINED)]
    ids, _ = encode(texts)
    unit_ends = np.cumsum([len(w.encode()) + 1 for w in words])
    token_ends = np.cumsum(token_bytes[ids], dtype=np.int64)
    at = np.searchsorted(token_ends, unit_ends) + 1
    if len(at) and (at[-1] != len(ids) or not np.array_equal(token_ends[at - 1], unit_ends)):
        raise ValueError("a token reaches across words")
    return ids, np.concatenate(([0], at))


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of at most so many bytes, or one row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, hi
        lo = hi


def encode_texts(texts: pa.StringArray, encode: Callable[[list[str]], Encoded], token_bytes: np.ndarray, cache: Cache | None = None, shared: int = SHARED_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For one slice of the texts after the other: its first and last row, the ids and
    where each row's ids begin. Nulls count as empty. token_bytes: bytes of each id;
    shared: words are made distinct within so many bytes of text."""
    texts = pc.fill_null(texts, "")
    for a, b in blocks(pc.binary_length(texts).to_numpy(), shared):
        for lo, hi, ids, at in _encode_shared(texts.slice(a, b - a), encode, token_bytes, cache or Cache(0)):
            yield a + lo, a + hi, ids, at


def _encode_shared(texts: pa.StringArray, encode: Callable[[list[str]], Encoded], token_bytes: np.ndarray, cache: Cache) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    whole = pc.match_substring_regex(texts, IRREGULAR)
    parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    first = parts.offsets.to_numpy()
    flat = parts.flatten()
    heads = pc.if_else(whole, texts, flat.take(pa.array(first[:-1]))).dictionary_encode()
    head_ids, head_at = encode(heads.dictionary.to_pylist())
    words = flat.dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    is_head = np.zeros(len(code), dtype=bool)
    is_head[first[:-1]] = True
    used = np.bincount(code[~is_head], minlength=len(words.dictionary))
    tails = np.flatnonzero(used)
    tail_words = words.dictionary.take(pa.array(tails))
    held = cache.find(tail_words)
    fresh = np.flatnonzero(held < 0)
    fresh_words = tail_words.take(pa.array(fresh))
    tail_ids, tail_at = _encode_tails(fresh_words.to_pylist(), encode, token_bytes)
    pool = np.concatenate((head_ids, tail_ids, cache.ids))
    # Where the ids of a unit lie in the pool: tails by word, heads by text.
    start, length = np.zeros(len(used), dtype=np.int64), np.zeros(len(used), dtype=np.int64)
    start[tails[fresh]], length[tails[fresh]] = len(head_ids) + tail_at[:-1], np.diff(tail_at)
    known, place = tails[held >= 0], held[held >= 0]
    start[known], length[known] = len(head_ids) + len(tail_ids) + cache.at[place], np.diff(cache.at)[place]
    cache.add(fresh_words, np.flatnonzero(used[tails[fresh]] > 1), tail_ids, tail_at)
    head_code = heads.indices.to_numpy()
    head_start, head_length = head_at[:-1][head_code], np.diff(head_at)[head_code]
    for lo, hi in blocks(pc.binary_length(texts).to_numpy(), BLOCK_BYTES):
        a, b = first[lo], first[hi]
        s, n = start[code[a:b]], length[code[a:b]]
        s[first[lo:hi] - a], n[first[lo:hi] - a] = head_start[lo:hi], head_length[lo:hi]
        ends = bounds(n)
        yield lo, hi, pool[ragged(s, n)], ends[first[lo:hi + 1] - a]
