"""Byte-level BPE with a segment tree that holds the leftmost minimum pair rank.

The leaves stand for the byte positions of a piece; a leaf holds the rank of the pair
that begins there, with its position, and is infinite where no pair can merge. The
root then is the leftmost pair of least rank. A merge changes three leaves at most:
the pair itself, the pair on its left and the one swallowed on its right; each is a
point update along one path. Pieces of similar length go through the same steps
side by side, as rows of one array; a few long pieces go one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opquality.llm.common import map_arrow, vocabulary_cache
from opquality.llm.units import Cache, Encoded, bounds, encode_texts, ragged

INFINITE = np.iinfo(np.int64).max
FEW = 16
CELLS = 1 << 20
ID_BITS = 20


class Ranks:
    """Vocabulary by rank, which is also the id."""

    def __init__(self, path: str):
        self.cache = Cache()
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        for token, rank in self.rank.items():
            self.bytes[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes], dtype=np.int64)
        self.starts = bounds(self.lengths)[:-1]
        self.buffer = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        # Rank of each pair of ids whose bytes together are a token.
        found = [
            ((self.rank[token[:k]] << ID_BITS) | self.rank[token[k:]], rank)
            for token, rank in self.rank.items() for k in range(1, len(token))
            if token[:k] in self.rank and token[k:] in self.rank
        ]
        keys, ranks = np.array(found, dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order].copy(), ranks[order].copy()

    def pair(self, left: int, right: int) -> int | None:
        """Rank of one pair of ids, None where it does not merge."""
        key = (left << ID_BITS) | right
        at = int(self.pair_keys.searchsorted(key))
        return int(self.pair_ranks[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else None

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, INFINITE where they do not merge."""
        keys = (left << ID_BITS) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], INFINITE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.buffer[ragged(self.starts[ids], self.lengths[ids])]


@vocabulary_cache
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece."""
    n = len(piece)
    if n < 2:
        return [int(ranks.byte_ids[b]) for b in piece]
    width = 1 << (n - 2).bit_length()
    none = (1 << 62, n)
    token = [int(ranks.byte_ids[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(p: int) -> tuple[int, int]:
        q = after[p]
        rank = ranks.pair(token[p], token[q]) if q < n else None
        return none if rank is None else (rank, p)

    tree = [none] * width + [leaf(p) for p in range(n - 1)] + [none] * (width - n + 1)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(p: int, value: tuple[int, int]) -> None:
        k = width + p
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    while tree[1] is not none and tree[1] != none:
        rank, p = tree[1]
        q = after[p]
        token[p], after[p], token[q] = rank, after[q], -1
        if after[q] < n:
            before[after[q]] = p
        if q < n - 1:
            update(q, none)
        update(p, leaf(p))
        if before[p] >= 0:
            update(before[p], leaf(before[p]))
    return [t for t in token if t >= 0]


def merge_many(pieces: list[bytes], ranks: Ranks, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number for pieces of 2 to width + 1 bytes, all at once."""
    m, stride = len(pieces), 2 * width
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    column = np.arange(width + 1)
    live = column < sizes[:, None]
    token = np.zeros((m, width + 1), dtype=np.int64)
    token[live] = ranks.byte_ids[raw]
    after = np.broadcast_to(column + 1, (m, width + 1)).copy()
    before = np.broadcast_to(column - 1, (m, width + 1)).copy()
    tree = np.full((m, 2 * width), INFINITE, dtype=np.int64)
    rank = ranks.pairs(token[:, :-1], token[:, 1:])
    can = live[:, 1:] & (rank != INFINITE)
    leaves = tree[:, width:]
    leaves[can] = (rank * stride + column[:-1])[can]
    k = width
    while k > 1:
        tree[:, k // 2:k] = np.minimum(tree[:, k:2 * k:2], tree[:, k + 1:2 * k:2])
        k //= 2

    # Flat views: a row's own cells begin at its offset.
    cells, tokens, nexts = tree.reshape(-1), token.reshape(-1), after.reshape(-1)
    stride_of, levels = width + 1, width.bit_length() - 1

    def update(r: np.ndarray, p: np.ndarray, value: np.ndarray) -> None:
        base, k = r * stride, p + width
        cells[base + k] = value
        for _ in range(levels):
            k = k >> 1
            child = base + 2 * k
            cells[base + k] = np.minimum(cells.take(child), cells.take(child + 1))

    def leaf(r: np.ndarray, p: np.ndarray) -> np.ndarray:
        at = r * stride_of
        q = nexts.take(at + p)
        end = q >= sizes.take(r)
        rank = ranks.pairs(tokens.take(at + p), tokens.take(at + np.where(end, p, q)))
        return np.where(end | (rank == INFINITE), INFINITE, rank * stride + p)

    r = np.flatnonzero(tree[:, 1] != INFINITE)
    while len(r):
        rank, p = np.divmod(tree[r, 1], stride)
        q = after[r, p]
        nxt = after[r, q]
        token[r, p], after[r, p], live[r, q] = rank, nxt, False
        inner = nxt < sizes[r]
        before[r[inner], nxt[inner]] = p[inner]
        inner = q < width
        update(r[inner], q[inner], np.full(int(inner.sum()), INFINITE))
        update(r, p, leaf(r, p))
        left = before[r, p]
        inner = left >= 0
        update(r[inner], left[inner], leaf(r[inner], left[inner]))
        r = r[tree[r, 1] != INFINITE]
    return token[live], live.sum(axis=1)


def merge_pieces(pieces: list[bytes], ranks: Ranks) -> Encoded:
    """Ids of each piece, one piece after the other."""
    counts = np.ones(len(pieces), dtype=np.int64)
    known, groups = [], []
    by_width: dict[int, list[int]] = {}
    for n, piece in enumerate(pieces):
        rank = ranks.rank.get(piece)
        if rank is not None:
            known.append((n, rank))
        else:
            by_width.setdefault(1 << max(0, len(piece) - 2).bit_length(), []).append(n)
    for width, group in by_width.items():
        step = max(1, CELLS // width)
        for lo in range(0, len(group), step):
            part = group[lo:lo + step]
            if len(part) < FEW:
                each = [merge_one(pieces[n], ranks) for n in part]
                ids, sizes = np.array([t for x in each for t in x], dtype=np.int64), np.array([len(x) for x in each])
            else:
                ids, sizes = merge_many([pieces[n] for n in part], ranks, width)
            counts[part] = sizes
            groups.append((np.array(part), ids))
    at = bounds(counts)
    out = np.zeros(at[-1], dtype=np.int64)
    if known:
        where, rank = np.array(known, dtype=np.int64).T
        out[at[where]] = rank
    for part, ids in groups:
        out[ragged(at[part], counts[part])] = ids
    return out, at


# White space as the Unicode property has it, which Python's \s exceeds.
SPACES = r"\t-\r \x85\xa0  -     　"


@vocabulary_cache
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))


def encoder(ranks: Ranks, pattern: str):
    """A function from texts to their ids, piece by piece, each distinct piece once."""
    find = splitter(pattern).findall

    def encode(texts: list[str]) -> Encoded:
        index: dict[str, int] = {}
        code, per_text = [], []
        for text in texts:
            pieces = find(text)
            per_text.append(len(pieces))
            code += [index.setdefault(p, len(index)) for p in pieces]
        ids, at = merge_pieces([p.encode() for p in index], ranks)
        code = np.array(code, dtype=np.int64)
        lengths = np.diff(at)[code]
        return ids[ragged(at[:-1][code], lengths)], bounds(lengths)[bounds(per_text)]

    return encode


def bpe_roundtrip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df its id, `ids` (array of int: the text's tokens, piece by piece) and
    `decoded` (binary: the bytes that these ids stand for).

    A null text counts as empty and has no ids; texts are taken whole. Rows, repeated
    ones too, are treated one by one; an empty table gives an empty table. Other columns
    are left out. vocabulary: a file of base64 tokens and ranks that every executor can
    open; pattern: the pre-tokenisation.
    """
    schema = df.select(F.col(id_col)).schema
    kind = schema[0].dataType.simpleString()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        encode = encoder(ranks, pattern)
        for batch in batches:
            for lo, hi, ids, at in encode_texts(batch.column(1), encode, ranks.lengths, ranks.cache):
                decoded = ranks.decode(ids)
                ends = bounds(ranks.lengths[ids])[at]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded)]),
                ], names=["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, tasks, f"id {kind}, ids array<int>, decoded binary", vocabularies=True).withColumnRenamed("id", id_col)
