"""Benchmark decontamination: training texts are scanned for windows of benchmark words.

The windows of the benchmark are hashed into a set that is broadcast; a benchmark of
more than BLOCK_BYTES of different items is taken in blocks of at most that size, one
scan after the other, so the broadcast is bounded (only a single longer item is a larger
block). A hit of the hash set is verified on the words themselves before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.llm.common import map_arrow, write_parquet
from opquality.llm.units import blocks, bounds, ragged
from opquality.llm.wordhash import LOWER, find_words, range_hashes, raw_bytes, run_bounds, text_of_word, window_hashes

WINDOW = 13
BLOCK_BYTES = 16 << 20
SCAN_BYTES = 2 << 20
FILTER_BITS = 22
# Bits of the hash that items are put in order by, for blocks.
ORDER_BITS = 62

# Word bytes after lower-casing: digits, a-z and every byte beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

SPANS = "array<struct<first_word:int,last_word:int,start:int,end:int>>"
ADDED = ["n_words", "n_hit", "items", "spans", "kept_text", "contaminated"]


@dataclass
class Windows:
    """Distinct windows of one length, sorted by hash: their text (words joined by a
    space, a range of the block's normalised bytes) and their items."""

    words: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    filter: np.ndarray


@dataclass
class Index:
    normal: bytes
    names: list[str]
    windows: list[Windows]


def normalised(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts joined by a space; where each begins in that, with the end
    last; their hashes; and how many words each text has. One slice after the other."""
    joined, lengths, hashes, counts = [], [], [], []
    column = pa.array(texts, pa.string())
    for lo, hi in blocks(pc.fill_null(pc.binary_length(column), 0).to_numpy(), SCAN_BYTES):
        data, text_at = raw_bytes(column.slice(lo, hi - lo))
        data = LOWER[data]
        words = find_words(data, text_at, IS_WORD)
        size = words.ends - words.starts
        at = bounds(size + 1)
        out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
        out[ragged(at[:-1], size)] = data[ragged(words.starts, size)]
        joined.append(out.tobytes())
        lengths.append((size + 1).astype(np.int32))
        hashes.append(range_hashes(data, words.starts, words.ends))
        counts.append(np.diff(words.at))
    none = np.zeros(0, dtype=np.int64)
    return b"".join(joined), bounds(np.concatenate([none, *lengths])), np.concatenate([none.astype(np.uint64), *hashes]), np.concatenate([none, *counts])


def _equal_windows(value: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of their hashes, equal ones side by side, and which are the first
    of their like. Neighbours of one hash are compared as text."""
    order = np.argsort(value, kind="stable").astype(np.int32)
    new = np.ones(len(order), dtype=bool)
    new[1:] = value[order[1:]] != value[order[:-1]]
    runs, clashes = np.flatnonzero(new), set()
    for k in np.flatnonzero(~new).tolist():
        if text_of(order[k]) != text_of(order[k - 1]):
            clashes.add(int(np.searchsorted(runs, k, side="right")) - 1)
    edges = np.append(runs, len(order))
    for r in clashes:
        lo, hi = edges[r], edges[r + 1]
        order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda w: (text_of(w), w))
        new[lo + 1:hi] = [text_of(x) != text_of(y) for x, y in zip(order[lo + 1:hi], order[lo:hi - 1])]
    return order, new


def build_index(names: list[str], texts: list[str | None], window: int) -> Index:
    """Windows of a block of items: each run of so many words, or all words of an item
    that has fewer."""
    normal, at, hashes, counts = normalised(texts)
    small = np.int32 if len(normal) < 1 << 31 else np.int64
    item_of, at = np.repeat(np.arange(len(counts), dtype=np.int32), counts), at.astype(small)
    found = []
    for n in sorted({min(window, int(c)) for c in np.unique(counts) if c}):
        last = np.arange(n - 1, len(hashes), dtype=np.int32)
        first = last - np.int32(n - 1)
        own = item_of[first] == item_of[last]
        own &= (counts[item_of[first]] >= window) if n == window else (counts[item_of[first]] == n)
        first = first[own]
        value = window_hashes(hashes, n)[first]
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        table[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int32)] = True
        del last, own
        # Equal windows, not equal hashes, are one entry.
        order, new = _equal_windows(value, lambda w: normal[at[first[w]]:at[first[w] + n] - 1])
        entry = (np.cumsum(new) - 1) * len(names) + item_of[first[order]]
        pairs = np.unique(entry)
        place = first[order[new]]
        found.append(Windows(
            n, value[order[new]], at[place], at[place + n] - small(1),
            np.searchsorted(pairs, np.arange(len(place) + 1) * len(names)).astype(small), (pairs % len(names)).astype(np.int32), table,
        ))
    return Index(normal, names, found)


def scan_block(data: np.ndarray, text_at: np.ndarray, index: Index):
    """Words of some texts, which of them are hit, and pairs (text, item)."""
    lower = LOWER[data]
    words = find_words(lower, text_at, IS_WORD)
    hashes = range_hashes(lower, words.starts, words.ends)
    text_of = text_of_word(words.at)
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    pairs: set[tuple[int, int]] = set()
    for w in index.windows:
        value = window_hashes(hashes, w.words)
        maybe = np.flatnonzero(w.filter[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        maybe = maybe[text_of[maybe] == text_of[maybe + w.words - 1]]
        at = np.searchsorted(w.hashes, value[maybe])
        known = at < len(w.hashes)
        known[known] = w.hashes[at[known]] == value[maybe[known]]
        for k, g in zip(maybe[known].tolist(), at[known].tolist()):
            last = k + w.words
            own = b" ".join(lower[s:e].tobytes() for s, e in zip(words.starts[k:last].tolist(), words.ends[k:last].tolist()))
            h = w.hashes[g]
            while g < len(w.hashes) and w.hashes[g] == h:
                if index.normal[w.starts[g]:w.ends[g]] == own:
                    change[k] += 1
                    change[last] -= 1
                    doc = int(text_of[k])
                    pairs.update((doc, i) for i in w.items[w.item_at[g]:w.item_at[g + 1]].tolist())
                    break
                g += 1
    return words, np.cumsum(change[:-1]) > 0, pairs


def _scan(df: DataFrame, index: Broadcast, columns: list[str], text_col: str, hit_share: int) -> DataFrame:
    """One pass; spans and items of an earlier pass are taken over."""
    again = "spans" in df.columns
    added_fields = T.StructType.fromDDL(f"n_words long, n_hit long, items array<string>, spans {SPANS}, kept_text string, contaminated boolean").fields
    schema = T.StructType([df.schema[c] for c in columns] + added_fields)
    text_at_column = df.columns.index(text_col)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            texts = batch.column(text_at_column)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            for lo, hi in blocks(sizes, SCAN_BYTES):
                part = batch.slice(lo, hi - lo)
                data, text_at = raw_bytes(part.column(text_at_column))
                words, hit, pairs = scan_block(data, text_at, block)
                items: list[set[str]] = [set() for _ in range(hi - lo)]
                for doc, item in pairs:
                    items[doc].add(block.names[item])
                if again:
                    for doc, (spans, known) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
                        items[doc].update(known)
                        for s in spans:
                            hit[words.at[doc] + s["first_word"]:words.at[doc] + s["last_word"] + 1] = True
                n_words = np.diff(words.at)
                total = bounds(hit)
                n_hit = total[words.at[1:]] - total[words.at[:-1]]
                spans, kept = [], []
                for doc in range(hi - lo):
                    a, own = words.at[doc], data[text_at[doc]:text_at[doc + 1]]
                    found = []
                    if n_hit[doc]:
                        for first, after in zip(*run_bounds(hit[a:words.at[doc + 1]])):
                            found.append({"first_word": int(first), "last_word": int(after) - 1, "start": int(words.starts[a + first] - text_at[doc]), "end": int(words.ends[a + after - 1] - text_at[doc])})
                    edges = [0, *(x for s in found for x in (s["start"], s["end"])), len(own)]
                    kept.append(b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])).decode() if found else None)
                    spans.append(found)
                kept_text = pc.coalesce(pa.array(kept, pa.string()), part.column(text_at_column))
                added = [
                    pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([(n, pa.int32()) for n in ("first_word", "last_word", "start", "end")]))),
                    kept_text, pa.array((n_hit > 0) & (hit_share * n_hit >= n_words)),
                ]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + added, names=columns + ADDED)

    return map_arrow(df, tasks, schema)


def _block_ranges(items: DataFrame, total: int, block_bytes: int) -> list[tuple[int, int]]:
    """Ranges of `at` (from, before) that hold at most block_bytes of text each, by the
    running sum over slices of `at`; a slice with more is cut finer while it has several items."""
    slices: list[tuple[int, int, int]] = []
    bits = min(ORDER_BITS, (16 * -(-total // block_bytes)).bit_length())
    open_ = items
    while True:
        width = 1 << (ORDER_BITS - bits)
        sums = open_.groupBy(F.shiftright("at", ORDER_BITS - bits).alias("slice")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        full = [r.slice for r in sums if r.bytes > block_bytes and r.n > 1 and bits < ORDER_BITS]
        slices += [(r.slice * width, (r.slice + 1) * width, r.bytes) for r in sums if r.slice not in full]
        if not full:
            break
        open_ = open_.where(F.shiftright("at", ORDER_BITS - bits).isin(full))
        bits = min(ORDER_BITS, bits + 6)
    ranges, held = [], 0
    for lo, hi, size in sorted(slices):
        if ranges and held + size <= block_bytes:
            ranges[-1], held = (ranges[-1][0], hi), held + size
        else:
            ranges.append((lo, hi))
            held = size
    return ranges


def scan(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, hit_share: int = 20, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every row of df with all its columns, and

    n_words       words of the text (runs of digits, letters a-z in either case, or
                  characters beyond ASCII); a null or empty text has none
    n_hit         words inside an occurrence of a benchmark window: so many consecutive
                  words of an item, or all words of an item that has fewer
    items         ids of the items with such windows, as sorted strings
    spans         maximal runs of hit words: their numbers and bytes in the UTF-8 text
    kept_text     the text without the bytes of the spans
    contaminated  at least one word and one in hit_share of all words are hit

    Items with equal texts all count; a null item id reads as the empty string and items
    without words have no window. Columns of df named like a new one are replaced. Rows
    are treated one by one, repeated ones too, and an empty benchmark hits nothing.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    # A repeated item adds neither a window nor an id.
    items = items.distinct()
    columns = [c for c in df.columns if c not in ADDED]
    out = df.select(columns)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    ranges = [(0, 1 << ORDER_BITS)]
    if total > block_bytes:
        items = write_parquet(items.withColumn("at", F.shiftrightunsigned(F.xxhash64("id", "text"), 64 - ORDER_BITS)), "benchmark")
        ranges = _block_ranges(items, total, block_bytes)
    for n, (lo, hi) in enumerate(ranges):
        rows = (items if len(ranges) == 1 else items.where((F.col("at") >= lo) & (F.col("at") < hi))).select("id", "text").collect()
        index = df.sparkSession.sparkContext.broadcast(build_index([r.id for r in rows], [r.text for r in rows], window))
        out = _scan(out, index, columns, text_col, hit_share)
        if n < len(ranges) - 1:
            out = write_parquet(out, "decontaminate")
    return out


def _under_other_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"_own_{c}" for c in df.columns if c in ADDED})


def _under_own_names(found: DataFrame, df: DataFrame) -> DataFrame:
    return found.select([F.col(f"_own_{c}" if c in ADDED else c).alias(c) for c in df.columns])


def without_contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of df that are not contaminated, with the columns and texts they came with."""
    found = scan(_under_other_names(df), benchmark, **options)
    return _under_own_names(found.where(~F.col("contaminated")), df)


def without_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows of df; hit words are cut out of the texts."""
    found = scan(_under_other_names(df), benchmark, text_col=text_col, **options)
    return _under_own_names(found.withColumn(text_col, F.col("kept_text")), df)
