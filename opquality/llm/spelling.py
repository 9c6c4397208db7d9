"""Groups of spelling variants, by a dictionary of pairs of trie nodes.

The nodes of two tries are numbered, one of the words and one of the words read backwards.
A node of the first stands for a beginning, one of the second for an ending, so a pair of
numbers stands for a string, whatever its length, and equal pairs for equal strings:

* a word enters each pair (beginning of i, the rest) of itself, and
* each pair that skips its code point i.

Two words differ by one replaced code point if they skip one at the same pair, and by one
inserted or deleted code point if one skips it where the other is split. A pair has at most
as many words as there are code points that fit its gap, and one without a gap.

The numbers come from a sorted table: a word has the nodes of the word before it up to
their common beginning, and new ones after that. Each range of the table numbers its own;
what its first word shares with the range before is taken over from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opquality.llm.common import cut, map_arrow, write_parquet
from opquality.llm.units import bounds

# Words are numbered in pieces of so many.
WORDS_AT_ONCE = 1 << 13
SPLIT, SKIP, FIRST_SKIP = 0, 1, 2


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and where each word's begin."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, bounds([len(w) for w in words])


def common_beginnings(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many first code points each word shares with the one before it."""
    length, shared, depth = np.diff(at), np.zeros(len(at) - 1, dtype=np.int64), 0
    still = np.arange(1, len(length))
    while len(still):
        still = still[(length[still] > depth) & (length[still - 1] > depth)]
        still = still[codes[at[still] + depth] == codes[at[still - 1] + depth]]
        shared[still] += 1
        depth += 1
    return shared


class TrieNumbers:
    """Numbers of trie nodes for sorted words that come in pieces: 1, 2, ... in the order
    in which nodes are first met, so the first word's are 1 to its length."""

    def __init__(self) -> None:
        self.count = 0
        self.words = 0
        self.last = ""
        self.path = np.zeros(0, dtype=np.int64)

    def add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The nodes on each word's way, one after the other, and where each word's begin."""
        codes, at = codes_of([self.last, *words])
        length = np.diff(at)
        shared = common_beginnings(codes, at)
        depth = np.arange(len(codes)) - np.repeat(at[:-1], length)
        new = depth >= np.repeat(shared, length)
        number = np.zeros(len(codes), dtype=np.int64)
        own = len(self.path)
        number[:own], new[:own] = self.path, False
        number[new] = self.count + 1 + np.arange(np.count_nonzero(new))
        self.count += np.count_nonzero(new)
        new[:own] = True
        # At each depth, a node that is not new is the last one met.
        order = np.argsort(depth, kind="stable")
        met = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))
        number[order] = number[order][met]
        self.words += len(words)
        if words:
            self.last, self.path = words[-1], number[at[-2]:]
        return number[own:], at[1:] - own


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, WORDS_AT_ONCE):
            yield batch.slice(lo, WORDS_AT_ONCE)


class Ranges:
    """How the ranges of a sorted table hang together: what to add to the numbers of
    nodes and words of each, and the numbers of the nodes that its first word has from
    the range before. Holds two words a range, whatever the size of the table."""

    def __init__(self, rows: list) -> None:
        self.nodes_before: dict[int, int] = {}
        self.words_before: dict[int, int] = {}
        self.taken_over: dict[int, np.ndarray] = {}
        nodes = words = 0
        last, path = "", np.zeros(0, dtype=np.int64)
        for row in sorted(rows, key=lambda r: r.part):
            shared = int(common_beginnings(*codes_of([last, row.first]))[1])
            self.nodes_before[row.part], self.words_before[row.part] = nodes, words
            self.taken_over[row.part] = path[:shared]
            last, path = row.last, self.numbers(row.part, np.array(row.path, dtype=np.int64))
            nodes, words = nodes + row.nodes, words + row.words

    def numbers(self, part: int, own: np.ndarray) -> np.ndarray:
        """Numbers over the whole table, from those of one range."""
        taken = self.taken_over[part]
        out = own + self.nodes_before[part]
        inside = own <= len(taken)
        out[inside] = taken[own[inside] - 1]
        return out


def _ranges(placed: DataFrame, word: str) -> Ranges:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, part, first = TrieNumbers(), None, None
        for batch in _pieces(batches):
            words = batch.column(1).to_pylist()
            if part is None:
                part, first = batch.column(0)[0].as_py(), words[0]
            numbers.add(words)
        if part is not None:
            yield pa.RecordBatch.from_pylist([{
                "part": part, "first": first, "last": numbers.last, "path": numbers.path.tolist(), "nodes": numbers.count, "words": numbers.words,
            }], schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("path", pa.list_(pa.int64())), ("nodes", pa.int64()), ("words", pa.int64())]))

    found = map_arrow(placed.select("part", word), tasks, "part int, first string, last string, path array<long>, nodes long, words long")
    # One row per range.
    return Ranges(found.collect())


def _sorted(df: DataFrame, by: str) -> DataFrame:
    """Sorted and cut, so that its ranges stay what they are; part is a row's range."""
    return cut(df.orderBy(by)).withColumn("part", F.spark_partition_id())


def _with_beginnings(words: DataFrame) -> DataFrame:
    """words: word, n. Adds rank, a word's place in code-point order, and beginnings, the
    numbers of its beginnings from the empty one on."""
    placed = _sorted(words, "word")
    ranges = _ranges(placed, "word")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TrieNumbers()
        for batch in _pieces(batches):
            part, before = batch.column(0)[0].as_py(), numbers.words
            nodes, at = numbers.add(batch.column(1).to_pylist())
            nodes = np.insert(ranges.numbers(part, nodes), at[:-1], 0)
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(2), pa.array(ranges.words_before[part] + before + np.arange(batch.num_rows)),
                pa.ListArray.from_arrays(pa.array((at + np.arange(len(at))).astype(np.int32)), pa.array(nodes)),
            ], names=["word", "n", "rank", "beginnings"])

    return map_arrow(placed.select("part", "word", "n"), tasks, "word string, n long, rank long, beginnings array<long>")


def _entries(placed: DataFrame, ranges: Ranges) -> DataFrame:
    """The dictionary: pairs (beginning, ending) with the rank and n of the words that have
    them, and how: split there, or with one code point skipped. Of a run of equal code
    points only the first is marked, since skipping any of them gives the same string."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TrieNumbers()
        for batch in _pieces(batches):
            part, backwards = batch.column(0)[0].as_py(), batch.column(1).to_pylist()
            nodes, at = numbers.add(backwards)
            ending = np.insert(ranges.numbers(part, nodes), at[:-1], 0)
            beginning = batch.column(4).flatten().to_numpy()
            length, start = np.diff(at), at[:-1] + np.arange(len(at) - 1)
            word = np.repeat(np.arange(len(length)), length)
            i = np.arange(at[-1]) - at[word]
            skips = (beginning[start[word] + i], ending[start[word] + length[word] - 1 - i])
            codes, _ = codes_of(backwards)
            here = codes[at[word] + length[word] - 1 - i]
            first = np.ones(len(i), dtype=bool)
            first[1:] = (here[1:] != here[:-1]) | (i[1:] == 0)
            both = np.repeat(np.arange(len(length)), length + 1)
            j = np.arange(len(both)) - start[both]
            splits = (beginning[start[both] + j], ending[start[both] + length[both] - j])
            who = np.concatenate((word, both))
            yield pa.RecordBatch.from_arrays([
                *(pa.array(np.concatenate(x)) for x in zip(skips, splits)),
                batch.column(3).take(pa.array(who)), batch.column(2).take(pa.array(who)),
                pa.array(np.concatenate((np.where(first, FIRST_SKIP, SKIP), np.full(len(both), SPLIT))).astype(np.int8)),
            ], names=["beginning", "ending", "rank", "n", "kind"])

    return map_arrow(placed.select("part", "backwards", "n", "rank", "beginnings"), tasks, "beginning long, ending long, rank long, n long, kind byte")


def _near(entries: DataFrame) -> DataFrame:
    """Per word with near words: their number and the best of them, as (n, -rank). Words
    that meet at a pair are one list, no longer than the alphabet and one more."""
    member = F.struct("n", (-F.col("rank")).alias("back"), "kind")
    met = entries.repartition("beginning", "ending").groupBy("beginning", "ending").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)

    def near(a: Column, b: Column) -> Column:
        replaced = (a["kind"] != SPLIT) & (b["kind"] != SPLIT) & (a["back"] != b["back"])
        return replaced | (F.abs(a["kind"] - b["kind"]) == FIRST_SKIP)

    def of(a: Column) -> Column:
        others = F.transform(F.filter("members", lambda b: near(a, b)), lambda b: F.struct(b["n"].alias("n"), b["back"].alias("back")))
        return F.struct(a["back"].alias("back"), F.size(others).alias("many"), F.array_max(others).alias("best"))

    each = met.select(F.explode(F.transform("members", of)).alias("m")).where("m.many > 0")
    return each.groupBy((-F.col("m.back")).alias("rank")).agg(F.sum("m.many").alias("n_near"), F.max("m.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms: rank, form. Adds where following forms ends, by jumps of doubling length.
    A form is more frequent than its word by a factor, so the ways are short."""
    at = cut(forms.select("rank", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(ahead, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("rank", "root")
        at = at.select("rank", "root")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """words: word, n, each word once. Per word: word, n, form, root, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes the one of the
    other; n_near counts a word's near words. form is the most frequent of them, of equally
    frequent ones the first in code-point order, if its n is at least ratio times the
    word's, and form_n that n; else both are null. root is where forms lead, the word itself
    if it has none. Null words are left out, the empty word is one like any other, and an
    empty table gives an empty one. Words of any length cost in proportion to it. The
    columns of words beside these two do not matter.
    """
    named = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word is not null")
    backwards = _with_beginnings(named).select(F.reverse("word").alias("backwards"), "n", "rank", "beginnings")
    placed = _sorted(backwards, "backwards")
    near = cut(_near(_entries(placed, _ranges(placed, "backwards"))))
    known = write_parquet(placed.select("rank", F.reverse("backwards").alias("word"), "n"), "spelling-words")
    ranked = cut(known.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.struct((-F.col("best.back")).alias("rank"), F.col("best.n").alias("n"))).alias("form"),
    ))
    changed = ranked.where("form is not null").select("rank", F.col("form.rank").alias("form"))
    names = known.select(F.col("rank").alias("_rank"), F.col("word").alias("_word"))
    led = _roots(changed).join(changed, "rank")
    for column in ("form", "root"):
        led = led.join(names, F.col(column) == F.col("_rank")).drop("_rank", column).withColumnRenamed("_word", column)
    return ranked.select("rank", "word", "n", "n_near", F.col("form.n").alias("form_n")).join(led, "rank", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n",
    )


def count_words(runs: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """runs: word, one row per occurrence. The distinct words that are long enough and
    occur often enough, with their number n."""
    return runs.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of(docs: DataFrame, least_length: int, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS) -> DataFrame:
    """id and word, per maximal run of at least so many letters of whole texts; A-Z are
    lower-cased. Null texts have none; a null id is passed on."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"{letters}{{{least_length},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("word"))


def with_planted_deletions(runs: DataFrame, every: int = 31) -> DataFrame:
    """runs: id, word. Deletes one code point of each run whose hash, the crc32 of
    `<id>:<run>`, is divisible by every: that at the hash modulo the length. The id counts
    as its text, a null one as empty."""
    hashed = runs.withColumn("_hash", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")))
    at = (F.col("_hash") % F.char_length("word")).cast("int")
    rest = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return hashed.select(F.when(F.col("_hash") % every == 0, rest).otherwise(F.col("word")).alias("word"))
