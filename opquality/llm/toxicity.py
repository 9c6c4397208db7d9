"""Toxicity from confirmed toxic examples and unlabelled text only.

A linear model over hashed words learns by non-negative positive-unlabelled risk: with
the share p of toxic texts among unlabelled ones, the risk of taking clean text for
toxic is that of the unlabelled texts less p times that of the positives. Where this
estimate falls below zero the model has begun to learn unlabelled texts by heart, and
the step goes the other way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.llm.common import map_arrow, write_parquet
from opquality.llm.decontaminate import IS_WORD
from opquality.llm.units import blocks, bounds
from opquality.llm.wordhash import LOWER, find_words, range_hashes, raw_bytes, text_of_word

BITS = 20
# Beginnings of so many bytes count beside whole words, for inflected and compound forms.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
SCAN_BYTES = 2 << 20
STEPS = 60
MIN_TEXTS = 4
MAX_POSITIVE = 6000


@dataclass
class Model:
    """weights by word bucket, and the score of a text without known words (a logit)."""

    weights: np.ndarray
    bias: float


def word_buckets(texts: pa.StringArray, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one slice of the texts after the other: the distinct buckets of each text's
    lower-cased words and their beginnings (the wanted ones), and where each text's begin."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    for lo, hi in blocks(sizes, SCAN_BYTES):
        data, text_at = raw_bytes(texts.slice(lo, hi - lo))
        data = LOWER[data]
        words = find_words(data, text_at, IS_WORD)
        text_of, pairs = text_of_word(words.at), []
        for ends in (words.ends, *(words.starts + n for n in BEGINNINGS)):
            long = np.flatnonzero(ends < words.ends) if ends is not words.ends else np.arange(len(ends))
            bucket = (range_hashes(data, words.starts[long], ends[long]) >> np.uint64(64 - BITS)).astype(np.int64)
            keep = slice(None) if wanted is None else wanted[bucket]
            pairs.append((text_of[long][keep] << BITS) | bucket[keep])
        own = np.unique(np.concatenate(pairs))
        yield own & ((1 << BITS) - 1), np.searchsorted(own >> BITS, np.arange(hi - lo + 1))


class Bags:
    """Sets of buckets of several texts, side by side."""

    def __init__(self, sets: list[np.ndarray]):
        self.at = bounds([len(s) for s in sets])
        self.items = np.concatenate([np.zeros(0, dtype=np.int64), *sets]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def within(self, used: np.ndarray) -> Bags:
        keep = used[self.items]
        return Bags([self.items[a:b][keep[a:b]] for a, b in zip(self.at[:-1], self.at[1:])])


def telling(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, min_texts: int = MIN_TEXTS, min_deviations: float = 6.0) -> np.ndarray:
    """Buckets that so many positives hold, and that they hold more often than chance
    would have it. in_p, in_u: texts with each bucket."""
    usual = np.maximum(in_u, 1) / max(1, n_u)
    return (in_p >= max(min_texts, n_p // 1000)) & ((in_p / max(1, n_p) - usual) >= min_deviations * np.sqrt(usual / max(1, n_p)))


def risk(bags: Bags, times: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """Texts taken for clean ones, each so many times: the sum of log(1 + e^z) for their
    logits z, and its derivative by each weight and, last, by the bias."""
    sizes = np.diff(bags.at)
    z = bias + np.bincount(np.repeat(np.arange(len(bags)), sizes), weights[bags.items], minlength=len(bags))
    slope = times / (1 + np.exp(-np.clip(z, -30, 30)))
    by_weight = np.bincount(bags.items, np.repeat(slope, sizes), minlength=len(weights))
    return float((times * np.logaddexp(0, z)).sum()), np.append(by_weight, slope.sum())


def descend(
    positive: Bags, unlabelled_risk: Callable[[np.ndarray, float], tuple[float, np.ndarray]], n_unlabelled: int, size: int, prior: float,
    steps: int = STEPS, rate: float = 0.3, decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss; each step sees every text.
    Only weights that speak for toxicity are kept, as its buckets were chosen for that."""
    w, bias, once = np.zeros(size), 0.0, np.ones(len(positive))
    held = np.append(np.bincount(positive.items, minlength=size), len(positive)) / len(positive)
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        (loss_u, up_u), (loss_p, up_p) = unlabelled_risk(w, bias), risk(positive, once, w, bias)
        up_u, up_p = up_u / n_unlabelled, up_p / len(positive)
        # A positive's loss as toxic, log(1 + e^-z), has the derivative of that as clean less one.
        clean = loss_u / n_unlabelled - prior * loss_p / len(positive)
        g = prior * (up_p - held) + up_u - prior * up_p if clean >= 0 else prior * up_p - up_u
        g[:size] += decay * w
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        change = rate * (1 - step / (steps + 1)) * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        w, bias = np.maximum(w - change[:size], 0.0), bias - float(change[size])
    return w, bias


def bucket_counts(texts: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, int]:
    """Over all rows of the one column of texts: how many hold each candidate bucket, and
    how many rows there are. One row per candidate comes to the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(candidates.astype(np.int32))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, dtype=bool)
        wanted[shared.value] = True
        found, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for items, _ in word_buckets(batch.column(0), wanted):
                found += np.bincount(items, minlength=1 << BITS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], names=["bucket", "n"])

    rows = map_arrow(texts, tasks, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros(1 << BITS, dtype=np.int64), 0
    for r in rows:
        if r.bucket < 0:
            n = r.n
        else:
            counts[r.bucket] = r.n
    return counts, n


def telling_sets(texts: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Each different set of these (sorted) buckets that a row of texts holds, as places
    in buckets, and the number of rows with it. Written, since every step reads it."""
    shared = texts.sparkSession.sparkContext.broadcast(buckets.astype(np.int32))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        wanted = np.zeros(1 << BITS, dtype=bool)
        wanted[known] = True
        for batch in batches:
            for items, at in word_buckets(batch.column(0), wanted):
                places = np.searchsorted(known, items).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([places[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["places"])

    return write_parquet(map_arrow(texts, tasks, "places binary").groupBy("places").agg(F.count(F.lit(1)).alias("n")), "toxicity-sets")


def risk_of_sets(sets: DataFrame, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """The risk of all rows behind these sets. Each task sends one loss and one derivative."""
    shared = sets.sparkSession.sparkContext.broadcast((weights, bias))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        loss, slope = 0.0, np.zeros(len(w) + 1)
        for batch in batches:
            bags = Bags([np.frombuffer(x, dtype="<u4") for x in batch.column(0).to_pylist()])
            own_loss, own_slope = risk(bags, batch.column(1).to_numpy(), w, b)
            loss, slope = loss + own_loss, slope + own_slope
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

    rows = map_arrow(sets, tasks, "loss double, slope binary").collect()
    shared.destroy()
    return sum(r.loss for r in rows), sum((np.frombuffer(r.slope) for r in rows), np.zeros(len(weights) + 1))


def collect_bags(df: DataFrame, text_col: str) -> Bags:
    """Word buckets of a bounded sample, at the driver."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items, at in word_buckets(batch.column(0)):
                packed = [items[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["buckets"])

    rows = map_arrow(df.select(F.col(text_col).cast("string").alias("text")), tasks, "buckets binary").collect()
    return Bags([np.frombuffer(r.buckets, dtype="<u4") for r in sorted(rows, key=lambda r: bytes(r.buckets))])


def fit(docs: DataFrame, toxic_ids: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, steps: int = STEPS) -> Model:
    """docs: unlabelled text to learn from; toxic_ids: ids of its confirmed toxic rows;
    prior: the share of toxic texts in docs. At most max_positive confirmed texts are used,
    those of the least hashes of id and text, and of rows that have both in common one. The
    unlabelled risk is that of every row of docs: their words are counted once, what they
    hold of the telling buckets is written as a table of different sets, and each step is
    one pass over that table. Null and empty texts are rows without words. Without
    confirmed texts, other rows or telling buckets, all texts score alike, as clean."""
    own = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("_hash"), id_col, text_col)
    # At most so many hashes are sent along, and one text comes back for each.
    confirmed = own.join(toxic_ids.select(id_col).distinct(), id_col, "left_semi")
    chosen = confirmed.select("_hash").distinct().orderBy("_hash").limit(max_positive)
    positive = collect_bags(own.join(F.broadcast(chosen), "_hash").dropDuplicates(["_hash"]), text_col)
    in_p = np.bincount(positive.items, minlength=1 << BITS)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    none = Model(np.zeros(1 << BITS), -20.0)
    candidates = np.flatnonzero(in_p >= MIN_TEXTS)
    if not len(candidates):
        return none
    in_u, n = bucket_counts(texts, candidates)
    used = telling(in_p, len(positive), in_u, n)
    if not used.any():
        return none
    buckets = np.flatnonzero(used)
    sets = telling_sets(texts, buckets)
    positive = positive.within(used)
    positive.items = np.searchsorted(buckets, positive.items)
    w, bias = descend(positive, lambda w, b: risk_of_sets(sets, w, b), n, len(buckets), prior, steps)
    weights = np.zeros(1 << BITS)
    weights[buckets] = w
    return Model(weights, bias)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of df with all its columns and `toxicity`, 0 to 1, of its whole text; 0.5
    and more is toxic. Null, empty and wordless texts get the model's base score. A column
    of df with that name is replaced."""
    known = np.flatnonzero(model.weights)
    shared = df.sparkSession.sparkContext.broadcast((known.astype(np.int32), model.weights[known], model.bias))
    rows = df.drop("toxicity")
    columns = rows.columns
    at_column = columns.index(text_col)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, values, bias = shared.value
        weights = np.zeros(1 << BITS)
        weights[buckets] = values
        for batch in batches:
            found = [np.zeros(0)]
            for items, at in word_buckets(batch.column(at_column), weights != 0):
                total = np.concatenate(([0.0], np.cumsum(weights[items])))
                found.append(1 / (1 + np.exp(-np.clip(bias + total[at[1:]] - total[at[:-1]], -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*columns, "toxicity"])

    return map_arrow(rows, tasks, T.StructType([*rows.schema.fields, T.StructField("toxicity", T.DoubleType())]))
