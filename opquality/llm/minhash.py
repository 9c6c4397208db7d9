"""Near duplicates by one-permutation hashing.

One hash of each shingle serves all bins: its first bits name the bin, the least hash of a
bin is its value. An empty bin takes over the value of the first bin that is not empty in
an order of its own, a pseudo-random walk over all bins (optimal densification), so that
two sets agree in each bin about as often as they are similar, however small they are.

Bands of values are buckets. In each bucket members are candidates of one hub, a star in
place of all pairs; what the stars leave in different components goes on in rounds, see
settle.py. Links are confirmed on the whole sets.

With 32 bands of 4 bins, two sets at a similarity of just 0.85 share no bucket with a
probability of (1 - 0.85^4)^32, some 6 in 10^11; more similar ones with a smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opquality.llm.common import cut_counted, map_arrow, write_parquet
from opquality.llm.jaccard_join import fingerprints, readers, shingle_sets, signatures, signed_sets
from opquality.llm.settle import Compare, settle
from opquality.llm.wordhash import MULTIPLIER, mix

WORDS = 5
PERCENT = 85
# Bins are a power of 2.
BINS, BAND = 128, 4
EMPTY = np.uint64((1 << 64) - 1)


def bin_values(value: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin, a row per set, from sorted hashes of each set."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = (value >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    least = np.ones(len(value), dtype=bool)
    least[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    out = np.full((len(at) - 1, bins), EMPTY)
    out[owner[least], place[least]] = value[least]
    return out


def densified(values: np.ndarray) -> np.ndarray:
    """Empty bins filled from the first bin on their walk that was not empty. A walk has
    a start and an odd step of its own, so it meets every bin; empty sets stay empty."""
    bins = values.shape[1]
    rng = np.random.default_rng(20170801)
    start, step = rng.integers(0, bins, bins), 2 * rng.integers(0, bins // 2, bins) + 1
    out = values.copy()
    row, place = np.nonzero(values == EMPTY)
    some = (values != EMPTY).any(axis=1)
    row, place = row[some[row]], place[some[row]]
    at = start[place]
    while len(row):
        found = values[row, at]
        full = found != EMPTY
        out[row[full], place[full]] = found[full]
        row, place, at = row[~full], place[~full], at[~full]
        at = (at + step[place]) % bins
    return out


def band_keys(values: np.ndarray, band: int) -> np.ndarray:
    """A bucket key per set and band; bands have keys of their own."""
    parts = values.reshape(len(values), -1, band)
    key = np.arange(parts.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    key = np.repeat(key, len(values), axis=0)
    for k in range(band):
        key = mix(key * MULTIPLIER + parts[:, :, k])
    return key.view(np.int64)


def _long_lists(rows: np.ndarray) -> pa.Array:
    edges = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(rows.reshape(-1)))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bins: int = BINS, band: int = BAND,
) -> DataFrame:
    """Per row of df: its id, n_shingles (distinct runs of so many lower-cased words; all
    words as one if there are fewer), component_id (the least id that links lead to) and
    kept, whether its id is that one.

    Two documents link if 100 * common >= percent * all shingles of the two. Null, empty and
    blank texts have no shingles and link with nothing; equal texts link. Texts of any
    length are read whole, a slice of texts at a time. Repeated rows are rows of the result.
    Of rows without an id component_id is the least id of the others of their component; if
    there is none, it is null and they are kept. An empty table gives an empty one. Columns
    beside these two do not matter, whatever their names.
    """
    id_, text = df[f"`{id_col}`"].cast("long"), df[f"`{text_col}`"].cast("string")
    docs = df.select(id_.alias("doc"), text.alias("text")).withColumn("row", F.xxhash64(F.col("doc").isNull(), "doc", "text"))
    seed = 0
    while True:
        def measure(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, value, at in shingle_sets(batch.column(2), words, seed):
                    first, second = fingerprints(value, at)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int32)), pa.array(first), pa.array(second),
                        signatures(value, at), _long_lists(band_keys(densified(bin_values(value, at, bins)), band)),
                    ], names=["doc", "row", "n", "id", "check", "signature", "bands"])

        rows = write_parquet(map_arrow(docs.select("doc", "row", "text"), measure, "doc long, row long, n int, id long, check long, signature array<long>, bands array<long>"), "minhash-rows")
        # Documents of one set, by its fingerprint, and one row to read the set from.
        classes, count = cut_counted(rows.where("n > 0").groupBy("id").agg(
            F.min("doc").alias("doc"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"),
        ))
        if classes.where("c0 <> c1").isEmpty():
            break
        seed += 1
    chosen = rows.where("n > 0").join(classes.select("id", "row"), ["id", "row"], "left_semi")
    entries = chosen.select("id", "n", "bands").dropDuplicates(["id"]).select(F.explode("bands").alias("key"), "id", "n")
    # Buckets of the same sets are one list, named by a hash of these, with the number of its
    # buckets; different ones of one hash would be one list of all their sets.
    name = F.expr("bit_xor(xxhash64(id))")
    several = entries.groupBy("key").agg(F.min("id").alias("_i0"), F.max("id").alias("_i1"), name.alias("_name")).where("_i0 <> _i1").select("key", "_name")
    named = entries.join(several, "key").groupBy(F.col("_name").alias("key"), "id", "n").agg(F.count(F.lit(1)).alias("times"))
    lists = write_parquet(named, "minhash-buckets")

    signatures_of = signed_sets(rows, classes, count)
    compare = Compare(signatures_of, *readers(docs, classes, count, words, seed), percent)
    labels = settle(lists, signatures_of, compare.linked, percent, thin=compare.marked, whole=compare.whole)
    component = classes.join(labels, classes.id == labels.node, "left").select("id", "doc", F.coalesce("label", "id").alias("label"))
    least = component.groupBy("label").agg(F.min("doc").alias("component_id"))
    placed = component.join(least, "label").select(F.col("id").alias("_id"), "component_id")
    out = rows.select("doc", "n", "id").join(placed, (F.col("id") == F.col("_id")) & (F.col("n") > 0), "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id"), F.col("doc").eqNullSafe(component_id).alias("kept"))
