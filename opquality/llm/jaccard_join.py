"""Size-aware heavy-light join of documents on their word shingles.

Sets are put in one global order of shingles, common ones last. Sets that overlap enough
share shingles among their first few, and the number of those depends on the size only.

* Small sets list every pair of their first shingles; two small sets that link have such
  a pair in common.
* Large sets are looked up in the inverted lists of the first shingles of all sets that
  are large enough to link with one of them.
* The boundary between the two is where listing pairs would begin to cost more than
  reading lists, given the sizes and how many sets share a shingle.

Equal sets are one class from the start. Members of a list are first held against the
least member, so that large groups of near copies fall together by a link per member;
after that, sets are compared across components only, in rounds that take one candidate
per set and foreign component, those left out whose signatures rule a link out, until no
list has a candidate left (settle.py). Every candidate is compared on its whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opquality.llm.common import cut, cut_counted, map_arrow, per_bucket, write_parquet
from opquality.llm.settle import BROADCAST_IDS, Compare, by_ids, settle
from opquality.llm.units import blocks, ragged
from opquality.llm.wordhash import LOWER, find_words, mix, range_hashes, raw_bytes, text_of_word, window_hashes

WORDS = 5
PERCENT = 75
SCAN_BYTES = 1 << 20
# Different sets are counted within so many bytes of text.
COUNT_BYTES = 16 << 20
# A shingle counts as common from so many sets, or more if there would be over 2^20 of them.
COMMON_SETS = 64
MOST_COMMON = 1 << 20
ENTRIES_A_BUCKET = 1 << 19
# Bits of a set's signature.
SIGNATURE = 2048
SIGNED_AT_ONCE = 512
MARKED = np.uint64(0x5851F42D4C957F2D)
COMMON_BIT = np.uint64(1 << 62)
PAIR_BIT = 1 << 62

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0x20] = IS_WORD[0x09:0x0E] = False


def least_overlap(n, percent: int):
    """The least overlap that a link of a set of n needs, whatever its partner."""
    return -(-n * percent // 100)


def prefix(n, percent: int, subset: int):
    """So many first shingles of a set of n hold subset common ones with any partner."""
    return np.minimum(n, n - least_overlap(n, percent) + subset)


def shingle_sets(texts: pa.StringArray, words: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For one slice of the texts after the other: its first and last row, the sorted
    distinct shingle hashes of each text, and where each text's begin."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    salt = mix(np.array([seed + 1], dtype=np.uint64))[0]
    for lo, hi in blocks(sizes, SCAN_BYTES):
        data, text_at = raw_bytes(texts.slice(lo, hi - lo))
        data = LOWER[data]
        found = find_words(data, text_at, IS_WORD)
        hashes = range_hashes(data, found.starts, found.ends) ^ salt
        text_of, counts = text_of_word(found.at), np.diff(found.at)
        value, owner = [], []
        for n in range(1, words + 1):
            window = window_hashes(hashes, n)
            first = np.arange(len(window))
            keep = text_of[first] == text_of[first + n - 1]
            if n < words:
                keep &= counts[text_of[first]] == n
            value.append(window[keep])
            owner.append(text_of[first[keep]])
        value, owner = np.concatenate(value), np.concatenate(owner)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield lo, hi, value[new], np.searchsorted(owner[new], np.arange(hi - lo + 1))


def fingerprints(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, as int64."""
    def total(v: np.ndarray) -> np.ndarray:
        c = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(v, dtype=np.uint64)))
        return c[at[1:]] - c[at[:-1]]
    n = np.diff(at).astype(np.uint64)
    return mix(total(mix(value)) + n).view(np.int64), mix(total(mix(value ^ np.uint64(0xA5A5A5A5DEADBEEF))) ^ n).view(np.int64)


def signatures(value: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each set, SIGNATURE bits as 64-bit words: the parity of its shingles by hash.
    A shingle that one of two sets lacks flips one bit, so the sets differ by at least as
    many shingles as their signatures by bits."""
    bit = (mix(value) >> np.uint64(64 - SIGNATURE.bit_length() + 1)).astype(np.int64)
    parts = [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(at) - 1, SIGNED_AT_ONCE):
        own = at[lo:lo + SIGNED_AT_ONCE + 1]
        rows = len(own) - 1
        place = np.repeat(np.arange(rows), np.diff(own)) * SIGNATURE + bit[own[0]:own[-1]]
        odd = np.bincount(place, minlength=rows * SIGNATURE) & 1
        parts.append(np.packbits(odd.astype(np.uint8).reshape(rows, SIGNATURE), axis=1).view(np.int64).reshape(-1))
    words = np.concatenate(parts)
    return pa.FixedSizeListArray.from_arrays(pa.array(words), SIGNATURE // 64).cast(pa.list_(pa.int64()))


def marks(value: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each set, parities of its shingles by hash like signatures, but two to four bits
    for each shingle, a power of 2 and SIGNATURE at least. Half of them, put on the other
    half by exclusive or, are the marks of half the size."""
    n = np.diff(at)
    bits = np.maximum(SIGNATURE, 4 << np.floor(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(bits)))
    owner = np.repeat(np.arange(len(n)), n)
    place = first[owner] + (mix(value ^ MARKED) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(first[-1])) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(words))


def _common_shingles(texts: DataFrame, words: int, seed: int) -> tuple[np.ndarray, float]:
    """Shingles of many sets, sorted, and how many other sets of its block have a shingle.

    Each task counts, in each block of text, the different sets that hold a shingle, and
    passes on those of two and more; all blocks are summed up. The list only sets the order of
    shingles, so what it misses costs time and never a link.
    """
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (batch.column(0).slice(a, b - a) for batch in batches for a, b in blocks(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(), COUNT_BYTES)):
            seen, held = set(), []
            for _, _, value, at in shingle_sets(texts, words, seed):
                first, _ = fingerprints(value, at)
                fresh = [n for n, f in enumerate(first.tolist()) if f not in seen and not seen.add(f)]
                held.append(value[ragged(at[:-1][fresh], np.diff(at)[fresh])])
            shingle, sets = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *held]), return_counts=True)
            total, usual = int(sets.sum()), sets[sets < COMMON_SETS].astype(np.int64)
            shingle, sets = shingle[sets > 1], sets[sets > 1]
            # The totals ride along as a row without a shingle.
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(shingle.view(np.int64)), pa.array([None], pa.int64())]),
                pa.concat_arrays([pa.array(sets.astype(np.int64)), pa.array([total], pa.int64())]),
                pa.concat_arrays([pa.array(np.zeros(len(sets), dtype=np.int64)), pa.array([int((usual * (usual - 1)).sum())], pa.int64())]),
            ], names=["shingle", "sets", "others"])

    counts = cut(map_arrow(texts.select("text"), tasks, "shingle long, sets long, others long").groupBy("shingle").agg(F.sum("sets").alias("sets"), F.sum("others").alias("others")))
    total, others = counts.where("shingle is null").agg(F.coalesce(F.sum("sets"), F.lit(0)), F.coalesce(F.sum("others"), F.lit(0))).head()
    shared = counts.where("shingle is not null")
    least = max(COMMON_SETS, total // MOST_COMMON)
    # At most total / least rows, so at most 2^20.
    found = shared.where(F.col("sets") >= least).select("shingle").toArrow()["shingle"].to_numpy()
    return np.sort(found.view(np.uint64) if len(found) else np.zeros(0, dtype=np.uint64)), others / max(1, total)


def order_keys(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order: by hash, common ones last."""
    key = value >> np.uint64(2)
    if len(common):
        at = np.minimum(np.searchsorted(common, value), len(common) - 1)
        key = key | np.where(common[at] == value, COMMON_BIT, np.uint64(0))
    return key


def boundary(sizes: dict[int, int], shared: float, percent: int) -> int:
    """The largest size that is still small: pairs of a small set are listed, lists of a
    large one are read and hold so many others. Least total cost wins."""
    if not sizes:
        return 1
    n = np.array(sorted(sizes), dtype=np.int64)
    often = np.array([sizes[k] for k in n.tolist()], dtype=np.float64)
    by_pair = prefix(n, percent, 2)
    listed = np.cumsum(often * by_pair * (by_pair - 1) / 2)
    entries = np.concatenate(([0.0], np.cumsum(often * prefix(n, percent, 1) * (1 + shared))))
    best, at = None, 1
    for k, x in enumerate(n.tolist()):
        near = np.searchsorted(n, -(-x * percent // 100))
        cost = listed[k] + (entries[-1] - entries[near] if k < len(n) - 1 else 0.0)
        if best is None or cost < best:
            best, at = cost, x
    return at


def _postings(docs: DataFrame, common, edge: int, words: int, percent: int, seed: int, buckets: int) -> DataFrame:
    """Packed entries of each bucket of keys: key, set (by fingerprint) and set size. A
    batch gives each different set once."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            seen, keys, sets, ns = set(), [], [], []
            for _, _, value, at in shingle_sets(batch.column(0), words, seed):
                first, _ = fingerprints(value, at)
                n = np.diff(at)
                fresh = np.array([k for k, f in enumerate(first.tolist()) if n[k] > 1 and f not in seen and not seen.add(f)], dtype=np.int64)
                order = order_keys(value, known)
                owner = np.repeat(np.arange(len(n)), n)
                order = order[np.lexsort((order, owner))]
                listed = fresh[n[fresh] >= least_overlap(edge, percent)]
                p = prefix(n[listed], percent, 1)
                keys.append(order[ragged(at[:-1][listed], p)].view(np.int64))
                sets.append(np.repeat(first[listed], p))
                ns.append(np.repeat(n[listed], p))
                small = fresh[n[fresh] <= edge]
                for k in small.tolist():
                    own = order[at[k]:at[k] + int(prefix(n[k], percent, 2))]
                    i, j = np.triu_indices(len(own), 1)
                    pair = (mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j]) >> np.uint64(2)).view(np.int64) | np.int64(PAIR_BIT) | np.int64(-(1 << 63))
                    keys.append(pair)
                    sets.append(np.full(len(pair), first[k]))
                    ns.append(np.full(len(pair), n[k]))
            if not keys:
                continue
            key, who, size = np.concatenate(keys), np.concatenate(sets), np.concatenate(ns).astype(np.int32)
            # Bits that do not follow the order, so common shingles spread evenly.
            bucket = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            rows = [(b, by_bucket[edges[b]:edges[b + 1]]) for b in range(buckets) if edges[b] < edges[b + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in rows], pa.int32()),
                *(pa.array([x[r].tobytes() for _, r in rows], pa.binary()) for x in (key, who, size)),
            ], names=["bucket", "keys", "sets", "sizes"])

    return map_arrow(docs.select("text"), tasks, "bucket int, keys binary, sets binary, sizes binary")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Entries (key, set, size, times) of the keys that two or more sets have. Keys of the
    same sets are one list, named by a hash of these, with the number of its keys; different
    lists of one hash would be one list of all their sets, which loses no pair."""
    def lists(group: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), dtype=kind)
        key, who, size = join("keys", np.int64), join("sets", np.int64), join("sizes", np.int32)
        order = np.lexsort((who, key))
        key, who, size = key[order], who[order], size[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who, size = key[new], who[new], size[new]
        change = np.concatenate((key[1:] != key[:-1], [True]))
        start = np.concatenate(([True], change[:-1]))
        many = ~(start & change)
        key, who, size = key[many], who[many], size[many]
        at = np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)])) if len(key) else np.zeros(1, dtype=np.int64)
        name, check = fingerprints(who.view(np.uint64), at)
        by = np.lexsort((check, name))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (name[by][1:] != name[by][:-1]) | (check[by][1:] != check[by][:-1])
        first, length = by[new], np.diff(at)[by[new]]
        times, rows = np.diff(np.concatenate((np.flatnonzero(new), [len(by)]))), ragged(at[:-1][first], length)
        return pa.table({"key": np.repeat(name[first], length), "id": who[rows], "n": size[rows], "times": np.repeat(times, length)})

    found = per_bucket(postings, lists, "key long, id long, n int, times long")
    return found.groupBy("key", "id", "n").agg(F.sum("times").alias("times"))


def signed_sets(rows: DataFrame, classes: DataFrame, count: int) -> Callable[[DataFrame], DataFrame]:
    """A function from ids of sets to their sizes and signatures, from one of their rows each.
    rows: id, row, n, signature; classes: id, row, so many of them."""
    def signatures_of(ids: DataFrame) -> DataFrame:
        chosen = by_ids(classes, ids, "id", count).select("id", "row")
        return by_ids(rows.select("id", "row", "n", "signature"), chosen, ["id", "row"], count).drop("row").dropDuplicates(["id"])

    return signatures_of


def readers(docs: DataFrame, classes: DataFrame, count: int, words: int, seed: int):
    """Two functions from ids of sets to their marks and to their shingles, read from the
    text of one document each. docs: row, text; classes: id, row, so many of them."""
    def reader(column: str, of: Callable[[np.ndarray, np.ndarray], pa.Array]) -> Callable[[DataFrame], DataFrame]:
        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given: set[int] = set()
            for batch in batches:
                for _, _, value, at in shingle_sets(batch.column(0), words, seed):
                    first, _ = fingerprints(value, at)
                    found = pa.RecordBatch.from_arrays([pa.array(first), of(value, at)], names=["id", column])
                    yield found.filter(pa.array([f not in given and not given.add(f) for f in first.tolist()], pa.bool_()))

        def read(ids: DataFrame) -> DataFrame:
            wanted = by_ids(classes, ids, "id", count).select("row").distinct()
            return write_parquet(map_arrow(by_ids(docs, wanted, "row", count).select("text"), tasks, f"id long, {column} array<long>"), f"jaccard-{column}")

        return read

    shingles = lambda value, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
    return reader("marks", marks), reader("shingles", shingles)


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, edge: int | None = None,
) -> DataFrame:
    """Per row of df: its id, n_shingles (distinct runs of so many lower-cased words; all
    words as one if there are fewer) and component_id (the least id that links lead to).

    Two documents link if 100 * common >= percent * all shingles of the two. Null, empty and
    blank texts have no shingles and link with nothing; equal texts link. Texts of any
    length are read whole, a slice of texts at a time. Repeated rows are rows of the result;
    component_id is null only if no row of the component has an id. An empty table gives
    an empty one, and columns beside these two do not matter. edge: the largest size that counts as small; found by cost if not given.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Where a text is read again; rows of one id and text are the same to it.
    docs = docs.withColumn("row", F.xxhash64(F.col("doc").isNull(), "doc", "text"))
    seed = 0
    while True:
        common, shared = _common_shingles(docs, words, seed)
        known = df.sparkSession.sparkContext.broadcast(common)

        def measure(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, value, at in shingle_sets(batch.column(2), words, seed):
                    first, second = fingerprints(value, at)
                    n = np.diff(at)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int32)), pa.array(first), pa.array(second), signatures(value, at),
                    ], names=["doc", "row", "n", "id", "check", "signature"])

        rows = write_parquet(map_arrow(docs.select("doc", "row", "text"), measure, "doc long, row long, n int, id long, check long, signature array<long>"), "jaccard-rows")
        classes, count = cut_counted(rows.where("n > 0").groupBy("id").agg(
            F.min("doc").alias("doc"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"),
        ))

        # Two sets with one fingerprint, told apart by the second: another seed.
        if classes.where("c0 <> c1").isEmpty():
            break
        seed += 1
    sizes = {r.n: r["count"] for r in classes.groupBy("n").count().collect()}
    if edge is None:
        edge = boundary(sizes, shared, percent)
    entries = sum(c * int(prefix(n, percent, 1) + (prefix(n, percent, 2) ** 2 // 2 if n <= edge else 0)) for n, c in sizes.items())
    buckets = max(64, -(-entries // ENTRIES_A_BUCKET))
    lists = write_parquet(_shared_lists(_postings(docs, known, edge, words, percent, seed, buckets)), "jaccard-lists")

    signatures_of = signed_sets(rows, classes, count)
    compare = Compare(signatures_of, *readers(docs, classes, count, words, seed), percent)
    labels = settle(lists, signatures_of, compare.linked, percent, thin=compare.marked, whole=compare.whole)
    component = classes.join(labels, classes.id == labels.node, "left").select("id", "doc", F.coalesce("label", "id").alias("label"))
    least_doc = component.groupBy("label").agg(F.min("doc").alias("component_id"))
    placed = component.join(least_doc, "label").select(F.col("id").alias("_id"), "component_id")
    out = rows.select("doc", "n", "id").join(placed, (F.col("id") == F.col("_id")) & (F.col("n") > 0), "left")
    return out.select(
        F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    )


def _keyed(rows: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Rows of different (id, text) with a key, which no two of them share."""
    id_, text = F.col(id_col), F.col(text_col)
    seed = 0
    while True:
        # Hashes pass over nulls, so these are told apart by flags.
        keyed = rows.withColumn(name, F.xxhash64(F.lit(seed), id_.isNull(), id_, text.isNull(), text))
        if keyed.groupBy(name).count().where("count > 1").isEmpty():
            return keyed
        seed += 1


def one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that are the least of their component, with the columns they came
    with. Rows that share an id, or have none, are told apart by their texts first: each
    text stays once. Of a component's rows that share the least id one stays, and a row
    without an id stays only if no row of its component has one."""
    doc = F.col(id_col).cast("long")
    if df.groupBy(doc.alias("doc")).count().where((F.col("count") > 1) | F.col("doc").isNull()).isEmpty():
        found = jaccard_components(df, id_col, text_col, **options)
        others = cut(found.where(F.col("component_id") != F.col(id_col)).select(id_col))
        return _without(df, others, id_col)
    name = "_key"
    while name in df.columns:
        name += "_"
    rows = _keyed(write_parquet(df.dropDuplicates([id_col, text_col]), "jaccard-different"), id_col, text_col, name)
    found = jaccard_components(rows.select(name, text_col), name, text_col, **options).select(name, "component_id")
    placed = cut(found.join(rows.select(name, doc.alias("_doc")), name))
    stays = placed.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", name))[name].alias(name))
    others = cut(placed.select(name).join(stays, name, "left_anti"))
    return _without(rows, others, name).select(df.columns)


def _without(rows: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """Rows whose column is not among others; a broadcast only while these are few."""
    return rows.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, column, "left_anti").select(rows.columns)
