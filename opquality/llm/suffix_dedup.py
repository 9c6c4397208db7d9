"""Removal of byte strings that occur earlier in the corpus, by winnowed grams and
grouping by hashes.

This takes the place of prefix doubling over a suffix array: there are no rounds of
ranks at growing lengths, no rank comes from a sort that Spark makes, and none is looked
up at another offset. The number of steps is fixed:

1. in each run of LENGTH bytes, the place of its least hashed GRAM bytes is a sample,
   on which equal strings agree. Samples are grouped by the hash of their gram;
2. those left, by that hash paired with the hash of all strings of LENGTH bytes that
   have this sample. Of equal pairs the first stays, the others are covered;
3. every byte position that a remaining sample answers for, by the hashes of the two
   halves of its LENGTH bytes, computed from the text. Equal pairs after the first are
   covered.

Names called ranks below are such hashes of 64 bits; strings are equal if their pairs
are. Entries travel as arrays, in buckets by rank; a batch sends one
entry for each pair it holds more than once, so a group of copies meets in no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.llm.common import map_arrow, per_bucket, unused, write_parquet
from opquality.llm.units import blocks, bounds, ragged
from opquality.llm.wordhash import mix, range_hashes, raw_bytes

LENGTH = 100
GRAM = 24
SCAN_BYTES = 1 << 20
# Samples are looked for in so many bytes at a time, which take some 100 bytes each meanwhile.
SAMPLE_BYTES = 1 << 18
# Samples are sorted, and copies among them found, within so many bytes of text.
SORT_BYTES = 16 << 20
ENTRIES_A_BUCKET = 1 << 19
# From so many surroundings of one gram in a batch, its entries are spread by both; from
# so many in all, its byte positions are ranked in buckets of their own.
MANY = 128
MANY_IN_ALL = 4096
BROADCAST_IDS = 2_000_000
NO_ID = -(1 << 63)
COVERED, CANDIDATE, COMMON = 0, 1, 2
MARK = np.uint64(0)


def samples(data: np.ndarray, text_at: np.ndarray, length: int, gram: int):
    """Sampled positions of some texts: per sample its text, the first and last start of
    the strings that it stands for, its gram's hash and the hash of all those strings."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    starts = np.arange(len(data) - gram + 1)
    value = range_hashes(data, starts, starts + gram)
    bits = max(1, int(len(value)).bit_length())
    low = np.uint64((1 << bits) - 1)
    # Least hash, leftmost on ties: the place fills the low bits.
    key = (value & ~low) | starts.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if width > span:
        key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
    place = (key & low).astype(np.int64)
    first = np.arange(len(place))
    text_of = np.searchsorted(text_at, first, side="right") - 1
    inside = first + length <= text_at[text_of + 1]
    first, place, text_of = first[inside], place[inside], text_of[inside]
    if not len(first):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text_of[1:] != text_of[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    lo, hi = first[at], first[np.concatenate((at[1:] - 1, [len(first) - 1]))]
    around = mix(range_hashes(data, lo, hi + length) + (place[at] - lo).astype(np.uint64))
    return text_of[at], lo, hi, value[place[at]], np.where(around == MARK, np.uint64(1), around)


def earliest(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by keys and then by order. The sorting, and which rows of it are the first
    of their keys."""
    by = np.lexsort([*order[::-1], *keys[::-1]])
    first = np.zeros(len(by), dtype=bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[by][1:] != k[by][:-1]
    return by, first


class Packer:
    """Rows of one batch in buckets: arrays of entries, and intervals already covered."""

    def __init__(self, buckets: int, names: list[str]):
        self.buckets, self.names = buckets, names

    def rows(self, bucket: np.ndarray, entries: list[np.ndarray], covered: list[np.ndarray]) -> pa.RecordBatch:
        # Covered intervals go anywhere; the task's own order spreads them.
        anywhere = np.arange(len(covered[0])) % self.buckets
        out: dict[str, list] = {"bucket": [], **{n: [] for n in self.names}, **{f"c{k}": [] for k in range(len(covered))}}
        by, by_covered = np.argsort(bucket, kind="stable"), np.argsort(anywhere, kind="stable")
        at = np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        at_covered = np.searchsorted(anywhere[by_covered], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            own, done = by[at[b]:at[b + 1]], by_covered[at_covered[b]:at_covered[b + 1]]
            if len(own) or len(done):
                out["bucket"].append(b)
                for n, e in zip(self.names, entries):
                    out[n].append(e[own].tobytes())
                for k, c in enumerate(covered):
                    out[f"c{k}"].append(c[done].tobytes())
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in [*out][1:])]))

    def ddl(self) -> str:
        return "bucket int, " + ", ".join(f"{n} binary" for n in [*self.names, *(f"c{k}" for k in range(4))])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)


def _later(first: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Which sorted rows come after the first of their group and differ from it in a key;
    a repeated row is no earlier document."""
    owner = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return ~first & np.any([k != k[owner] for k in keys], axis=0)


INTERVALS = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.int8()), ("gram", pa.int64())])
INTERVALS_DDL = "doc long, version long, lo int, hi int, kind byte, gram long"


def _intervals(doc, version, lo, hi, kind, gram) -> pa.Table:
    return pa.table([pa.array(np.asarray(x).astype(t.to_pandas_dtype())) for x, t in zip((doc, version, lo, hi, kind, gram), INTERVALS.types)], schema=INTERVALS)


def _rank_samples(docs: DataFrame, buckets: int, length: int, gram: int, many: int, many_in_all: int) -> DataFrame:
    """Rounds 1 and 2: intervals of each document that are covered (first byte, end) or of
    which the starts are still open (first, last)."""
    packer = Packer(buckets, ["gram", "around", "doc", "version", "lo", "width", "shared"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in blocks(pc.binary_length(whole.column(2)).to_numpy(), SORT_BYTES)):
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [[] for _ in range(6)]
            for a, b in blocks(pc.binary_length(batch.column(2)).to_numpy(), SAMPLE_BYTES):
                data, text_at = raw_bytes(batch.column(2).slice(a, b - a))
                text, lo, hi, value, around = samples(data, text_at, length, gram)
                for x, y in zip(found, (value, around, ids[a + text], versions[a + text], (lo - text_at[text]).astype(np.int32), (hi - lo).astype(np.uint16))):
                    x.append(y)
            if not found[0]:
                continue
            columns = [np.concatenate(x) for x in found]
            by, first = earliest(columns[:2], columns[2:5])
            value, around, doc, version, lo, width = (x[by] for x in columns)
            again = _later(first, [doc, version, lo])
            covered = [doc[again], version[again], lo[again], lo[again] + width[again] + np.int32(length)]
            # Grams with many surroundings; a mark tells the gram's own bucket.
            value, around = value[first], around[first]
            new = np.ones(len(value), dtype=bool)
            new[1:] = value[1:] != value[:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.concatenate((at, [len(value)])))
            marks, spread = at[size >= many], np.repeat(size >= many, size)
            # Entries in the order of documents, which the shuffle packs better.
            order = np.argsort(by[first], kind="stable")
            pick = np.concatenate((order, marks))
            is_mark = np.arange(len(pick)) >= len(order)
            shared = spread[pick] | is_mark
            route = mix(value[pick] + np.where(spread[pick] & ~is_mark, around[pick], np.uint64(0)))
            entries = [
                (value[pick] >> np.uint64(32)).astype(np.uint32), np.where(is_mark, MARK, around[pick]),
                *(x[first][pick] for x in (doc, version, lo, width)), shared.astype(np.int8),
            ]
            yield packer.rows((route % np.uint64(packer.buckets)).astype(np.int64), entries, [covered[0], covered[1], covered[2], covered[3].astype(np.int32)])

    def rank(group: pa.Table) -> pa.Table:
        kinds = {"gram": np.uint32, "around": np.uint64, "doc": np.int64, "version": np.int64, "lo": np.int32, "width": np.uint16, "shared": np.int8}
        columns = [_joined(group, n, k) for n, k in kinds.items()]
        done = [_joined(group, f"c{k}", t) for k, t in enumerate((np.int64, np.int64, np.int32, np.int32))]
        by, first = earliest(columns[:2], columns[2:5])
        value, around, doc, version, lo, width, shared = (x[by] for x in columns)
        real = around != MARK
        again = _later(first, [doc, version, lo]) & real
        # A gram with several surroundings, here or by a mark, is still open.
        new = np.ones(len(value), dtype=bool)
        new[1:] = value[1:] != value[:-1]
        group_of = np.cumsum(new) - 1
        classes = np.bincount(group_of, first, minlength=1)[group_of] if len(value) else value
        marked = np.bincount(group_of, shared, minlength=1)[group_of] > 0 if len(value) else first
        open_ = first & real & ((classes > 1) | marked)
        kind = np.where(marked | (classes >= many_in_all), COMMON, CANDIDATE)
        hi = lo.astype(np.int64) + width
        name = (group["bucket"][0].as_py() << 32) | value.astype(np.int64)
        both = lambda x, rest: np.concatenate((x[again], x[open_], rest))
        return _intervals(
            both(doc, done[0]), both(version, done[1]), both(lo, done[2]), np.concatenate((hi[again] + length, hi[open_], done[3])),
            np.concatenate((np.full(int(again.sum()), COVERED), kind[open_], np.full(len(done[0]), COVERED))), both(name, np.zeros(len(done[0]), dtype=np.int64)),
        )

    return per_bucket(map_arrow(docs, tasks, packer.ddl()), rank, INTERVALS_DDL)


def _rank_positions(candidates: DataFrame, buckets: int, length: int) -> DataFrame:
    """Round 3. candidates: doc, version, text, spans (first and last start, whether the
    gram is common, and its name). The strings of a gram go to its bucket as text; those
    of a common gram as one pair of ranks per position, by these ranks."""
    packer = Packer(buckets, ["one", "two", "doc", "version", "lo", "text", "text_bytes", "text_doc", "text_version", "text_lo"])
    half = length // 2

    def names(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return range_hashes(data, at, at + half), range_hashes(data, at + half, at + length)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in blocks(pc.binary_length(batch.column(2)).to_numpy(), SCAN_BYTES):
                data, text_at = raw_bytes(batch.column(2).slice(a, b - a))
                spans = batch.column(3).slice(a, b - a)
                text = np.repeat(np.arange(b - a), pc.list_value_length(spans).to_numpy())
                lo, hi, kind, gram = (spans.flatten().field(k).to_numpy().astype(np.int64) for k in range(4))
                common = kind == COMMON
                n = (hi - lo + 1)[common]
                at, owner = ragged((lo + text_at[text])[common], n), np.repeat(text[common], n)
                one, two = names(data, at)
                doc, version, start = ids[a + owner], versions[a + owner], (at - text_at[owner]).astype(np.int32)
                by, first = earliest([one, two], [doc, version, start])
                one, two, doc, version, start = (x[by] for x in (one, two, doc, version, start))
                again = _later(first, [doc, version, start])
                covered = [doc[again], version[again], start[again], start[again] + np.int32(length)]
                route = (mix(one ^ two) % np.uint64(buckets))[first].astype(np.int64)
                row = packer.rows(route, [x[first] for x in (one, two, doc, version, start)] + [np.zeros(len(route), dtype=np.uint8)] * 5, covered)
                # Texts of the other grams, beside the positions of their bucket.
                to = (mix(gram.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                by_bucket = np.argsort(np.where(common, buckets, to), kind="stable")
                edges = np.searchsorted(np.where(common, buckets, to)[by_bucket], np.arange(buckets + 1))
                rows = {r["bucket"]: r for r in row.to_pylist()}
                for k in range(buckets):
                    own = by_bucket[edges[k]:edges[k + 1]]
                    if not len(own):
                        if k in rows:
                            rows[k] |= {n: b"" for n in packer.names[5:]}
                        continue
                    where, size = lo[own] + text_at[text[own]], hi[own] - lo[own] + length
                    rows[k] = rows.get(k, {"bucket": k, **{n: b"" for n in [*packer.names[:5], "c0", "c1", "c2", "c3"]}}) | {
                        "text": data[ragged(where, size)].tobytes(), "text_bytes": size.astype(np.uint32).tobytes(),
                        "text_doc": ids[a + text[own]].tobytes(), "text_version": versions[a + text[own]].tobytes(), "text_lo": lo[own].astype(np.int32).tobytes(),
                    }
                yield pa.RecordBatch.from_pylist([*rows.values()], schema=row.schema)

    def rank(group: pa.Table) -> pa.Table:
        one, two = _joined(group, "one", np.uint64), _joined(group, "two", np.uint64)
        doc, version, start = _joined(group, "doc", np.int64), _joined(group, "version", np.int64), _joined(group, "lo", np.int32)
        data, size = _joined(group, "text", np.uint8), _joined(group, "text_bytes", np.uint32).astype(np.int64)
        n = size - length + 1
        at = ragged(bounds(size)[:-1], n)
        own_one, own_two = names(data, at)
        of = lambda name, kind: np.repeat(_joined(group, name, kind), n)
        own_start = of("text_lo", np.int32) + ragged(np.zeros(len(n), dtype=np.int64), n)
        one, two = np.concatenate((one, own_one)), np.concatenate((two, own_two))
        doc, version = np.concatenate((doc, of("text_doc", np.int64))), np.concatenate((version, of("text_version", np.int64)))
        start = np.concatenate((start, own_start)).astype(np.int64)
        by, first = earliest([one, two], [doc, version, start])
        doc, version, start = doc[by], version[by], start[by]
        again = _later(first, [doc, version, start])
        done = [_joined(group, f"c{k}", t) for k, t in enumerate((np.int64, np.int64, np.int32, np.int32))]
        doc, version, lo, hi = (np.concatenate(x) for x in zip((doc[again], version[again], start[again], start[again] + length), done))
        # Neighbouring starts of a document are one interval.
        order = np.lexsort((lo, version, doc))
        doc, version, lo, hi = (x[order] for x in (doc, version, lo, hi))
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (lo[1:] > hi[:-1])
        firsts = np.flatnonzero(new)
        lasts = np.concatenate((firsts[1:], [len(doc)])) - 1 if len(firsts) else firsts
        none = np.zeros(len(firsts), dtype=np.int64)
        return _intervals(doc[firsts], version[firsts], lo[firsts], hi[lasts], none, none)

    return per_bucket(map_arrow(candidates, tasks, packer.ddl()), rank, INTERVALS_DDL)


def removed_runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return [(a, b) for a, b in runs]


def _only(df: DataFrame, ids: DataFrame, few: bool, how: str) -> DataFrame:
    return df.join(F.broadcast(ids) if few else ids, "doc", how)


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False,
    many: int = MANY, many_in_all: int = MANY_IN_ALL,
) -> DataFrame:
    """Every row of df with all its columns, and

    n_bytes  UTF-8 bytes of the text
    runs     maximal runs of removed bytes (start, end): those covered by a string of so
             many bytes that also starts earlier, in a row of smaller id or before in the
             same text. All strings are judged on the input, and none crosses a text
    kept     the other bytes, in order (binary); as_text: as a string, without bytes that
             no longer make up a character

    A null text is empty; a null id comes before all others. Rows that are equal in id and
    text are one document and get the same result; other rows of one id are ordered by
    their text's hash. Columns of df named like a new one are replaced. Texts of any
    length are taken whole, and an empty table gives an empty table.
    """
    new = ["n_bytes", "runs", "kept"]
    rows = df.drop(*new)
    columns = rows.columns
    id_ = F.col(id_col).cast("long")
    repeated = not rows.groupBy(F.coalesce(id_, F.lit(NO_ID)).alias("doc")).count().where("count > 1").isEmpty()
    # No id reads as the least one; its versions lie below those of rows that have that id.
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 1)
    version = F.when(id_.isNull(), -1 - hashed).otherwise(hashed) if repeated else F.lit(0).cast("long")
    key = [F.coalesce(id_, F.lit(NO_ID)).alias("doc"), version.alias("version")]
    docs = rows.select(*key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = docs.where(F.octet_length("text") >= length)
    total = long.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    buckets = max(64, -(-2 * total // ((length - gram + 2) * ENTRIES_A_BUCKET)))
    found = write_parquet(_rank_samples(long, buckets, length, gram, many, many_in_all), "suffix-samples")

    open_ = found.where(F.col("kind") != COVERED)
    starts, ids = open_.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)), F.count_distinct("doc")).head()
    spans = open_.groupBy("doc", "version").agg(F.collect_set(F.struct("lo", "hi", "kind", "gram")).alias("spans"))
    few = ids <= BROADCAST_IDS
    candidates = _only(long, open_.select("doc").distinct(), few, "left_semi").join(spans, ["doc", "version"]).select("doc", "version", "text", "spans")
    later = _rank_positions(candidates, max(64, -(-starts // ENTRIES_A_BUCKET)), length)
    covered = found.where(F.col("kind") == COVERED).unionByName(later)
    spans, = unused(columns, "_spans")
    runs = write_parquet(covered.groupBy("doc", "version").agg(F.collect_set(F.struct("lo", "hi")).alias(spans)), "suffix-covered")

    whole = rows.withColumns({"doc": key[0], "version": key[1]}) if not {"doc", "version"} & set(columns) else None
    if whole is None:
        # Columns of the input with the names used here are set aside.
        aside = {c: f"_own_{c}" for c in columns if c in ("doc", "version")}
        back = remove_repeats(rows.withColumnsRenamed(aside), aside.get(id_col, id_col), aside.get(text_col, text_col), length, gram, as_text, many, many_in_all)
        return back.withColumnsRenamed({v: k for k, v in aside.items()})
    touched = runs.select("doc").distinct()
    few = touched.count() <= BROADCAST_IDS
    hit = _only(whole, touched, few, "left_semi").join(runs, ["doc", "version"], "left").select(*columns, spans)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    added = T.StructType.fromDDL("n_bytes long, runs array<struct<start:int,end:int>>, kept " + ("string" if as_text else "binary")).fields
    at_column = columns.index(text_col)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at_column).cast(pa.string()), "")
            for a, b in blocks(pc.binary_length(texts).to_numpy(), 4 * SCAN_BYTES):
                part, sizes, all_runs, kept = batch.slice(a, b - a), [], [], []
                for t, s in zip(texts.slice(a, b - a).to_pylist(), part.column(len(columns)).to_pylist()):
                    raw, found_runs = t.encode(), removed_runs(s)
                    edges = [0, *(x for r in found_runs for x in r), len(raw)]
                    sizes.append(len(raw))
                    all_runs.append([{"start": x, "end": y} for x, y in found_runs])
                    left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:-1], pa.array(sizes, pa.int64()),
                    pa.array(all_runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string() if as_text else pa.binary()),
                ], names=[*columns, *new])

    schema = T.StructType([*rows.schema.fields, *added])
    untouched = _only(whole, touched, few, "left_anti").select(
        *columns, F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast(added[1].dataType).alias("runs"), (text.cast("string") if as_text else text).alias("kept")
    )
    return map_arrow(hit, tasks, schema).unionByName(untouched)
