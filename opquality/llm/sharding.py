"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (60-bit text hash, id), so copies of a text lie together. The
driver holds candidate boundaries only: each round counts the exact bytes and rows
between evenly spaced probes inside the intervals that still hold a splitter, and
narrows those intervals, until every splitter is within the tolerance. Then the rows
move once, to the range they belong to.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opquality.llm.common import cut, text_of, unused

KEY_BITS = 60
FIRST_BITS = 12
PROBES_A_ROUND = 1 << 17
MAX_RANGES = 1 << 16
LOWEST_ID = -(1 << 63)


@dataclass(frozen=True)
class Cut:
    """Rows at or above (key, id) lie right of the splitter."""

    key: int
    id: int
    bytes_below: int
    rows_below: int


@dataclass(frozen=True)
class Bin:
    """Rows of one probe interval. first/last: the least and greatest (key, id)."""

    key_min: int
    key_max: int
    id_min: int
    id_max: int
    bytes: int
    rows: int
    bytes_below: int
    rows_below: int


def text_key(text_col: str) -> Column:
    """The first 60 bits of the text's MD5; null counts as the empty text."""
    return F.conv(F.substring(F.md5(text_of(text_col)), 1, KEY_BITS // 4), 16, 10).cast("long")


def byte_size(text_col: str) -> Column:
    return (F.octet_length(text_of(text_col)) + 1).cast("long")


def _stats() -> list[Column]:
    return [
        F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("i").alias("i0"), F.max("i").alias("i1"),
        F.sum("s").alias("bytes"), F.count(F.lit(1)).alias("rows"),
    ]


def _bins(found, below_bytes: int, below_rows: int) -> list[Bin]:
    out = []
    for r in found:
        out.append(Bin(r.k0, r.k1, r.i0, r.i1, r.bytes, r.rows, below_bytes, below_rows))
        below_bytes, below_rows = below_bytes + r.bytes, below_rows + r.rows
    return out


def _holding(bins: list[Bin], target: int) -> Bin:
    """The bin in which the bytes below first reach the target."""
    return next(b for b in bins if b.bytes_below + b.bytes >= target)


def _settled(b: Bin, target: int, tolerance: int) -> Cut | None:
    """A boundary of the bin that is near enough, or its end if it cannot be parted."""
    end = b.bytes_below + b.bytes
    single = b.key_min == b.key_max and b.id_min == b.id_max
    if not single and target - b.bytes_below <= tolerance and target - b.bytes_below <= end - target:
        return Cut(b.key_min, b.id_min if b.key_min == b.key_max else LOWEST_ID, b.bytes_below, b.rows_below)
    if single or end - target <= tolerance:
        return Cut(b.key_max, b.id_max + 1, end, b.rows_below + b.rows) if b.key_min == b.key_max else Cut(b.key_max + 1, LOWEST_ID, end, b.rows_below + b.rows)
    return None


def find_splitters(slim: DataFrame, targets: list[int], tolerance: int) -> list[Cut]:
    """slim: k (key), i (id), s (bytes). A Cut for each target (bytes that should lie
    below); with tolerance 0, the first row at which that many bytes lie below."""
    done: dict[int, Cut] = {}
    inside: dict[int, Bin] = {}

    def place(bins: list[Bin], wanted: list[int]) -> None:
        for t in wanted:
            b = _holding(bins, t)
            if c := _settled(b, t, tolerance):
                done[t] = c
                inside.pop(t, None)
            else:
                inside[t] = b

    wanted, bits = sorted(set(targets)), FIRST_BITS
    if wanted:
        first = slim.groupBy(F.shiftright("k", KEY_BITS - bits).alias("bin")).agg(*_stats()).orderBy("bin").collect()
        place(_bins(first, 0, 0), wanted)
    # Probes on the hash: bins are prefixes, each cut into the same number of finer ones.
    while apart := {t: b for t, b in inside.items() if b.key_min != b.key_max}:
        step = max(2, (PROBES_A_ROUND // len({b.key_min for b in apart.values()})).bit_length() - 1)
        finer = min(KEY_BITS, bits + step)
        prefixes = sorted({b.key_min >> (KEY_BITS - bits) for b in apart.values()})
        rows = (
            slim.where(F.shiftright("k", KEY_BITS - bits).isin(prefixes))
            .groupBy(F.shiftright("k", KEY_BITS - finer).alias("bin")).agg(*_stats()).orderBy("bin").collect()
        )
        for b in {b.bytes_below: b for b in apart.values()}.values():
            mine = [r for r in rows if r.k0 >> (KEY_BITS - bits) == b.key_min >> (KEY_BITS - bits)]
            place(_bins(mine, b.bytes_below, b.rows_below), [t for t, x in apart.items() if x is b or x.bytes_below == b.bytes_below])
        bits = finer
    # Probes on the id, inside hashes that alone exceed the tolerance.
    while inside:
        groups = {(b.key_min, b.id_min): b for b in inside.values()}
        probes = max(2, PROBES_A_ROUND // len(groups))
        spec = [{"k": b.key_min, "lo": b.id_min, "hi": b.id_max, "w": max(1, -(-(b.id_max - b.id_min + 1) // probes))} for b in groups.values()]
        ranges = F.from_json(F.lit(json.dumps(spec)), "array<struct<k:bigint,lo:bigint,hi:bigint,w:decimal(20,0)>>")
        mine_of = F.filter(ranges, lambda x: (x.k == F.col("k")) & F.col("i").between(x.lo, x.hi))
        one = slim.where(F.col("k").isin(sorted({b.key_min for b in groups.values()}))).withColumn("r", F.try_element_at(mine_of, F.lit(1)))
        rows = (
            one.where(F.col("r").isNotNull())
            .groupBy(F.col("r.k").alias("key"), F.col("r.lo").alias("lo"), F.floor((F.col("i").cast("decimal(20,0)") - F.col("r.lo").cast("decimal(20,0)")) / F.col("r.w")).alias("bin"))
            .agg(*_stats()).orderBy("key", "lo", "bin").collect()
        )
        for (key, lo), b in groups.items():
            mine = [r for r in rows if r.key == key and r.lo == lo]
            place(_bins(mine, b.bytes_below, b.rows_below), [t for t, x in list(inside.items()) if (x.key_min, x.id_min, x.key_max) == (key, lo, key)])
    return [done[t] for t in targets]


def _ranges(total: int, shards: int, range_bytes: int) -> int:
    """Ranges a shard is moved in, so that no task holds a shard."""
    return min(max(8, -(-total // (shards * range_bytes))), max(1, MAX_RANGES // shards))


def _range_of(cuts: list[Cut], k: str, i: str) -> Column:
    """The number of cuts at or below (k, i): a step to the cuts of the key's first
    bits, then a scan of those few."""
    by_bin: dict[int, list[Cut]] = {}
    for c in cuts:
        by_bin.setdefault(min(c.key >> (KEY_BITS - FIRST_BITS), (1 << FIRST_BITS) - 1), []).append(c)
    steps, below = [], 0
    for n in range(1 << FIRST_BITS):
        here = by_bin.get(n, [])
        steps.append({"n": below, "c": [{"k": c.key, "i": c.id} for c in here]})
        below += len(here)
    lookup = F.from_json(F.lit(json.dumps(steps)), "array<struct<n:int,c:array<struct<k:bigint,i:bigint>>>>")
    step = F.element_at(lookup, (F.shiftright(k, KEY_BITS - FIRST_BITS) + 1).cast("int"))
    return step.n + F.size(F.filter(step.c, lambda c: (c.k < F.col(k)) | ((c.k == F.col(k)) & (c.i <= F.col(i)))))


def histogram_sort(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
    tolerance: float = 0.0, range_bytes: int = 64 << 20,
) -> DataFrame:
    """Every row of df, with all its columns, and

    size   UTF-8 bytes of the text plus 1 (null: 1)
    shard  0 .. shards-1; sizes of shards differ by about a row
    slot   0, 1, 2 ... within the shard, in the order of (text hash, id)

    tolerance is the share of a shard by which a splitter may miss its place; 0 lets
    probes narrow down to single rows. Rows that are equal in text and id stay in one
    shard, a null id sorts first, and an empty table gives an empty table. Columns of
    df that are named like a new one are replaced; others pass through. A text of any
    length is one row. Each range is sorted by a task of its own; from 4 TB on there are
    MAX_RANGES of them and they grow, sorting with spills.
    """
    new = {"size", "shard", "slot"}
    rows = df.select([c for c in df.columns if c not in new])
    k, i, part, place = unused(df.columns, "_k", "_i", "_part", "_n")
    keyed = rows.withColumns({k: text_key(text_col), i: F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST_ID)), "size": byte_size(text_col)})
    slim = cut(keyed.select(F.col(k).alias("k"), F.col(i).alias("i"), F.col("size").alias("s")))
    total = slim.agg(F.coalesce(F.sum("s"), F.lit(0))).head()[0]
    ranges = _ranges(total, shards, range_bytes)
    parts = shards * ranges
    # ceil(total * n / parts) bytes lie left of the nth cut
    cuts = find_splitters(slim, [-(-total * n // parts) for n in range(1, parts)], int(tolerance * total / shards)) if total else []
    starts = [0, *(c.rows_below for c in cuts)]
    offsets = [starts[n] - starts[n - n % ranges] for n in range(len(starts))]
    within = Window.partitionBy(part).orderBy(k, i, "size")
    # One task per range, by its number: a hash of it would let ranges share tasks.
    apart = keyed.withColumn(part, _range_of(cuts, k, i).cast("int")).repartitionById(max(1, len(starts)), F.col(part))
    moved = apart.withColumn(place, F.row_number().over(within))
    offset = F.element_at(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col(part) + 1)
    return moved.withColumns({"shard": F.floor(F.col(part) / ranges).cast("int"), "slot": (offset + F.col(place) - 1).cast("long")}).drop(k, i, part, place)
