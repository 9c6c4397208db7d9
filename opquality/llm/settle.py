"""Components of documents from lists of candidates, without pairs of all members.

Each list holds sets that may link. Rounds go on until no list has a candidate left:

1. a list's hub is its least label's least set; each other member is held against the hub
   it meets most, one candidate per member and round;
2. what stars leave in different components is compared inside the lists, by signatures:
   a member outside a list's most frequent label meets all others of the list, block by
   block. Of the pairs that signatures do not rule out a task gives the nearest ones that
   tie its components together, a forest: fewer than it has components, however many
   members of a list may link. What marks rule out goes first, all at once; of the others the
   nearest of each set are verified first, then further ones as far as they are still in two
   components. The next round begins with those components only that had a candidate and are
   still two;
3. once a round finds few links beside the candidates that are left, or none, the candidates
   that stood behind the nearest are given, those compared before left out.

A candidate costs one comparison of whole sets, whatever the number of lists it is in. Lists
of one majority go to the same few tasks, which give a candidate once and not once a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opquality.llm.common import cut_counted, cut_small, map_arrow
from opquality.llm.components import components, least_labels
from opquality.llm.wordhash import MULTIPLIER, mix

# Members of a list that meet in one task.
BLOCK = 1 << 12
# Comparisons of signatures made at once.
AT_ONCE = 1 << 15
# Lists of up to so many members are compared side by side.
SHORT = 256
# Candidates of a task among which those found in several lists are told apart.
PAIRS_HELD = 1 << 18
# Tasks that the squares of one place in lists of one majority go to.
ROUTES = 16
# A round that finds a link for every so many candidates it leaves is followed by another like it.
LINKING = 4
# Ids up to this number are sent along as a broadcast, 8 bytes each.
BROADCAST_IDS = 2_000_000
SQUARE = ("key", "held_block", "asking_block")
# Pairs of so many elements together are compared by their marks.
MARKED_FROM = 1000
HELD, ASKS, BOTH = 0, 1, 2
EVERY = (1 << 31) - 1
GIVEN = ["a", "b", "label_a", "label_b", "apart"]

# Given pairs (a, b), those that link.
Verify = Callable[[DataFrame], DataFrame]


def may_link(n_a, n_b, apart, percent: int):
    """Whether sets of these sizes can link if at least so many elements are in one only."""
    return (100 + percent) * (n_a + n_b - apart) >= 2 * percent * (n_a + n_b)


def by_ids(df: DataFrame, ids: DataFrame, column: str | list[str], most: int | None = None) -> DataFrame:
    """Rows of df whose column is among ids; a broadcast only while they are few. They are
    counted only if it is not known that there are no more than so many."""
    few = (most is not None and most <= BROADCAST_IDS) or ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _beside(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs with the columns of both sides, suffixed _a and _b."""
    for side in ("b", "a"):
        pairs = pairs.join(of.withColumnsRenamed({c: side if c == "id" else f"{c}_{side}" for c in of.columns}), side)
    return pairs


def _apart(left: str, right: str) -> Column:
    """In how many bits two arrays differ."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _halved(column: str, other: str) -> Column:
    """Marks as short as the other's; sizes of sets that can link are at most one apart."""
    half = (F.size(column) / 2).cast("int")
    halves = F.zip_with(F.slice(column, F.lit(1), half), F.slice(column, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(column) > F.size(other), halves).otherwise(F.col(column))


@dataclass(frozen=True)
class Compare:
    """Compares pairs of sets: by signatures and, where sets are too large for these, by
    marks, which can only rule a link out, then by the whole sets. signatures_of gives id, n
    and signature of the ids asked for, marks_of id and marks, sets_of id and shingles."""

    signatures_of: Callable[[DataFrame], DataFrame]
    marks_of: Callable[[DataFrame], DataFrame]
    sets_of: Callable[[DataFrame], DataFrame]
    percent: int

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose sets overlap enough."""
        signed = _beside(pairs, self.signatures_of(_ids(pairs)))
        near, some = self._marked(*cut_counted(signed.where(may_link(F.col("n_a"), F.col("n_b"), _apart("signature_a", "signature_b"), self.percent)).select("a", "b", "n_a", "n_b")))
        return self.whole(near) if some else near

    def marked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), whose signatures were compared, without those that marks rule out."""
        return self._marked(*cut_counted(_beside(pairs, self.signatures_of(_ids(pairs)).select("id", "n"))))[0]

    def _marked(self, pairs: DataFrame, some: int) -> tuple[DataFrame, int]:
        large = pairs.where(F.col("n_a") + F.col("n_b") > MARKED_FROM)
        if large.isEmpty():
            return pairs.select("a", "b"), some
        marked = _beside(large, self.marks_of(_ids(large)))
        marked = marked.withColumns({"_a": _halved("marks_a", "marks_b"), "_b": _halved("marks_b", "marks_a")})
        return cut_counted(pairs.where(F.col("n_a") + F.col("n_b") <= MARKED_FROM).select("a", "b").unionByName(
            marked.where(may_link(F.col("n_a"), F.col("n_b"), _apart("_a", "_b"), self.percent)).select("a", "b"),
        ))

    def whole(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose sets overlap enough, by the sets alone."""
        both = _beside(pairs, self.sets_of(_ids(pairs))).withColumn("common", F.size(F.array_intersect("shingles_a", "shingles_b")))
        total = F.size("shingles_a") + F.size("shingles_b") - F.col("common")
        return cut_small(both.where(100 * F.col("common") >= self.percent * total).select("a", "b").distinct())


def _open(lists: DataFrame) -> DataFrame:
    """Entries of lists that hold more than one label."""
    state = lists.groupBy("key").agg(F.min("label").alias("_l0"), F.max("label").alias("_l1"))
    return lists.join(state.where("_l0 <> _l1").select("key"), "key", "left_semi")


def _star(open_lists: DataFrame, percent: int) -> DataFrame:
    """One candidate (a, b) per member that is not in its hub's component."""
    hubs = open_lists.groupBy("key").agg(F.min(F.struct("label", "id", "n")).alias("hub"))
    fits = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    held = open_lists.join(hubs, "key").where((F.col("label") != F.col("hub.label")) & fits)
    met = held.groupBy(F.col("id").alias("a"), F.col("hub.id").alias("b")).agg(F.sum("times").alias("count"))
    return met.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def _placed(open_lists: DataFrame, block: int) -> DataFrame:
    """Open lists cut up so that each two members of which one is outside the list's most
    frequent label meet once, in a square of at most about block asking and block held."""
    per_label = open_lists.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_of_label"))
    major = per_label.groupBy("key").agg(
        F.max_by("label", F.struct("_of_label", "label")).alias("_major"), F.max("_of_label").alias("_most"), F.sum("_of_label").alias("_all"),
    )
    blocks = lambda members: F.ceil(members / block).cast("int")
    at = open_lists.join(major, "key").withColumns({
        "outside": F.col("label") != F.col("_major"), "_place": F.xxhash64("id"), "_helds": blocks(F.col("_all")), "_asks": blocks(F.col("_all") - F.col("_most")),
    })
    everywhere = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = lambda count: F.pmod("_place", F.col(count)).cast("int")
    kept = ["key", "id", "n", "label", "outside", F.col("_major").alias("major")]
    # In a list of one square a member outside does both with one row.
    square = (F.col("_helds") == 1) & (F.col("_asks") == 1)
    role = F.when(square & F.col("outside"), BOTH).otherwise(HELD)
    held = at.select(*kept, role.alias("role"), own("_helds").alias("held_block"), everywhere("_asks").alias("asking_block"))
    asking = at.where(F.col("outside") & ~square).select(*kept, F.lit(ASKS).alias("role"), everywhere("_helds").alias("held_block"), own("_asks").alias("asking_block"))
    return held.unionByName(asking)


@dataclass(frozen=True)
class _Members:
    """Rows of squares, as columns; list is the number of a row's square."""

    list: np.ndarray
    who: np.ndarray
    n: np.ndarray
    label: np.ndarray
    outside: np.ndarray
    role: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, edges: np.ndarray) -> "_Members":
        number = np.zeros(table.num_rows, dtype=np.int64)
        number[edges[1:]] = 1
        who, n, label, role = (table[c].to_numpy().astype(np.int64) for c in ("id", "n", "label", "role"))
        words = table["signature"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(who), -1)
        return cls(np.cumsum(number), who, n, label, table["outside"].to_numpy(zero_copy_only=False), role, words)

    def take(self, rows: np.ndarray) -> "_Members":
        return _Members(*(getattr(self, f.name)[rows] for f in fields(self)))

    def likely(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
        """Of the pairs of these rows those that signatures do not rule out."""
        apart = np.bitwise_count(self.words[a] ^ self.words[b]).sum(axis=1, dtype=np.int64)
        keep = may_link(self.n[a], self.n[b], apart, percent)
        a, b = a[keep], b[keep]
        return self.who[a], self.who[b], self.label[a], self.label[b], apart[keep]


def forest(label_a: np.ndarray, label_b: np.ndarray) -> np.ndarray:
    """Of links between labels, the best first, the rows of those that tie together all that
    the links tie together, with no link to spare."""
    chosen, left = [np.zeros(0, dtype=np.int64)], np.flatnonzero(label_a != label_b)
    x, y = label_a[left], label_b[left]
    while len(left):
        # The best link of each label; as the order is strict, they close no ring.
        best = np.unique(np.unique(np.stack((x, y), axis=1).reshape(-1), return_index=True)[1] // 2)
        chosen.append(left[best])
        nodes, least = least_labels(x[best], y[best])
        x, y = (least[np.searchsorted(nodes, z)] for z in (x, y))
        two = x != y
        left, x, y = left[two], x[two], y[two]
    return np.sort(np.concatenate(chosen))


class _Pairs:
    """Candidates of a task, as columns GIVEN; what several of its lists have in common
    leaves it once. With nearest, only the best that tie its labels together do."""

    def __init__(self, nearest: bool):
        self.nearest = nearest
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > PAIRS_HELD:
            self.parts = [self._once()]
            self.size = len(self.parts[0][0])
            if self.size > PAIRS_HELD // 2:
                yield from self.all()

    def _once(self) -> tuple[np.ndarray, ...]:
        a, b, label_a, label_b, apart = (np.concatenate(x) for x in zip(*self.parts))
        if self.nearest:
            # Equally near ones in any order, lest all of them tie to one set.
            order = np.lexsort((mix(a.view(np.uint64) * MULTIPLIER + b.view(np.uint64)), apart))
            kept = order[forest(label_a[order], label_b[order])]
        else:
            order = np.lexsort((b, a))
            first = np.ones(len(order), dtype=bool)
            first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            kept = order[first]
        return tuple(x[kept] for x in (a, b, label_a, label_b, apart))

    def all(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            found, self.parts, self.size = self._once(), [], 0
            for lo in range(0, len(found[0]), AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + AT_ONCE]) for x in found], names=GIVEN)


def _candidates(open_lists: DataFrame, signatures_of: Callable[[DataFrame], DataFrame], percent: int, nearest: bool, block: int) -> DataFrame:
    """Pairs (a, b) of different components that sizes and signatures do not rule out, with
    their labels; with nearest, only the best that tie the components of a task together, so
    that every two components that have such a pair are on a path of these."""
    marks = signatures_of(open_lists.select("id").distinct()).select("id", "signature")
    placed = _placed(open_lists, block).join(marks, "id")

    def in_short_lists(rows: _Members) -> Iterator[tuple[np.ndarray, ...]]:
        """Whole lists, side by side: each member with the next ones of its list by size."""
        rows = rows.take(np.lexsort((rows.n, rows.list)))
        ends, step = np.searchsorted(rows.list, rows.list, side="right"), 1
        left = np.flatnonzero(np.arange(len(ends)) + 1 < ends)
        while len(left):
            right = left + step
            fits = rows.n[left] * 100 >= rows.n[right] * percent
            left, right = left[fits], right[fits]
            two = (rows.label[left] != rows.label[right]) & (rows.outside[left] | rows.outside[right])
            asks_left = rows.outside[left] & (~rows.outside[right] | (rows.who[left] > rows.who[right]))
            for lo in range(0, len(left), AT_ONCE):
                l, r = (x[lo:lo + AT_ONCE][two[lo:lo + AT_ONCE]] for x in (left, right))
                turned = ~asks_left[lo:lo + AT_ONCE][two[lo:lo + AT_ONCE]]
                yield rows.likely(np.where(turned, r, l), np.where(turned, l, r), percent)
            step += 1
            left = left[left + step < ends[left]]

    def in_long_list(rows: _Members) -> Iterator[tuple[np.ndarray, ...]]:
        """One square: each member that asks with all that are held and of a size to link."""
        held = np.flatnonzero(rows.role != ASKS)
        held = held[np.argsort(rows.n[held], kind="stable")]
        sizes = rows.n[held]
        for u in np.flatnonzero(rows.role != HELD).tolist():
            lo, hi = np.searchsorted(sizes, -(-rows.n[u] * percent // 100)), np.searchsorted(sizes, rows.n[u] * 100 // percent, side="right")
            other = held[lo:hi]
            other = other[(rows.label[other] != rows.label[u]) & (~rows.outside[other] | (rows.who[other] < rows.who[u]))]
            who, found, label_a, label_b, apart = rows.likely(np.full(len(other), u), other, percent)
            if nearest and len(found) > 1:
                order = np.lexsort((found, apart, label_b))
                first = np.ones(len(found), dtype=bool)
                first[1:] = label_b[order][1:] != label_b[order][:-1]
                order = order[first]
                found, label_b, apart = found[order], label_b[order], apart[order]
            yield who[:len(found)], found, label_a[:len(found)], label_b, apart

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Pairs(nearest)

        def given(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of whole squares, which begin at these rows."""
            rows = _Members.of(table, edges)
            lengths = np.diff([*edges, table.num_rows])
            # A member that both asks and is held is in the only square of its list.
            whole = (lengths <= SHORT) & (np.maximum.reduceat(rows.role == ASKS, edges) == 0) & (np.maximum.reduceat(rows.role, edges) == BOTH)
            short = np.repeat(whole, lengths)
            for produced in (in_short_lists(rows.take(np.flatnonzero(short))), *(in_long_list(rows.take(np.arange(edges[k], edges[k] + lengths[k]))) for k in np.flatnonzero(~whole))):
                for part in produced:
                    yield from found.add(part)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if not table.num_rows:
                continue
            change = np.flatnonzero(np.any([table[c].to_numpy()[1:] != table[c].to_numpy()[:-1] for c in SQUARE], axis=0)) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield from given(table.slice(0, last), np.concatenate(([0], change[:-1])))
                held = table.slice(last).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield from given(pa.Table.from_batches(held), np.zeros(1, dtype=np.int64))
        yield from found.all()

    route = ("major", F.pmod("key", F.lit(ROUTES)), *SQUARE[1:])
    ordered = placed.repartition(*route).sortWithinPartitions(*SQUARE).drop("major")
    pairs = map_arrow(ordered, tasks, "a long, b long, label_a long, label_b long, apart long")
    if nearest:
        best = F.min(F.struct("apart", "b"))
        return pairs.groupBy("a", "label_a", "label_b").agg(best["b"].alias("b"), best["apart"].alias("apart"))
    return pairs.distinct()


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.where("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _now(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the labels that their labels have become."""
    now = labels.select(F.col("node"), F.col("label").alias("_now"))
    for side in ("label_a", "label_b"):
        pairs = pairs.join(now, pairs[side] == now.node, "left").withColumn(side, F.coalesce("_now", side)).drop("node", "_now")
    return pairs


def settle(
    lists: DataFrame, signatures_of: Callable[[DataFrame], DataFrame], verify: Verify, percent: int, stars: int = 2, block: int = BLOCK,
    thin: Verify | None = None, whole: Verify | None = None,
) -> DataFrame:
    """lists: key, id, n, an entry per list and set, and times, for how many lists of the same
    members it stands, if not for one. Per set that links: node and label, the least set it
    can reach. signatures_of(ids) gives id and signature, bits of which two sets differ in no
    more than elements; verify(pairs) those pairs (a, b) that link. For pairs that signatures
    leave, thin takes out some that do not link, and whole is verify for those left.

    A list may be of any length: it is split among tasks. No entries give no rows.
    """
    spark = lists.sparkSession
    lists = lists if "times" in lists.columns else lists.withColumn("times", F.lit(1))
    tried = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, label long")
    named = lists.withColumn("label", F.col("id"))

    def untried(pairs: DataFrame) -> DataFrame:
        done = tried.select(F.col("a").alias("_high"), F.col("b").alias("_low"))
        ordered = pairs.withColumns({"_high": F.greatest("a", "b"), "_low": F.least("a", "b")})
        return ordered.join(done, ["_high", "_low"], "left_anti").drop("_high", "_low")

    def compare(pairs: DataFrame, by: Verify) -> tuple[int, int]:
        """Verifies pairs that were not tried yet, and joins the components of what links:
        how many there were, and how many link."""
        nonlocal tried, labels, named
        fresh, some = cut_counted(_in_order(pairs))
        if not some:
            return 0, 0
        found = by(fresh)
        tried = cut_small(tried.unionByName(fresh))
        linking = found.count()
        if linking:
            # A node's link to the least of its component stands for those that led there.
            labels = cut_small(components(found.select("a", "b").unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))
            named = lists.join(labels, lists.id == labels.node, "left").select("key", "id", "n", "times", F.coalesce("label", "id").alias("label"))
        return some, linking

    def thinned(pairs: DataFrame) -> DataFrame:
        """Pairs that were not tried yet, without those that thin takes out, which need no
        further trial."""
        nonlocal tried
        if thin is None:
            return pairs
        fresh, some = cut_counted(_in_order(untried(pairs)))
        if not some:
            return pairs.limit(0)
        left = thin(fresh)
        tried = cut_small(tried.unionByName(fresh.join(left, ["a", "b"], "left_anti")))
        return cut_small(untried(pairs))

    for _ in range(stars):
        if not compare(untried(_star(_open(named), percent)), verify)[1]:
            break
    (still, entries), nearest = cut_counted(_open(named)), True
    while entries:
        pairs = cut_small(_candidates(still, signatures_of, percent, nearest, block))
        likely, joined, most = thinned(pairs), 0, 1
        while True:
            # The nearest of a set first; what it links with takes others along. Then the
            # next 8, 64, ... of those still in another component, all once none linked.
            two = untried(_now(likely, labels).where("label_a <> label_b"))
            some, linking = compare(two.withColumn("_place", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))).where(F.col("_place") <= most).select("a", "b"), whole or verify)
            if not some:
                break
            joined, most = joined + linking, most * 8 if linking else EVERY
        if not nearest:
            break
        # Only components that had a candidate and are still two can have another.
        apart, left = cut_counted(_now(pairs.select("label_a", "label_b").distinct(), labels).where("label_a <> label_b"))
        active, many = cut_counted(apart.select(F.explode(F.array("label_a", "label_b")).alias("label")).distinct())
        (still, entries), nearest = cut_counted(_open(by_ids(named, active, "label", many))), joined * LINKING > left
    return labels
