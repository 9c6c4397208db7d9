"""Exact quantiles of many columns, in two aggregates over the table.

A sketch brackets each quantile: two values between which its rank lies for sure. One
counting pass then says how many values lie below a bracket and keeps those inside, a few
in ten thousand. Brackets that would keep too much are narrowed first, by a sketch of what
is inside them. Ranks are counted, so a bracket that misses its quantile is noticed, and
widened. Nothing is unpivoted, shuffled by value or checkpointed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A sketch of n values is off by n / ACCURACY ranks at most; up to that many are just kept.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY
# A bracket keeps so many values at most, apart from its ends.
KEPT = 1 << 16
# Where the inside of a bracket is cut to narrow it.
STEPS = 64
CUTS = [k / STEPS for k in range(STEPS + 1)]


def sketch(values: Column, probabilities: Sequence[float]) -> Column:
    """Both ends of a bracket for each quantile, as an array of doubles."""
    asked = [p for q in probabilities for p in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    return F.percentile_approx(values.cast("double"), asked, ACCURACY)


@dataclass(frozen=True)
class Bracket:
    """The quantile q of n values, between two of them. size: how many lie between, at most."""

    name: str
    q: float
    n: int
    low: float
    high: float
    size: float

    @property
    def place(self) -> float:
        return (self.n - 1) * self.q

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.place), math.ceil(self.place)


def _counts(b: Bracket, value: Column, name: str) -> list[Column]:
    at = {"below": value < b.low, "low": value == b.low, "high": value == b.high}
    return [F.count_if(test).alias(f"{name}_{end}") for end, test in at.items()]


def _inside(b: Bracket, value: Column) -> Column:
    return F.when((value > b.low) & (value < b.high), value)


def _narrowed(b: Bracket, below: int, at_low: int, inside: int, cuts: Sequence[float] | None) -> Bracket:
    """The bracket between those cuts of the values inside it that its ranks lie between.
    Ends that do not move hold many equal values; there is little between them."""
    first, last = (r - below - at_low for r in b.ranks)
    if not cuts or first < -at_low or last > inside:
        return replace(b, size=0)
    margin = MARGIN * inside + 1
    at_first, at_last = math.floor((first - margin) / inside * STEPS), math.ceil((last + margin) / inside * STEPS)
    low = b.low if at_first < 0 else cuts[at_first]
    high = b.high if at_last > STEPS else cuts[at_last]
    moved = (low, high) != (b.low, b.high)
    return replace(b, low=low, high=high, size=(min(at_last, STEPS) - max(at_first, 0)) / STEPS * inside + 2 * margin if moved else 0)


def _value(b: Bracket, rank: int, below: int, at_low: int, inside: Sequence[float], at_high: int) -> float | None:
    """The value of a rank, None if the bracket misses it."""
    place = rank - below
    if place < 0:
        return None
    if place < at_low:
        return b.low
    place -= at_low
    if place < len(inside):
        return inside[place]
    return b.high if b.high > b.low and place - len(inside) < at_high else None


def _between(low: float, high: float, part: float) -> float:
    """Interpolated from the nearer end, which keeps equal ends exact."""
    if low == high:
        return low
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def exact_quantiles(
    df: DataFrame, known: Mapping[str, tuple[int, Sequence[float] | None]], probabilities: Sequence[float], kept: int = KEPT, accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles (linear interpolation) of the numeric columns named in ``known``, which
    gives their number of values, without NULL and NaN, and their ``sketch``.

    A column without values has NULLs. One aggregate runs for the counts, and one for each
    narrowing; both return one row.
    """
    # Doubles with NaN as missing, which no comparison then meets.
    columns = {name: F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double")) for name in known}
    found: dict[tuple[str, float], float | None] = {(name, q): None for name, (n, _) in known.items() if not n for q in probabilities}
    brackets = []
    for name, (n, ends) in known.items():
        for k, q in enumerate(probabilities):
            if n > accuracy and ends is not None:
                brackets.append(Bracket(name, q, n, ends[2 * k], ends[2 * k + 1], 2 * (MARGIN * n + 1)))
            elif n:
                brackets.append(Bracket(name, q, n, -math.inf, math.inf, n))
    while brackets:
        wide = [b for b in brackets if b.size > kept and b.low < b.high]
        if wide:
            asked = []
            for i, b in enumerate(wide):
                inside = _inside(b, columns[b.name])
                asked += [*_counts(b, columns[b.name], f"b{i}"), F.count(inside).alias(f"b{i}_inside"), F.percentile_approx(inside, CUTS, accuracy).alias(f"b{i}_cuts")]
            row = df.agg(*asked).first()
            narrowed = {b: _narrowed(b, *(row[f"b{i}_{k}"] for k in ("below", "low", "inside", "cuts"))) for i, b in enumerate(wide)}
            brackets = [narrowed.get(b, b) for b in brackets]
            continue
        asked = []
        for i, b in enumerate(brackets):
            value = columns[b.name]
            asked += [*_counts(b, value, f"b{i}"), F.collect_list(_inside(b, value)).alias(f"b{i}_values")]
        row = df.agg(*asked).first()
        missed = []
        for i, b in enumerate(brackets):
            counted = (row[f"b{i}_below"], row[f"b{i}_low"], sorted(row[f"b{i}_values"]), row[f"b{i}_high"])
            low, high = (_value(b, r, *counted) for r in b.ranks)
            if low is None or high is None:
                missed.append(replace(b, low=-math.inf, high=math.inf, size=b.n))
            else:
                found[b.name, b.q] = _between(low, high, b.place - b.ranks[0])
        brackets = missed
    return {name: [found[name, q] for q in probabilities] for name in known}
