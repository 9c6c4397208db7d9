"""Text cleaning: whitespace, blanks, zero padding, derived status, sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes. Spark's plain
# trim() only removes the space character.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" + "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
OPEN, CLOSED = "Open", "Closed"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def zfill(text: Column, width: int = 6) -> Column:
    """Left-pad with zeros, never truncating and keeping a leading sign first.

    ``text`` is used several times and should be a plain column.
    """
    first = F.left(text, F.lit(1))
    signed = F.concat(first, F.lpad(F.substring(text, 2, width), width - 1, "0"))
    padded = F.when(first.isin("+", "-"), signed).otherwise(F.lpad(text, width, "0"))
    return F.when(F.length(text) >= width, text).otherwise(padded)


def status_of(date_removed: Column) -> Column:
    """Closed once the removal date holds anything but blanks."""
    return F.when(is_blank(date_removed), OPEN).otherwise(CLOSED)


def contains_ignoring_case(text: Column, needle: str) -> Column:
    return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))


def leading_number(text: Column) -> Column:
    """The number a text begins with (sign, digits, fraction, exponent), else NULL."""
    found = F.regexp_extract(text, r"^-?\d+(\.\d*)?([eE][+-]?\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def natural_key(text: Column) -> Column:
    """Lower-cased text whose digit runs compare by value, however long they are.

    A run becomes its number of digits without leading zeros, itself as a run with that
    many digits of its own, and then the digits: longer numbers follow shorter ones.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def keyed(piece: Column) -> Column:
        digits = F.ltrim(piece, F.lit("0"))
        size = F.length(digits).cast("string")
        return F.when(piece.rlike(r"^\d"), F.concat(F.lpad(F.length(size).cast("string"), 2, "0"), size, digits)).otherwise(piece)

    return F.array_join(F.transform(pieces, keyed), "")
