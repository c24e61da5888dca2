"""Bit windows as pairs of columns (lo, hi), both null for the whole object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two windows share a bit; a null end is open. Never null."""
    return F.coalesce(a_lo <= b_hi, F.lit(True)) & F.coalesce(b_lo <= a_hi, F.lit(True))


def common(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> tuple[Column, Column]:
    """The bits both have: greatest() and least() skip nulls, as open ends should be."""
    return F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)


def whole(lo: Column, hi: Column, width: Column) -> Column:
    """Whether a window is all of an object of that width."""
    return F.coalesce((lo == 0) & (hi + 1 >= width), lo.isNull() & hi.isNull())


def normal(lo: Column, hi: Column, width: Column) -> tuple[Column, Column]:
    """The window, as nulls where it is the whole object."""
    all_of = whole(lo, hi, width)
    return F.when(~all_of, lo), F.when(~all_of, hi)


def size(lo: Column, hi: Column, width: Column) -> Column:
    """Bits in a window; null if they are not known."""
    return F.coalesce(hi - lo + 1, width)


def both(a: Column, b: Column) -> Column:
    """AND of 0, 1 and null, as an int."""
    return ((a == 1) & (b == 1)).cast("int")


def narrowed(lo: Column, hi: Column, exact: Column, chain: Column, shift: Column, cut_lo: Column, cut_hi: Column) -> tuple[Column, Column]:
    """A net's window cut to the bits [cut_lo, cut_hi] of a terminal. shift: the terminal's bit that is the
    window's first. Only an exact window, mapped bit for bit (chain), can be cut; others stay as they are."""
    base = F.coalesce(lo, F.lit(0)) - F.coalesce(shift, F.lit(0))
    able = chain & F.coalesce(exact == 1, F.lit(False))
    return F.when(able & cut_lo.isNotNull(), base + cut_lo).otherwise(lo), F.when(able & cut_hi.isNotNull(), base + cut_hi).otherwise(hi)
