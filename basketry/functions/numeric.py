"""Null-safe arithmetic and binning as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if b is zero or null."""
    return F.try_divide(a, b)


def clipped(x: Column, low=None, high=None) -> Column:
    """x within bounds; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def cycle(day: Column, length: int) -> Column:
    return F.pmod(day - 1, F.lit(length)) + 1


def week_block(day: Column, start: int = 26) -> Column:
    return (F.floor((day - start) / 7) + 1).cast("int")


def is_close(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def quantity_class(q: Column) -> Column:
    """Right-closed classes; zero belongs to the first; negative and null are no order."""
    return F.when(q.isNull() | (q < 0), "no_order").when(q <= 1, "1").when(q <= 2, "2").when(q <= 5, "3-5").when(q <= 10, "6-10").otherwise("10+")


def quantity_class_of_lines(q: Column) -> Column:
    """The classes of the order extract; null outside (0, inf)."""
    return F.when(q <= 0, None).when(q <= 1, "1").when(q <= 2, "2").when(q <= 3, "3").when(q <= 5, "4-5").when(q > 5, ">5")


def rounded_quantity(raw: Column, tolerance: float = 0.05) -> tuple[Column, Column]:
    """The nearest whole quantity (half to even) and whether it is implausible."""
    q = F.rint(raw).cast("long")
    return q, F.coalesce((F.abs(raw - F.rint(raw)) > tolerance) | (q <= 0), F.lit(False)).cast("int")


def edges_of(quantiles: Column, digits: int = 9) -> Column:
    """Interpolated equal-frequency edges, rounded, without duplicates, both ends included; none without quantiles."""
    none = F.array().cast("array<double>")
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(quantiles, none), lambda e: F.round(e, digits))))


def quantile_edges(x: Column, bins: int, digits: int = 9) -> Column:
    """Aggregate: the edges of a column, for frames whose distinct values fit one task; `features.fit_edges` is for others."""
    return edges_of(F.percentile(x, F.array(*(F.lit(k / bins) for k in range(bins + 1)))), digits)


def bin_label(x: Column, edges: Column, missing: str) -> Column:
    """Q01, Q02, ... of right-closed bins whose outer edges are infinite; `missing` for null or without bins."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    place = F.size(F.filter(inner, lambda e: e < x)) + 1
    return F.when(x.isNull() | (F.size(edges) < 2), missing).otherwise(F.concat(F.lit("Q"), F.lpad(place.cast("string"), 2, "0")))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """1..bins of right-closed bins of equal width, the lowest value in the first."""
    width = (high - low) / bins
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.try_divide(x - low, width)).cast("int"))))


def labelled(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed fixed bins, the lowest edge included."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((x <= high) & ((x > low) if low != edges[0] else (x >= low)), label).otherwise(out)
    return out
