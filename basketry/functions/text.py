"""String normalisation and parsing as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value; fixed values.
SENTINELS = ("", "NAN", "NONE")
CAMPAIGNS = ("A", "B", "C")
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normalised(x: Column, missing: str = "MISSING") -> Column:
    """Trimmed upper case; null and sentinels become `missing`."""
    t = F.upper(F.trim(x.cast("string")))
    return F.when(t.isNull() | t.isin(*SENTINELS), missing).otherwise(t)


def collapsed(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def campaign(x: Column) -> Column:
    t = F.upper(F.trim(x))
    return F.when(t.isin(*CAMPAIGNS), t).otherwise("NONE")


def without_point_zero(x: Column) -> Column:
    return F.regexp_replace(x, r"\.0$", "")


def group_part(clean: Column, first: int) -> Column:
    """Two characters of a group code from `first`, padded with X."""
    return F.when(clean.isNull() | (clean == "MISSING"), "MISSING").otherwise(F.rpad(F.substring(clean, first, 2), 2, "X"))


def pack(content: Column) -> Column:
    """struct(is_multipack, pack_n, pack_size, pack_total_size) of a content such as 6X4X200.

    Parts that are no numbers are skipped. All factors but the last multiply to the number of packs,
    at least one.
    """
    parts = F.filter(F.transform(F.split(F.upper(F.trim(content)), "X"), lambda p: F.trim(p)), lambda p: p.rlike(NUMBER))
    numbers = F.transform(parts, lambda p: p.cast("double"))
    n = F.size(numbers)
    factor = F.aggregate(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), F.lit(1.0), lambda acc, x: acc * x)
    several = F.coalesce(n > 1, F.lit(False))
    pack_n = F.when(several, F.greatest(F.lit(1), F.floor(factor)).cast("int")).otherwise(1)
    size = F.when(F.coalesce(n > 0, F.lit(False)), F.element_at(numbers, -1))
    return F.struct(several.cast("int").alias("is_multipack"), pack_n.alias("pack_n"), size.alias("pack_size"), (pack_n * size).alias("pack_total_size"))


def pack_integers(content: Column) -> Column:
    """struct(is_multipack, pack_n, pack_size): the variant that needs digits, X, digits, and reads integers only."""
    s = F.upper(F.trim(content))
    numbers = F.transform(F.regexp_extract_all(s, F.lit("([0-9]+)"), F.lit(1)), lambda p: p.cast("long"))
    multi = F.coalesce(s.rlike("[0-9]+X[0-9]+"), F.lit(False))
    factor = F.aggregate(F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), F.lit(1).cast("long"), lambda acc, x: acc * x)
    size = F.when(multi, F.try_element_at(numbers, F.lit(-1))).otherwise(F.try_element_at(numbers, F.lit(1)))
    return F.struct(multi.cast("int").alias("is_multipack"), F.when(multi, factor).otherwise(1).cast("int").alias("pack_n"), size.cast("double").alias("pack_size"))


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)
