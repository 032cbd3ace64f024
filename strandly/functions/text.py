"""Splitting, parsing and number helpers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once a row even if `use` names it in a lambda's body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_char(s: Column, mark: str) -> Column:
    """Pieces around one character: inner empty ones stay, a trailing one does not; "" has none."""
    parts = F.split(s, _quoted(mark), -1)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def split_most(s: Column, mark: str, most: int) -> Column:
    """At most `most` pieces, the last with the rest."""
    return F.split(s, _quoted(mark), most)


def split_any(s: Column, marks: str) -> Column:
    """Pieces around any of several characters, without empty ones."""
    return F.filter(F.split(s, "[" + "".join(map(_quoted, marks)) + "]"), lambda x: x != "")


def _quoted(mark: str) -> str:
    return "\\" + mark if not mark.isalnum() else mark


def leading_int(s: Column) -> Column:
    """The whole number that a text begins with, 0 without one."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1), F.lit("")), F.lit("S999999999999999999")).cast("long"), F.lit(0).cast("long"))


def leading_double(s: Column) -> Column:
    """The number that a text begins with, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def six_digits(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros, as %g prints one."""
    size = F.floor(F.log10(F.abs(x)))
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", x / F.pow(F.lit(10.0), size)), r"0+$", ""), r"\.$", "")
    power = F.concat(F.when(size < 0, "-").otherwise("+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    rounded = F.round(x / F.pow(F.lit(10.0), size - 5), 0) * F.pow(F.lit(10.0), size - 5)
    short = F.when(rounded == F.floor(rounded), rounded.cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), r"0+$", ""), r"\.$", ""))
    return F.when(x.isNull(), None).when(x == 0, "0").when((size < -4) | (size >= 6), F.concat(mantissa, F.lit("e"), power)).otherwise(short)


def factorial(n: int) -> int:
    return math.factorial(n)


def genotype_count(n_alt: Column, ploidy: Column) -> Column:
    """Genotypes of `ploidy` alleles out of n_alt + 1: C(n_alt + ploidy, ploidy), by exact products."""
    return F.aggregate(F.when(ploidy > 0, F.sequence(F.lit(1), ploidy)).otherwise(F.array().cast("array<int>")), F.lit(1).cast("long"), lambda a, i: F.floor(a * (n_alt + i) / i).cast("long"))
