"""Operators by name, and functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import align
from .functions.alleles import CHANGES
from .operators import alleles, distributions, filters, intervals, joins, stats, validate
from .workers import ship

OPERATORS: dict[str, Callable] = {
    f"{m.__name__.rpartition('.')[2]}.{n}": f
    for m in (alleles, distributions, filters, intervals, joins, stats, validate)
    for n, f in vars(m).items()
    if callable(f) and not n.startswith("_") and getattr(f, "__module__", "") == m.__name__
}


def register(spark: SparkSession) -> list[str]:
    """Makes SQL functions of this session: allele_trim(pos, ref, alt), base_change tests
    is_ts/is_tv/is_deam/is_am(ref, alt), genotype_count(n_alt, ploidy), left_align(pos, ref, alt,
    left) and sw_cigar(ref, alt, before, after). Returns their names."""
    ship(spark)
    names = []
    for kind, pairs in CHANGES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_{kind}(r STRING, a STRING) RETURNS BOOLEAN RETURN concat(upper(r), upper(a)) IN ({', '.join(map(repr, pairs))})")
        names.append(f"is_{kind}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION genotype_count(n INT, p INT) RETURNS BIGINT RETURN "
        "CASE WHEN p <= 0 THEN 1 ELSE aggregate(sequence(1, p), 1L, (x, i) -> CAST(floor(x * (n + i) / i) AS BIGINT)) END"
    )

    @F.pandas_udf("struct<npos:int,nref:string,nalt:string>")
    def allele_trim(pos: pd.Series, ref: pd.Series, alt: pd.Series) -> pd.DataFrame:
        out = []
        for p, r, a in zip(pos, ref, alt, strict=True):
            while min(len(r), len(a)) > 1 and r[-1] == a[-1]:
                r, a = r[:-1], a[:-1]
            while min(len(r), len(a)) > 1 and r[0] == a[0]:
                r, a, p = r[1:], a[1:], p + 1
            out.append((p, r, a))
        return pd.DataFrame(out, columns=["npos", "nref", "nalt"])

    @F.pandas_udf("struct<npos:int,nref:string,nalt:string>")
    def left_align(pos: pd.Series, ref: pd.Series, alt: pd.Series, left: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align.left_align(*x) for x in zip(pos, ref, alt, left, strict=True)], columns=["npos", "nref", "nalt"])

    @F.pandas_udf("string")
    def sw_cigar(ref: pd.Series, alt: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([x.cigar for x in align.smith_watermans([align.in_flanks(*x) for x in zip(ref, alt, before, after, strict=True)])])

    for f in (allele_trim, left_align, sw_cigar):
        spark.udf.register(f.__name__, f)
    return [*names, "genotype_count", "allele_trim", "left_align", "sw_cigar"]
