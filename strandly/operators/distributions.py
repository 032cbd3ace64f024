"""Distributions of INFO values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields


def primary(records: DataFrame, key: str, others: Sequence[str]) -> DataFrame:
    """Per first value of INFO tag `key`: the records, and the mean of the first values of other
    tags over all of them (a missing or unreadable value counts as 0)."""
    first = lambda t: F.get(fields.values(F.col("info"), t), F.lit(0))
    rows = records.select(first(key).alias("value"), *[F.coalesce(first(t).try_cast("double"), F.lit(0.0)).alias(t) for t in others]).filter("value IS NOT NULL")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(t) / F.count(F.lit(1)), 6).alias(f"mean_{t}") for t in others])


def histogram(records: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Counts by first value of each tag, and by quality as tag QUAL."""
    first = [F.struct(F.lit(t).alias("tag"), F.get(fields.values(F.col("info"), t), F.lit(0)).try_cast("double").alias("value")) for t in tags]
    rows = records.select(F.explode(F.array(*first, F.struct(F.lit("QUAL").alias("tag"), F.col("qual").alias("value")))).alias("x"))
    return rows.filter("x.value IS NOT NULL").groupBy(F.col("x.tag").alias("tag"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
