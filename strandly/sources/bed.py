"""Interval files: zero-based half-open in the file, one-based inclusive here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """(chrom, s, e, name) of lines (value); comment, track and empty lines are skipped, a missing
    name is null. Intervals that end before they start stay, for the validation rule."""
    own = lines.filter(~F.col("value").rlike(r"^(#|track\b|browser\b|\s*$)")).withColumn("p", F.split(F.rtrim(F.col("value"), F.lit("\r\n")), "\t", 5))
    at = lambda i: F.get("p", F.lit(i))
    return own.select(at(0).alias("chrom"), (at(1).cast("int") + 1).alias("s"), at(2).cast("int").alias("e"), F.nullif(at(3), F.lit("")).alias("name"))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The intervals; with `strict` one that ends before it starts fails the job that reads it."""
    rows = parse(spark.read.text(path))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("interval ends before it starts: "), "chrom", F.lit(":"), F.col("s").cast("string")))
        rows = rows.withColumn("e", F.when(F.col("e") < F.col("s") - 1, wrong.cast("int")).otherwise(F.col("e")))
    return rows


def lines(intervals: DataFrame) -> DataFrame:
    """The intervals as lines (value) of a file."""
    parts = [F.col("chrom"), (F.col("s") - 1).cast("string"), F.col("e").cast("string"), F.col("name")]
    return intervals.select(F.concat_ws("\t", *parts).alias("value"))


def write(intervals: DataFrame, path: str) -> None:
    lines(intervals).write.mode("overwrite").text(path)
