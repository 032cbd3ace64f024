"""Lists of samples, one name a line."""

from __future__ import annotations

import warnings

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, known: list[str]) -> list[str]:
    """Names that the call set has, in its order; a warning names the others."""
    names = {r["value"].strip() for r in spark.read.text(path).filter(F.trim(F.col("value")) != "").distinct().collect()}
    if unknown := sorted(names - set(known)):
        warnings.warn(f"samples that are not in the header: {', '.join(unknown)}", stacklevel=2)
    return [s for s in known if s in names]


def same(a: list[str], b: list[str]) -> bool:
    """Whether two files hold the same samples; warns if not."""
    if a != b:
        warnings.warn("the files have different samples", stacklevel=2)
    return a == b
