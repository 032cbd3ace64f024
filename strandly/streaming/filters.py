"""The stateless filters over lines that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.alleles import select_classes
from ..operators.filters import filter_records
from ..sources import vcf


def filter_stream(spark: SparkSession, folder: str, header: vcf.Header, classes: tuple[str, ...] = (), per_allele: tuple[str, ...] = (), **options) -> DataFrame:
    """Records of the files that come into a folder, filtered as `filter_records` does. All steps
    are narrow, so the stream needs no state and no watermark."""
    lines = spark.readStream.text(folder)
    out = filter_records(vcf.parse(lines, header, numbered=False), **options)
    if classes:
        out = select_classes(out, classes, per_allele, tuple(header.samples))
    return out
