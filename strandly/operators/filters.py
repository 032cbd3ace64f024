"""Filters and rewrites of records; all are narrow but the removal of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import six_digits


def filter_text(qual: Column, flt: Column, quality: float | None = None, mark_pass: bool = False) -> Column:
    """FILTER after a run: all PASS with mark_pass; else names that the quality threshold adds to
    those there ("." is none, and PASS goes when a filter fails); PASS for none if there was a
    threshold. A missing quality counts as 0."""
    if mark_pass:
        return F.lit("PASS")
    names = fields.filters(flt)
    if quality is None:
        return fields.joined(names)
    name = f"Q{quality:g}"
    failed = F.concat(F.filter(names, lambda x: x != "PASS"), F.array(F.lit(name)))
    return F.when(F.coalesce(qual, F.lit(0.0)) < quality, F.array_join(failed, ";")).when(F.size(names) == 0, "PASS").otherwise(F.array_join(names, ";"))


def filter_records(
    records: DataFrame,
    quality: float | None = None,
    mark_pass: bool = False,
    pass_only: bool = False,
    remove_genotypes: bool = False,
    delete_info: Sequence[str] = (),
    strip_records: Sequence[str] = (),
    keep_records: Sequence[str] = (),
    clear_dbsnp: bool = False,
    samples: Sequence[str] = (),
) -> DataFrame:
    """The record-level filters in one step. pass_only looks at FILTER after it was rewritten."""
    if strip_records and keep_records:
        raise ValueError("strip_records and keep_records exclude each other")
    out = records.withColumn("flt", filter_text(F.col("qual"), F.col("flt"), quality, mark_pass))
    if pass_only:
        out = out.filter(F.col("flt") == "PASS")
    if strip_records:
        out = out.filter(~fields.has_any(F.col("info"), strip_records))
    if keep_records:
        out = out.filter(fields.has_any(F.col("info"), keep_records))
    gone = [*delete_info, *(("dbSNP", "dbSNPX", "dbSNPM") if clear_dbsnp else ())]
    if gone:
        out = out.withColumn("info", fields.without(F.col("info"), gone))
    if clear_dbsnp:
        out = out.withColumn("rsid", F.lit("."))
    if remove_genotypes:
        out = out.drop("format", *samples)
    return out


def genotype_list(samples: Sequence[str]) -> Column:
    """array<struct(sample, value)> of sample columns."""
    return F.array(*[F.struct(F.lit(s).alias("sample"), F.col(s).alias("value")) for s in samples])


def find_hets(records: DataFrame, samples: Sequence[str]) -> DataFrame:
    """INFO gets HET=s1,s2 for samples with one reference and one other allele."""
    het = F.filter(genotype_list(samples), lambda g: fields.zygosity(fields.gt(g["value"])) == "het")
    names = F.transform(het, lambda g: g["sample"])
    return records.withColumn("info", F.when(F.size(names) > 0, fields.with_entry(F.col("info"), F.concat(F.lit("HET="), F.array_join(names, ",")))).otherwise(F.col("info")))


def sample_subset(records: DataFrame, samples: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Records of which a wanted sample carries an alternate allele; unknown names are ignored."""
    own = [s for s in wanted if s in samples]
    if not own:
        return records.limit(0)
    carries = [F.exists(fields.gt_alleles(fields.gt(F.col(s))), lambda a: ~a.isin("0", ".")) for s in own]
    out = carries[0]
    for c in carries[1:]:
        out = out | c
    return records.filter(out)


def dedupe_alleles(alleles: DataFrame, from_mnp: Column) -> DataFrame:
    """Of alleles with the same place and change the first stays, others than split multi-base ones
    before these. Places with different reference bases are different."""
    by = Window.partitionBy("chrom", "pos", "ref", "alt").orderBy(from_mnp.cast("int"), "record_id", "aid")
    return alleles.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def missing_tags(names: Sequence[str], header: DataFrame) -> DataFrame:
    """Names that the header (kind, id) declares no INFO tag for."""
    spark = header.sparkSession
    asked = spark.createDataFrame([(n,) for n in names], "id string")
    return asked.join(F.broadcast(header.filter("kind = 'INFO'").select("id")), "id", "left_anti")


def quality_text(records: DataFrame) -> DataFrame:
    """Quality as text: the text read if there is one, else six significant digits, "." for null."""
    made = F.coalesce(six_digits(F.col("qual")), F.lit("."))
    return records.withColumn("qual_raw", F.coalesce(F.col("qual_raw"), made) if "qual_raw" in records.columns else made)
