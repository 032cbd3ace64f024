"""Call set against call set: intersection, annotation, merging, coverage of contigs.

Matches are equi-joins on the normalised allele (or the site and class); neither input needs an
order, and contigs may come in any. Structural alleles and rearrangements are not comparable:
common and unique drop them at loci that both sets hold, union and annotation pass them through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from .alleles import KEY, SITE, explode_alleles

_LOOSE = (A.SV, A.BND)


def _keys(sites_only: bool) -> list[str]:
    return SITE if sites_only else KEY


def common(a: DataFrame, b: DataFrame, sites_only: bool = False) -> DataFrame:
    """Alleles of a with a match in b."""
    on = _keys(sites_only)
    return a.filter(~F.col("cls").isin(*_LOOSE)).join(b.select(on), on, "left_semi")


def unique(a: DataFrame, b: DataFrame, sites_only: bool = False) -> DataFrame:
    """Alleles of a without a match in b. One anti join by place: there, structural alleles and
    rearrangements match any allele, others one of their class and bases."""
    loose = F.col("a.cls").isin(*_LOOSE)
    same = F.lit(True)
    for c in _keys(sites_only)[2:]:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    on = (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.npos") == F.col("b.npos")) & (loose | same)
    return a.alias("a").join(b.select(*KEY).alias("b"), on, "left_anti")


def union(a: DataFrame, b: DataFrame, sites_only: bool = False) -> DataFrame:
    """Alleles of a, and those of b that a does not have, with `source` 0 or 1."""
    on = _keys(sites_only)
    rest = b.join(a.select(on), on, "left_anti")
    return a.withColumn("source", F.lit(0)).unionByName(rest.select(a.columns).withColumn("source", F.lit(1)))


def best_quality(a: DataFrame, b: DataFrame, keep: list[str]) -> DataFrame:
    """For each allele in both sets the row of higher quality: of equal ones that of a, then the
    smaller record_id. One grouping, combined on the map side; no join."""
    both = a.select(*KEY, "record_id", *keep, F.lit(0).alias("source")).unionByName(b.select(*KEY, "record_id", *keep, F.lit(1).alias("source")))
    both = both.filter(~F.col("cls").isin(*_LOOSE))
    order = F.struct(F.coalesce("qual", F.lit(0.0)).alias("q"), (-F.col("source")).alias("s"), (-F.col("record_id")).alias("r"))
    row = F.struct("record_id", "source", *keep)
    best = both.groupBy(KEY).agg(F.max_by(row, order).alias("r"), F.min("source").alias("lo"), F.max("source").alias("hi")).filter("lo = 0 AND hi = 1")
    return best.select(*KEY, "r.record_id", "r.source", *[F.col(f"r.{c}").alias(c) for c in keep])


def annotate(records: DataFrame, other: DataFrame, value: str, sites_only: bool = False) -> DataFrame:
    """Records with `added`: the distinct values, in order, of a column of `other` over all matches
    of their alleles; null without a match. All records come back."""
    on = _keys(sites_only)
    seen = explode_alleles(other, [value]).filter(F.col(value).isNotNull() & (F.col(value) != ".")).select(*on, value).distinct()
    found = explode_alleles(records).select("record_id", *on).join(seen, on)
    found = found.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias("added"))
    return records.join(found, "record_id", "left")


def annotate_dbsnp(records: DataFrame, dbsnp: DataFrame, sites_only: bool = False) -> DataFrame:
    """ID becomes those of the matching alleles, INFO gets the flag dbSNP."""
    from ..functions.fields import with_entry

    rows = annotate(records, dbsnp.withColumn("__id", F.col("rsid")), "__id", sites_only)
    hit = F.col("added").isNotNull()
    return rows.withColumn("rsid", F.coalesce("added", "rsid")).withColumn("info", F.when(hit, with_entry(F.col("info"), F.lit("dbSNP"))).otherwise(F.col("info"))).drop("added")


def annotate_filter(records: DataFrame, other: DataFrame, sites_only: bool = False) -> DataFrame:
    """INFO gets the FILTER names of the matching alleles' records."""
    from ..functions.fields import with_entry

    rows = annotate(records, other.withColumn("__flt", F.col("flt")), "__flt", sites_only)
    return rows.withColumn("info", F.when(F.col("added").isNotNull(), with_entry(F.col("info"), F.col("added"))).otherwise(F.col("info"))).drop("added")


def merge(files: list[DataFrame], ordered: bool = False) -> DataFrame:
    """All records of two or more files with file_idx, columns by name as in the first; globally
    ordered by contig (of first appearance), position and record on request."""
    if len(files) < 2:
        raise ValueError("merge takes two files or more")
    out = files[0].withColumn("file_idx", F.lit(0))
    for i, f in enumerate(files[1:], 1):
        out = out.unionByName(f.withColumn("file_idx", F.lit(i)), allowMissingColumns=True)
    if ordered:
        first = out.groupBy("chrom").agg(F.min(F.struct("file_idx", "record_id")).alias("first"))
        out = out.join(F.broadcast(first), "chrom").orderBy("first", "pos", "file_idx", "record_id").drop("first")
    return out


def contig_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per contig the records of each set, and whether both hold it."""
    both = a.select("chrom", F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select("chrom", F.lit(0), F.lit(1)))
    return both.groupBy("chrom").agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b")).withColumn("shared", (F.col("n_a") > 0) & (F.col("n_b") > 0))


def contig_order(records: DataFrame) -> DataFrame:
    """Contigs by first appearance: chrom, n, first_id, last_id, and whether their record ids are
    apart from those of all other contigs (contiguous). A row for each contig."""
    from pyspark.sql import Window

    own = records.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
    by = Window.orderBy("first_id")
    return own.withColumn("chrom_idx", F.row_number().over(by) - 1).withColumn("contiguous", F.coalesce(F.lead("first_id").over(by) > F.col("last_id"), F.lit(True)))
