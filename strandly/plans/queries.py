"""The engine's queries; each is an operator on derived call sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import align, fields
from ..operators import alleles as O
from ..operators import distributions, filters, joins, stats, validate
from ..operators import intervals as I
from ..sources import bed, vcf
from .derived import SAMPLES, calls_a, calls_b, intervals, numbered, variants

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PER_ALLELE = ("AC",)
ALLELE = ["record_id", "chrom", "npos", "aid", "nref", "nalt", "cls"]
INFO_FIELDS = (validate.Field("DP", "1", "Integer"), validate.Field("AC", "A", "Integer"), validate.Field("DB", "0", "Flag"))
FORMAT_FIELDS = (validate.Field("GT", "1", "String"), validate.Field("GQ", "1", "Character"))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _alleles(records: DataFrame, *keep: str) -> DataFrame:
    return O.explode_alleles(records, keep)


@query
def scan_variants(spark, d):
    return variants(spark, d)


@query
def alleles_normalised(spark, d):
    return _alleles(variants(spark, d)).select(*ALLELE, "snp_arity")


@query
def class_counts(spark, d):
    return _alleles(variants(spark, d)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def _filtered(**options):
    return lambda spark, d: filters.filter_records(variants(spark, d), **options)


def _named(name: str, f: Query) -> None:
    QUERIES[name] = f


_named("filter_quality", lambda s, d: _filtered(quality=20)(s, d).select("record_id", "flt"))
_named("filter_mark_pass", lambda s, d: _filtered(mark_pass=True)(s, d).select("record_id", "flt"))
_named("filter_pass_only", lambda s, d: _filtered(quality=20, pass_only=True)(s, d).select("record_id", "qual", "flt"))
_named("filter_strip_info", lambda s, d: _filtered(strip_records=["DB"])(s, d).select("record_id", "info"))
_named("filter_keep_info", lambda s, d: _filtered(keep_records=["DB"])(s, d).select("record_id", "info"))
_named("filter_delete_info", lambda s, d: _filtered(delete_info=["AC", "DB"])(s, d).select("record_id", "info"))
_named("filter_remove_genotypes", lambda s, d: _filtered(remove_genotypes=True, samples=SAMPLES)(s, d).select("record_id", "chrom", "pos", "rsid", "ref", "alt", "flt", "info"))


@query
def filter_class_snp(spark, d):
    return O.select_classes(variants(spark, d), [A.SNP], PER_ALLELE, SAMPLES).select("record_id", "pos", "ref", "alt", "info", *SAMPLES)


@query
def filter_class_indel(spark, d):
    return O.select_classes(variants(spark, d), [A.INS, A.DEL], PER_ALLELE, SAMPLES).select("record_id", "alt", "info")


@query
def filter_snp_reanchor(spark, d):
    return O.reanchor(variants(spark, d), per_allele=PER_ALLELE, genotypes=SAMPLES).select("record_id", "chrom", "pos", "ref", "alt")


@query
def filter_clear_dbsnp(spark, d):
    rows = variants(spark, d).withColumn("info", F.when(F.col("rsid") != ".", F.concat("info", F.lit(";dbSNP"))).otherwise(F.col("info")))
    return filters.filter_records(rows, clear_dbsnp=True).select("record_id", "rsid", "info")


@query
def filter_find_hets(spark, d):
    return filters.find_hets(variants(spark, d), SAMPLES).select("record_id", "info")


@query
def filter_sample_subset(spark, d):
    return filters.sample_subset(variants(spark, d), SAMPLES, ["S1", "S3"]).select("record_id")


@query
def split_mnps(spark, d):
    return O.split_mnps(variants(spark, d)).select("record_id", "chrom", "aid", "pos", "ref", "alt", "info")


@query
def dedupe_snps(spark, d):
    records = variants(spark, d)
    snps = _alleles(records).filter(F.col("cls") == A.SNP).select("record_id", "chrom", "aid", F.col("npos").alias("pos"), F.col("nref").alias("ref"), F.col("nalt").alias("alt"), F.lit(False).alias("from_mnp"))
    split = O.split_mnps(records).select("record_id", "chrom", "aid", "pos", "ref", "alt", F.lit(True).alias("from_mnp"))
    return filters.dedupe_alleles(snps.unionAll(split), F.col("from_mnp"))


@query
def merge_files(spark, d):
    return joins.merge([calls_a(spark, d), calls_b(spark, d)]).select("file_idx", "record_id", "chrom", "pos", "ref", "alt")


def _ab(spark, d, *keep):
    return _alleles(calls_a(spark, d), *keep), _alleles(calls_b(spark, d), *keep)


@query
def intersect_common_a(spark, d):
    a, b = _ab(spark, d)
    return joins.common(a, b).select(ALLELE)


@query
def intersect_common_b(spark, d):
    a, b = _ab(spark, d)
    return joins.common(b, a).select(ALLELE)


@query
def intersect_unique_a(spark, d):
    a, b = _ab(spark, d)
    return joins.unique(a, b).select(ALLELE)


@query
def intersect_unique_b(spark, d):
    a, b = _ab(spark, d)
    return joins.unique(b, a).select(ALLELE)


@query
def intersect_union(spark, d):
    a, b = _ab(spark, d)
    return joins.union(a, b).select(*ALLELE, "source")


@query
def intersect_sites_only(spark, d):
    a, b = _ab(spark, d)
    return joins.common(a, b, sites_only=True).select(ALLELE)


@query
def intersect_best_quality(spark, d):
    a, b = _ab(spark, d, "qual")
    return joins.best_quality(a, b, ["qual"])


@query
def intersect_pass_only(spark, d):
    a, b = _ab(spark, d, "flt")
    return joins.common(stats.passed(a), stats.passed(b)).select(ALLELE)


@query
def annotate_dbsnp(spark, d):
    return joins.annotate_dbsnp(calls_a(spark, d), calls_b(spark, d)).select("record_id", "rsid", "info")


@query
def annotate_dbsnp_sites(spark, d):
    return joins.annotate_dbsnp(calls_a(spark, d), calls_b(spark, d), sites_only=True).select("record_id", "rsid", "info")


@query
def annotate_vcf_filter(spark, d):
    return joins.annotate_filter(calls_a(spark, d), calls_b(spark, d)).select("record_id", "info")


@query
def annotate_bed(spark, d):
    records = variants(spark, d)
    return I.annotate_intervals(records, _alleles(records), intervals(spark, d)).select("record_id", "info")


@query
def bed_overlap(spark, d):
    return I.interval_join(_alleles(variants(spark, d)).select(ALLELE), intervals(spark, d))


@query
def bed_within(spark, d):
    return I.interval_join(_alleles(variants(spark, d)).select(ALLELE), intervals(spark, d), within=True)


@query
def bed_unique(spark, d):
    return I.outside(_alleles(variants(spark, d)).select(ALLELE), intervals(spark, d))


@query
def bed_segments(spark, d):
    return I.segments(intervals(spark, d))


@query
def bed_segments_named(spark, d):
    return I.segments_named(intervals(spark, d))


@query
def bed_merged(spark, d):
    return I.merged(intervals(spark, d))


@query
def bed_target_stats(spark, d):
    return I.target_stats(intervals(spark, d))


@query
def bed_distance_hist(spark, d):
    return I.distance_histogram(variants(spark, d).select("chrom", "pos"), intervals(spark, d))


def _stat_rows(spark, d) -> DataFrame:
    return _alleles(variants(spark, d), "rsid", "flt", "info", *SAMPLES)


@query
def stats_by_filter(spark, d):
    return stats.by_filter(_stat_rows(spark, d))


@query
def stats_pass_by_contig(spark, d):
    return stats.by_filter(_stat_rows(spark, d)).filter("ft = 'PASS'")


@query
def stats_totals_by_filter(spark, d):
    return stats.by_filter(_stat_rows(spark, d)).filter("chrom = 'total'")


@query
def stats_mnp_lengths(spark, d):
    return stats.mnp_lengths(_stat_rows(spark, d))


@query
def stats_mnp_split(spark, d):
    return stats.split_mnp_changes(O.split_mnps(variants(spark, d)))


@query
def stats_indel_lengths(spark, d):
    return stats.indel_lengths(_stat_rows(spark, d))


@query
def stats_samples(spark, d):
    return stats.by_sample(variants(spark, d), SAMPLES, quality=20)


def _own(tag: str) -> Column:
    return F.get(fields.values(F.col("info"), tag), F.col("aid")).try_cast("int")


@query
def stats_allele_count(spark, d):
    return stats.spectrum(_stat_rows(spark, d), _own("AC"), "ac")


@query
def stats_allele_freq(spark, d):
    return stats.spectrum(_stat_rows(spark, d), stats.frequency(SAMPLES), "af")


@query
def stats_detailed(spark, d):
    return stats.detailed(variants(spark, d), SAMPLES, "GQ", quality=10)


@query
def stats_annotations(spark, d):
    return stats.annotation_counts(_stat_rows(spark, d))


@query
def validate_info(spark, d):
    return validate.info_faults(variants(spark, d), INFO_FIELDS)


@query
def validate_genotypes(spark, d):
    return validate.genotype_faults(variants(spark, d), SAMPLES, FORMAT_FIELDS)


@query
def contig_check(spark, d):
    return joins.contig_check(calls_a(spark, d).filter("chrom <> 'chr7'"), calls_b(spark, d).filter("chrom <> 'chr9'"))


@query
def distribution_primary(spark, d):
    return distributions.primary(variants(spark, d), "DP", ["AC", "XX"])


@query
def distribution_hist(spark, d):
    return distributions.histogram(variants(spark, d), ["DP", "AC"])


def _kept(spark, d) -> DataFrame:
    rows = O.with_alleles(variants(spark, d)).withColumn("__keep", O.class_filter([A.SNP, A.MNP]))
    return O.rebuild(rows, PER_ALLELE, SAMPLES)


@query
def modify_info_number_a(spark, d):
    return _kept(spark, d).select("record_id", "alt", "info")


@query
def modify_genotypes(spark, d):
    return _kept(spark, d).select("record_id", *SAMPLES)


@query
def modify_genotype_numbers(spark, d):
    rows = O.with_alleles(numbered(spark, d)).withColumn("__keep", O.class_filter([A.SNP, A.MNP]))
    return O.rebuild(rows, PER_ALLELE, SAMPLES, {"GT": "1", "AO": "A", "AD": "R", "GL": "G"}).select("record_id", *SAMPLES)


HEADER = vcf.Header.parse([
    "##fileformat=VCFv4.1", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##INFO=<ID=AC,Number=A,Type=Integer,Description="Counts">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">', "#" + "\t".join([*vcf.COLUMNS, "FORMAT", *SAMPLES]),
])


def _text(spark, d) -> DataFrame:
    """The call set as lines of a file, between meta lines and empty ones."""
    body = vcf.lines(variants(spark, d), list(SAMPLES)).select("value")
    return body.unionAll(spark.createDataFrame([(x,) for x in [*HEADER.lines(), ""]], "value string"))


@query
def read_vcf_text(spark, d):
    return vcf.parse(_text(spark, d), HEADER, numbered=False).select("chrom", "pos", "rsid", "ref", "alt", "qual", "flt", "info", "format", *SAMPLES)


@query
def write_vcf_text(spark, d):
    return vcf.lines(variants(spark, d), list(SAMPLES)).select("record_id", "value")


@query
def read_bed_text(spark, d):
    return bed.parse(bed.lines(intervals(spark, d)).unionAll(spark.createDataFrame([("#chrom\tstart\tend",), ("track name=x",), ("",)], "value string")))


@query
def validate_records(spark, d):
    """Positions and qualities that are no numbers, as read from lines."""
    odd = lambda n, bad, text: F.when(F.col("record_id") % n == 0, bad).otherwise(text)
    rows = variants(spark, d).withColumns({"pos_raw": odd(7, "x1", F.col("pos").cast("string")), "qual_raw": odd(11, "high", F.col("qual").cast("string"))})
    return validate.record_faults(rows.withColumn("pos", odd(7, F.lit(0), F.col("pos"))))


@query
def validate_intervals(spark, d):
    rows = intervals(spark, d)
    return validate.interval_faults(rows.withColumn("e", F.when(F.col("s") % 5 == 0, F.col("s") - 2).otherwise(F.col("e"))))


@query
def validate_structural(spark, d):
    return validate.structural_alleles(_alleles(variants(spark, d))).select("record_id", "chrom", "npos", "aid", "allele", "cls")


@query
def validate_formats(spark, d):
    """Undeclared fields, samples with fewer fields than FORMAT, and alleles that are not there."""
    rows = variants(spark, d).withColumn("format", F.lit("GT:GQ:XX"))
    rows = rows.withColumn("S1", F.when((F.col("S1") != ".") & (F.col("record_id") % 3 == 0), F.lit("0/9:7")).otherwise(F.col("S1")))
    return validate.genotype_faults(rows, SAMPLES[:1], (validate.Field("GT", "1", "String"), validate.Field("GQ", "1", "Integer")))


@query
def missing_tags(spark, d):
    return filters.missing_tags(["DP", "MQ", "AC", "ZZ"], HEADER.frame(spark))


def _around(spark, d) -> DataFrame:
    """All alleles of known bases, with the reference before and after each derived from its place."""
    rows = _alleles(variants(spark, d)).filter(~F.col("cls").isin(A.SV, A.BND))
    bases = lambda side: F.translate(F.substring(F.md5(F.concat_ws(":", F.lit(side), "chrom", "npos")), 1, 16), "0123456789abcdef", "ACGTACGTACGTACGT")
    return rows.withColumns({"before": bases("before"), "after": bases("after")})


@query
def left_align(spark, d):
    """All alleles as they are, each after a number of repeats of its own."""
    rows = _alleles(variants(spark, d)).filter(~F.col("cls").isin(A.SV, A.BND))
    repeats = F.repeat(F.lit("TG"), (F.col("record_id") % 7).cast("int"))
    rows = rows.withColumn("left", F.concat(F.lit("ACCA"), repeats, F.when(F.col("nref").startswith("G"), "T").otherwise("")))
    return align.left_aligned(rows.select("record_id", "aid", "npos", "nref", "nalt", "left"))


@query
def sw_align(spark, d):
    return align.aligned(_around(spark, d)).select("record_id", "aid", "cls", "score", "consistent")


@query
def cigar(spark, d):
    return align.aligned(_around(spark, d)).select("record_id", "aid", "cls", "cigar")
