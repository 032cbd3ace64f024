"""Statistics: partial and final aggregates over exploded alleles, filters and genotypes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import fields
from .alleles import explode_alleles
from .filters import genotype_list

ALL, TOTAL = "all", "total"


def ratio(n: Column, d: Column, scale: float = 1.0) -> Column:
    """n / d, 0 where d is 0."""
    return F.round(F.coalesce(F.lit(scale) * n / F.nullif(d, F.lit(0)), F.lit(0.0)), 6)


def known(rsid: str = "rsid") -> Column:
    return F.col(rsid) != "."


def change_counts(novel: Column, also: Column) -> list[Column]:
    """The eight counters of base changes of biallelic one-base alleles."""
    out = []
    for kind in A.CHANGES:
        hit = also & (F.col("cls") == A.SNP) & (F.col("snp_arity") == 2) & A.base_change(F.col("nref"), F.col("nalt"), kind)
        out += [F.count_if(hit & novel).alias(f"novel_{kind}"), F.count_if(hit & ~novel).alias(f"known_{kind}")]
    return out


def ratios() -> list[Column]:
    c = F.col
    known_, novel_ = c("known_ts") + c("known_tv"), c("novel_ts") + c("novel_tv")
    return [
        ratio(known_, novel_ + known_ + c("multi"), 100.0).alias("pct_dbsnp"),
        ratio(c("novel_ts") + c("known_ts"), c("novel_tv") + c("known_tv")).alias("tstv"),
        ratio(c("novel_ts"), c("novel_tv")).alias("novel_tstv"),
        ratio(c("known_ts"), c("known_tv")).alias("known_tstv"),
        ratio(c("novel_deam") + c("known_deam"), c("novel_am") + c("known_am")).alias("deam_am"),
        ratio(c("novel_deam"), c("novel_am")).alias("novel_deam_am"),
        ratio(c("known_deam"), c("known_am")).alias("known_deam_am"),
    ]


def by_filter(alleles: DataFrame) -> DataFrame:
    """Per contig (and "total") and filter name (and "all") the counters and ratios of alleles with
    rsid and flt. One explode and one grouping-sets aggregate; counts combine on the map side."""
    rows = alleles.withColumn("ft", F.explode(F.concat(F.array(F.lit(ALL)), F.when(F.size(fields.filters(F.col("flt"))) == 0, F.array(F.lit("."))).otherwise(fields.filters(F.col("flt"))))))
    counts = [
        *change_counts(~known(), F.lit(True)),
        F.count_if("multi_first").alias("multi"),
        *[F.count_if(F.col("cls") == x).alias(x) for x in (A.MNP, A.INS, A.DEL, A.COMPLEX)],
        F.count_if(F.col("cls").isin(A.SV, A.BND)).alias("other"),
    ]
    out = rows.groupingSets([["chrom", "ft"], ["ft"]], "chrom", "ft").agg(*counts)
    out = out.withColumn("chrom", F.coalesce("chrom", F.lit(TOTAL)))
    return out.select("*", *ratios())


def passed(alleles: DataFrame) -> DataFrame:
    return alleles.filter(F.array_contains(fields.filters(F.col("flt")), "PASS"))


def mnp_lengths(alleles: DataFrame) -> DataFrame:
    return passed(alleles).filter(F.col("cls") == A.MNP).groupBy(F.length("nalt").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def indel_lengths(alleles: DataFrame) -> DataFrame:
    """Per length insertions, deletions and their ratio, and the total as length -1."""
    size = F.abs(F.length("nalt") - F.length("nref"))
    rows = passed(alleles).filter(F.col("cls").isin(A.INS, A.DEL)).withColumn("len", size)
    out = rows.rollup("len").agg(F.count_if(F.col("cls") == A.INS).alias("n_ins"), F.count_if(F.col("cls") == A.DEL).alias("n_del"))
    return out.select(F.coalesce("len", F.lit(-1)).alias("len"), "n_ins", "n_del", ratio(F.col("n_ins"), F.col("n_del")).alias("ins_del"))


def split_mnp_changes(split: DataFrame) -> DataFrame:
    """Base changes of split multi-base alleles; all count as novel."""
    rows = split.select(F.col("ref").alias("nref"), F.col("alt").alias("nalt"), F.lit(A.SNP).alias("cls"), F.lit(2).alias("snp_arity"))
    return rows.agg(*[c for c in change_counts(F.lit(True), F.lit(True))]).select(*[f"novel_{k}" for k in A.CHANGES])


def explode_genotypes(records: DataFrame, samples: Sequence[str], quality: int | None = None) -> DataFrame:
    """Records times samples: sample, zygosity, the allele numbers; genotypes below the quality
    are left out (those without one are not)."""
    rows = records.withColumn("g", F.explode(genotype_list(samples))).withColumn("sample", F.col("g.sample"))
    rows = rows.withColumn("gt", fields.gt(F.col("g.value"))).withColumn("gq", fields.field_of(F.col("g.value"), F.col("format"), "GQ").try_cast("int"))
    if quality is not None:
        rows = rows.filter(F.col("gq").isNull() | (F.col("gq") >= quality))
    return rows.withColumn("zygosity", fields.zygosity(F.col("gt"))).drop("g")


def by_sample(records: DataFrame, samples: Sequence[str], quality: int | None = None) -> DataFrame:
    """Per sample the genotype counts, and by class of the alleles carried the changes (biallelic
    one-base ones), known and novel, het and hom. A genotype is attributed to each allele of its
    record that it carries; records of several alleles are judged allele by allele."""
    keep = ["rsid", "flt", "format", *samples]
    rows = explode_genotypes(explode_alleles(records, keep), samples, quality)
    carries = F.array_contains(fields.gt_alleles(F.col("gt")), (F.col("aid") + 1).cast("string"))
    first = F.col("aid") == 0
    z = F.col("zygosity")
    counts = [F.count_if(first & (z == k)).alias(k) for k in ("unknown", "hom_ref", "het", "hom_alt", "mixed")]
    for state, zyg in (("het", "het"), ("hom", "hom_alt")):
        own = carries & (z == zyg)
        for kind in ("ts", "tv"):
            hit = own & (F.col("snp_arity") == 2) & A.base_change(F.col("nref"), F.col("nalt"), kind)
            counts += [F.count_if(hit & known()).alias(f"known_{state}_{kind}"), F.count_if(hit & ~known()).alias(f"novel_{state}_{kind}")]
        counts += [F.count_if(own & (F.col("cls") == k)).alias(f"{state}_{k}") for k in (A.MNP, A.INS, A.DEL, A.COMPLEX)]
    called = carries & z.isin("het", "hom_alt") & (F.col("snp_arity") == 2)
    for kind in ("deam", "am"):
        hit = called & A.base_change(F.col("nref"), F.col("nalt"), kind)
        counts += [F.count_if(hit & known()).alias(f"known_{kind}"), F.count_if(hit & ~known()).alias(f"novel_{kind}")]
    out = rows.groupBy("sample").agg(*counts)
    ts = sum((F.col(f"{k}_{s}_ts") for k in ("known", "novel") for s in ("het", "hom")), F.lit(0))
    tv = sum((F.col(f"{k}_{s}_tv") for k in ("known", "novel") for s in ("het", "hom")), F.lit(0))
    seen = sum((F.col(f"known_{s}_{k}") for s in ("het", "hom") for k in ("ts", "tv")), F.lit(0))
    deam_am = ratio(F.col("known_deam") + F.col("novel_deam"), F.col("known_am") + F.col("novel_am"))
    return out.select("*", ratio(seen, ts + tv, 100.0).alias("pct_dbsnp"), ratio(ts, tv).alias("tstv"), deam_am.alias("deam_am"))


def spectrum(alleles: DataFrame, key: Column, name: str) -> DataFrame:
    """Known and novel transitions and transversions of passing biallelic one-base alleles by a
    value such as the allele count or frequency."""
    rows = passed(alleles).filter((F.col("snp_arity") == 2) & key.isNotNull())
    out = rows.groupBy(key.alias(name)).agg(*[c for c in change_counts(~known(), F.lit(True))])
    return out.select(name, "known_ts", "known_tv", "novel_ts", "novel_tv", ratio(F.col("known_ts") + F.col("novel_ts"), F.col("known_tv") + F.col("novel_tv")).alias("tstv"))


def frequency(samples: Sequence[str]) -> Column:
    """Share of called alleles that are the allele aid + 1, to two digits; null if none is called."""
    called = F.filter(F.flatten(F.array(*[fields.gt_alleles(fields.gt(F.col(s))) for s in samples])), lambda a: a != ".")
    own = F.filter(called, lambda a: a == (F.col("aid") + 1).cast("string"))
    return F.round(F.size(own) / F.nullif(F.size(called), F.lit(0)), 2)


def detailed(records: DataFrame, samples: Sequence[str], measure: str, quality: int | None = None) -> DataFrame:
    """Per record with one biallelic one-base allele: for each zygosity the number of samples and
    mean, least and most of a genotype field, the change, and the samples that carry it. Samples
    are columns, so nothing is exploded or shuffled."""
    rows = explode_alleles(records, ["format", *samples]).filter(F.col("snp_arity") == 2)

    def of(s: str) -> Column:
        value = fields.field_of(F.col(s), F.col("format"), measure).try_cast("int")
        gq = fields.field_of(F.col(s), F.col("format"), "GQ").try_cast("int")
        ok = F.lit(True) if quality is None else F.coalesce(gq >= quality, F.lit(True))
        return F.struct(F.lit(s).alias("sample"), F.when(ok, fields.zygosity(fields.gt(F.col(s)))).alias("z"), value.alias("v"))

    rows = rows.withColumn("g", F.array(*map(of, samples)))
    out = [F.when(A.base_change(F.col("nref"), F.col("nalt"), "ts"), "ts").when(A.base_change(F.col("nref"), F.col("nalt"), "tv"), "tv").otherwise("?").alias("change")]
    for z in ("hom_ref", "het", "hom_alt"):
        own = F.transform(F.filter("g", _is(z)), lambda x: x["v"])
        found = F.filter(own, lambda v: v.isNotNull())
        mean = F.aggregate(found, F.lit(0).cast("long"), lambda a, v: a + v) / F.nullif(F.size(found), F.lit(0))
        out += [F.size(own).alias(f"n_{z}"), F.round(mean, 6).alias(f"mean_{z}"), F.array_min(found).alias(f"min_{z}"), F.array_max(found).alias(f"max_{z}")]
    out += [F.size(F.filter("g", _is("unknown"))).alias("n_unknown")]
    out += [F.array_join(F.transform(F.filter("g", _is(z)), lambda x: x["sample"]), ",").alias(f"{z}_samples") for z in ("het", "hom_alt")]
    return rows.select("record_id", "chrom", F.col("npos").alias("pos"), *out)


def _is(z: str):
    return lambda x: F.coalesce(x["z"] == z, F.lit(False))


def annotation_counts(alleles: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Per INFO flag transitions, transversions and their ratio; `names` limits the flags."""
    flags = F.transform(F.filter(fields.entries(F.col("info")), lambda x: ~x.contains("=")), lambda x: x)
    rows = alleles.withColumn("flag", F.explode(F.array_distinct(flags)))
    if names is not None:
        rows = rows.filter(F.col("flag").isin(*names))
    hit = lambda k: (F.col("snp_arity") == 2) & A.base_change(F.col("nref"), F.col("nalt"), k)
    out = rows.groupBy("flag").agg(F.count_if(hit("ts")).alias("ts"), F.count_if(hit("tv")).alias("tv"))
    return out.withColumn("tstv", ratio(F.col("ts"), F.col("tv")))


def report(table: DataFrame, width: int = 14) -> str:
    """A fixed-width text of a whole table; see `report_lines` for large ones."""
    return "\n".join(report_lines(table, width)) + "\n"


def report_lines(table: DataFrame, width: int = 14) -> Iterator[str]:
    """The lines of such a text, for printing: all rows, brought to the driver a partition at a time."""
    yield "".join(f"{c:>{width}}" for c in table.columns)
    for r in table.toLocalIterator():
        yield "".join(f"{'' if v is None else f'{v:.4f}' if isinstance(v, float) else v!s:>{width}}" for v in r)
