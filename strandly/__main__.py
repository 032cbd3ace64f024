"""Command line: python -m strandly TOOL ... ; one tool for each kind of run."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alleles as A
from .functions import fields
from .operators import alleles as O
from .operators import distributions, filters, joins, stats, validate
from .operators import intervals as I
from .sources import bed, samples, vcf

VERSION = "0.1"
CLASS_FLAGS = {"1": ("snp", (A.SNP,)), "2": ("mnp", (A.MNP,)), "3": ("indel", (A.INS, A.DEL)), "4": ("complex", (A.COMPLEX,)), "5": ("sv", (A.SV,)), "6": ("rearrangement", (A.BND,))}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("strandly", description="Tools for call sets, intervals and their statistics.")
    top.add_argument("--version", "-v", action="version", version=VERSION)
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, text: str, inputs: bool = True, out: bool = True, classes: bool = True) -> argparse.ArgumentParser:
        p = tools.add_parser(name, help=text, description=text)
        if inputs:
            p.add_argument("-i", "--in", dest="input", action="append", required=True, help="a call set")
        if out:
            p.add_argument("-o", "--out", help="a folder for the result; printed without it")
        if classes:
            for k, (n, _) in CLASS_FLAGS.items():
                p.add_argument(f"-{k}", f"--{n}", dest=f"cls_{n}", action="store_true", help=f"only {n} alleles")
        return p

    p = tool("annotate", "add what other files say about the same alleles")
    p.add_argument("-a", "--annotation", help="a call set whose FILTER is added")
    p.add_argument("-d", "--dbsnp", help="a call set whose ids are taken")
    p.add_argument("-b", "--bed", help="intervals whose names are added")
    p.add_argument("-s", "--sites-only", action="store_true")
    p.add_argument("-w", "--wholly-within", action="store_true")
    p = tool("filter", "rewrite FILTER, drop records, alleles, tags or genotypes")
    p.add_argument("-q", "--quality", type=float)
    p.add_argument("-m", "--mark-as-pass", action="store_true")
    p.add_argument("-l", "--pass-only", action="store_true")
    p.add_argument("-r", "--remove-genotypes", action="store_true")
    p.add_argument("-c", "--clear-dbsnp", action="store_true")
    p.add_argument("-e", "--find-hets", action="store_true")
    p.add_argument("-p", "--split-mnps", action="store_true")
    p.add_argument("-d", "--delete-info", default="", help="INFO tags, comma separated")
    p.add_argument("-k", "--keep-records", default="", help="keep records with one of these tags")
    p.add_argument("-t", "--strip-records", default="", help="drop records with one of these tags")
    p.add_argument("-s", "--samples", help="a file of samples; records that none carries are dropped")
    p = tool("intersect", "what two call sets, or a call set and intervals, share")
    p.add_argument("-b", "--bed")
    how = p.add_mutually_exclusive_group(required=True)
    for k, n in (("-c", "--common"), ("-u", "--union"), ("-q", "--unique")):
        how.add_argument(k, n, choices=("a", "b", "q"), help="the file whose records are written; q: the one of higher quality")
    p.add_argument("-s", "--sites-only", action="store_true")
    p.add_argument("-m", "--mismatch", action="store_true", help="as --sites-only")
    p.add_argument("-p", "--pass-only", action="store_true")
    p.add_argument("-w", "--wholly-within", action="store_true")
    p.add_argument("-d", "--distance", action="store_true", help="distances to the nearest interval")
    tool("merge", "all records of several call sets", classes=False).add_argument("--sort", action="store_true")
    p = tool("stats", "tables of changes, lengths and samples")
    p.add_argument("-s", "--samples", type=int, metavar="QUALITY")
    p.add_argument("-d", "--detailed", type=int, metavar="QUALITY")
    p.add_argument("-a", "--allele-counts", action="store_true")
    p.add_argument("-n", "--annotations", help="INFO flags, comma separated, or all")
    p.add_argument("-p", "--split-mnps", action="store_true")
    tool("validate", "hold records against the header", classes=False)
    p = tool("distributions", "means and histograms of INFO values", classes=False)
    p.add_argument("-p", "--primary")
    p.add_argument("-s", "--secondary", default="")
    p.add_argument("-d", "--distributions", default="")
    return top


def _list(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def _show(tables: dict[str, DataFrame], out: str | None) -> None:
    for name, table in tables.items():
        if out:
            table.write.mode("overwrite").parquet(f"{out}/{name}")
        else:
            print(f"# {name}")
            for line in stats.report_lines(table):
                print(line)
            print()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if args[:1] == ["help"]:
        args = [*args[1:2], "--help"]
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("strandly").getOrCreate()
    records, header = vcf.read(spark, o.input[0])
    wanted = [c for n, cs in CLASS_FLAGS.values() if getattr(o, f"cls_{n}", False) for c in cs]
    per_allele = {f.id: f.number for f in header.declared("INFO")}
    formats = {f.id: f.number for f in header.declared("FORMAT")}

    def chosen(rows: DataFrame) -> DataFrame:
        if wanted == [A.SNP]:  # one-base changes alone are written at their own place
            return O.reanchor(rows, wanted, per_allele, header.samples, formats)
        return O.select_classes(rows, wanted, per_allele, header.samples, formats) if wanted else rows

    def done(rows: DataFrame, task: str) -> None:
        if o.out:
            vcf.write(rows, header, o.out, task)
        else:
            genotypes = "format" in rows.columns
            print("\n".join(header.lines(genotypes, task)))
            for r in vcf.lines(rows, header.samples if genotypes else []).orderBy("record_id").toLocalIterator():
                print(r["value"])

    if o.tool == "filter":
        rows = filters.filter_records(
            chosen(records), o.quality, o.mark_as_pass, o.pass_only, o.remove_genotypes, _list(o.delete_info), _list(o.strip_records), _list(o.keep_records), o.clear_dbsnp, header.samples
        )
        if o.find_hets and not o.remove_genotypes:
            rows = filters.find_hets(rows, header.samples)
            header.add("INFO", "HET", ".", "String", "Samples that are heterozygous")
        if o.samples:
            rows = filters.sample_subset(rows, header.samples, samples.read(spark, o.samples, header.samples))
        if o.quality is not None:
            header.add("FILTER", f"Q{o.quality:g}", description=f"Quality below {o.quality:g}")
        if o.split_mnps:
            header.add("INFO", "FROM_MNP", "0", "Flag", "Split from a multi-base substitution")
            rows = O.split_mnp_records(rows, per_allele, header.samples if "format" in rows.columns else [], formats)
        done(rows, "filter")
    elif o.tool == "merge":
        others = [vcf.read(spark, p, i) for i, p in enumerate(o.input[1:], 1)]
        for _, h in others:
            samples.same(header.samples, h.samples)
        rows = joins.merge([records, *[r for r, _ in others]], o.sort)
        done(rows, "merge " + ", ".join(o.input))
    elif o.tool == "annotate":
        rows = chosen(records)
        if o.dbsnp:
            rows = joins.annotate_dbsnp(rows, vcf.read(spark, o.dbsnp)[0], o.sites_only)
            header.add("INFO", "dbSNP", "0", "Flag", "Membership in the given set of known alleles")
        if o.annotation:
            rows = joins.annotate_filter(rows, vcf.read(spark, o.annotation)[0], o.sites_only)
        if o.bed:
            rows = I.annotate_intervals(rows, O.explode_alleles(rows), bed.read(spark, o.bed), o.wholly_within)
        done(rows, "annotate")
    elif o.tool == "intersect":
        side = o.common or o.union or o.unique
        if (len(o.input) == 2) == bool(o.bed):
            raise SystemExit("intersect takes two call sets, or one call set and intervals")
        if o.pass_only:
            records = records.filter(F.array_contains(fields.filters(F.col("flt")), "PASS"))
        a = O.explode_alleles(records, ["qual"])
        if o.bed:
            ivs = bed.read(spark, o.bed)
            if o.distance:
                _show({"distances": I.distance_histogram(records.select("chrom", "pos"), ivs), "targets": I.target_stats(ivs)}, o.out)
                return 0
            hit = I.outside(a, ivs, o.wholly_within) if o.unique else I.interval_join(a, ivs, o.wholly_within)
            base = records
        else:
            other = vcf.read(spark, o.input[1])[0]
            if o.pass_only:
                other = other.filter(F.array_contains(fields.filters(F.col("flt")), "PASS"))
            b, sites = O.explode_alleles(other, ["qual"]), o.sites_only or o.mismatch
            if side == "q":
                best = joins.best_quality(a, b, ["qual", "aid"])
                both = [(records, best.filter("source = 0")), (other, best.filter("source = 1"))]
                done(_keep(both[0][0], both[0][1], per_allele, header.samples, formats).unionByName(_keep(both[1][0], both[1][1], per_allele, header.samples, formats), True), "intersect")
                return 0
            if side == "b":
                a, b, records, other = b, a, other, records
            base = records
            if o.union:
                every = joins.union(a, b, sites)
                done(_keep(records, every.filter("source = 0"), per_allele, header.samples, formats).unionByName(_keep(other, every.filter("source = 1"), per_allele, header.samples, formats), True), "intersect")
                return 0
            hit = (joins.unique if o.unique else joins.common)(a, b, sites)
        done(_keep(base, hit.filter(F.col("cls").isin(wanted)) if wanted else hit, per_allele, header.samples, formats), f"intersect {', '.join(o.input)}")
    elif o.tool == "stats":
        rows = O.explode_alleles(records, ["rsid", "flt", "info", *header.samples])
        tables = {"filters": stats.by_filter(rows), "mnp_lengths": stats.mnp_lengths(rows), "indel_lengths": stats.indel_lengths(rows)}
        if o.split_mnps:
            tables["mnp_changes"] = stats.split_mnp_changes(O.split_mnps(records))
        if o.allele_counts:
            tables["allele_counts"] = stats.spectrum(rows, F.get(fields.values(F.col("info"), "AC"), F.col("aid")).try_cast("int"), "ac")
        if o.samples is not None:
            tables["samples"] = stats.by_sample(records, header.samples, o.samples)
        if o.detailed is not None:
            tables["detailed"] = stats.detailed(records, header.samples, "DP", o.detailed)
        if o.annotations:
            tables["annotations"] = stats.annotation_counts(rows, None if o.annotations == "all" else _list(o.annotations))
        _show(tables, o.out)
    elif o.tool == "validate":
        if not (bad := validate.header_faults(header.frame(spark))).isEmpty():
            _show({"header": bad}, o.out)
            return 1
        faults = validate.record_faults(records).unionByName(validate.info_faults(records, header.declared("INFO")))
        if header.samples:
            faults = faults.unionByName(validate.genotype_faults(records, header.samples, header.declared("FORMAT")))
        if validate.clean(faults):
            print("No errors found")
            return 0
        _show({"faults": faults}, o.out)
        return 1
    elif o.tool == "distributions":
        tables = {}
        if o.primary:
            tables["primary"] = distributions.primary(records, o.primary, _list(o.secondary))
        if o.distributions:
            tables["histogram"] = distributions.histogram(records, _list(o.distributions))
        _show(tables, o.out)
    return 0


def _keep(records: DataFrame, hit: DataFrame, per_allele: dict[str, str], names: list[str], formats: dict[str, str]) -> DataFrame:
    """Records with only the alleles of `hit`; those without one are dropped."""
    flags = hit.groupBy("record_id").agg(F.collect_set("aid").alias("__aids"))
    rows = O.with_alleles(records).join(flags, "record_id")
    rows = rows.withColumn("__keep", F.transform("alleles", lambda x: F.array_contains(F.col("__aids"), x["aid"])))
    return O.rebuild(rows, per_allele, names, formats).select(records.columns)


if __name__ == "__main__":
    sys.exit(main())
