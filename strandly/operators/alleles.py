"""From records to alleles and back."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import fields

KEY = ["chrom", "npos", "cls", "nref", "nalt"]
SITE = ["chrom", "npos", "cls"]


def with_alleles(records: DataFrame) -> DataFrame:
    """Records with the array `alleles`, in one narrow step that filters on it do not repeat."""
    return once(records, "alleles", A.alleles(F.col("pos"), F.col("ref"), F.col("alt")))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with a column that is computed once a row: the optimizer pushes filters below a
    projection and repeats its expressions there, but not below a generator."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def exploded(rows: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """The columns `keep` and one row per element of an array without null elements.

    An inner explode lets the optimizer infer a filter on the array's size and push it below the
    projection, which then computes the whole array twice; an outer one with a filter does not."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def explode_alleles(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per allele: record_id, chrom, the columns `keep`, and aid, alt, npos, nref, nalt,
    cls, snp_arity, multi_first.

    snp_arity is one more than the one-base changes of the record (null for other classes), so a
    record with two of them is triallelic, whatever else it holds. multi_first marks the first
    such allele of a record with several. No shuffle: a record's alleles are counted in the row."""
    snps = F.filter("alleles", lambda x: x["cls"] == A.SNP)
    rows = with_alleles(records).withColumn("__n", F.size(snps)).withColumn("__first", F.get(snps, F.lit(0))["aid"])
    rows = exploded(rows, "alleles", "a", "record_id", "chrom", *keep, "__n", "__first")
    snp = F.col("a.cls") == A.SNP
    return rows.select(
        "record_id",
        "chrom",
        *keep,
        "a.aid",
        F.col("a.alt").alias("allele"),
        "a.npos",
        "a.nref",
        "a.nalt",
        "a.cls",
        F.when(snp, F.col("__n") + 1).alias("snp_arity"),
        (snp & (F.col("__n") > 1) & (F.col("a.aid") == F.col("__first"))).alias("multi_first"),
    )


def class_filter(classes: Iterable[str]) -> Column:
    """Which alleles of the array stay; no classes mean all."""
    wanted = list(classes) or list(A.CLASSES)
    return F.transform("alleles", lambda x: x["cls"].isin(*wanted))


def select_classes(records: DataFrame, classes: Iterable[str], per_allele: Sequence[str] = (), genotypes: Sequence[str] = (), formats: Mapping[str, str] | None = None) -> DataFrame:
    """Records without alleles of other classes; records that lose all are dropped. ALT, INFO tags
    with a value for each allele, and the genotype columns named follow."""
    rows = with_alleles(records).withColumn("__keep", class_filter(classes)).filter(F.exists("__keep", lambda k: k))
    return rebuild(rows, per_allele, genotypes, formats).select(records.columns)


def rebuild(rows: DataFrame, per_allele: Sequence[str] | Mapping[str, str], genotypes: Sequence[str], formats: Mapping[str, str] | None = None) -> DataFrame:
    """ALT, INFO and genotypes of rows with `alleles` and the flags `__keep`; without a removed
    allele they come back byte by byte.

    `per_allele` names INFO tags with a value for each allele (Number=A), or gives the Number of
    tags; `formats` gives the Number of FORMAT fields: those of A and R lose the values of removed
    alleles, those of G become "."; GT is numbered anew, other fields stay."""
    numbers = dict(per_allele) if isinstance(per_allele, Mapping) else dict.fromkeys(per_allele, "A")
    of = lambda number, given: [k for k, n in given.items() if n == number]
    rows = rows.withColumns({"__all": F.forall("__keep", lambda k: k), "__new": fields.numbers(F.col("__keep"))})
    all_kept = F.col("__all")
    kept = F.filter("alleles", lambda x, i: F.get(F.col("__keep"), i))
    rows = rows.withColumn("alt", F.when(all_kept, F.col("alt")).otherwise(fields.joined(F.transform(kept, lambda x: x["alt"]), ",")))
    rows = rows.withColumn("info", F.when(all_kept, F.col("info")).otherwise(fields.keep_alleles(F.col("info"), F.col("__keep"), of("A", numbers), of("R", numbers))))
    if genotypes:
        formats = {k: n for k, n in (formats or {}).items() if n in ("A", "R", "G") and k != "GT"}
        new = {c: fields.sample_kept(F.col(c), F.col("format"), F.col("__new"), F.col("__keep"), formats) for c in genotypes}
        rows = rows.withColumns({c: F.when(all_kept | (F.col(c) == "."), F.col(c)).otherwise(x) for c, x in new.items()})
    return rows.drop("__all", "__new")


def reanchor(records: DataFrame, classes: Iterable[str] = (A.SNP,), per_allele: Sequence[str] | Mapping[str, str] = (), genotypes: Sequence[str] = (), formats: Mapping[str, str] | None = None) -> DataFrame:
    """Records of the kept alleles in trimmed form, one for each distinct (position, reference) of
    a record; INFO and genotypes follow as in `rebuild`."""
    wanted = list(classes)
    own = F.filter("alleles", lambda x: x["cls"].isin(*wanted))
    rows = with_alleles(records).withColumn("__sites", F.array_distinct(F.transform(own, lambda x: F.struct(x["npos"].alias("npos"), x["nref"].alias("nref")))))
    rows = exploded(rows, "__sites", "__s", *records.columns, "alleles")
    here = lambda x: x["cls"].isin(*wanted) & (x["npos"] == F.col("__s.npos")) & (x["nref"] == F.col("__s.nref"))
    rows = rebuild(rows.withColumn("__keep", F.transform("alleles", here)), per_allele, genotypes, formats)
    alts = F.array_join(F.transform(F.filter("alleles", here), lambda x: x["nalt"]), ",")
    return rows.withColumns({"pos": F.col("__s.npos"), "ref": F.col("__s.nref"), "alt": alts}).select(records.columns)


def _differing(ref: Column, alt: Column) -> Column:
    """Places, from 1, at which two texts of one length differ."""
    return F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.substring(ref, i, F.lit(1)) != F.substring(alt, i, F.lit(1)))


def split_mnps(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per differing base of each multi-base substitution: record_id, chrom, aid, pos, ref,
    alt, info with the flag FROM_MNP."""
    rows = explode_alleles(records, [*keep, "info"]).filter(F.col("cls") == A.MNP)
    rows = exploded(rows, _differing(F.col("nref"), F.col("nalt")), "i", *rows.columns)
    return rows.select(
        "record_id",
        "chrom",
        *keep,
        "aid",
        (F.col("npos") + F.col("i") - 1).cast("int").alias("pos"),
        F.substring("nref", F.col("i"), F.lit(1)).alias("ref"),
        F.substring("nalt", F.col("i"), F.lit(1)).alias("alt"),
        fields.with_entry(F.col("info"), F.lit("FROM_MNP")).alias("info"),
    )


def split_mnp_records(records: DataFrame, per_allele: Sequence[str] | Mapping[str, str] = (), genotypes: Sequence[str] = (), formats: Mapping[str, str] | None = None) -> DataFrame:
    """Records whose multi-base substitutions are split: each differing base of such an allele is a
    record of its own, flagged FROM_MNP, with that allele's INFO and genotype values; the other
    alleles stay together in a record without it. Records without such alleles are unchanged."""
    mnp = lambda x: x["cls"] == A.MNP
    whole = F.struct(F.lit(-1).alias("aid"), F.transform("alleles", lambda x: ~mnp(x)).alias("keep"))
    single = lambda a: F.struct(a["aid"].alias("aid"), F.transform("alleles", lambda x: x["aid"] == a["aid"]).alias("keep"))
    rest = F.when(F.exists("alleles", lambda x: ~mnp(x)) | (F.size("alleles") == 0), F.array(whole)).otherwise(F.slice(F.array(whole), 1, 0))
    rows = with_alleles(records).withColumn("__parts", F.concat(rest, F.transform(F.filter("alleles", mnp), single)))
    rows = exploded(rows, "__parts", "__p", *records.columns, "alleles").withColumn("__keep", F.col("__p.keep"))
    rows = rebuild(rows, per_allele, genotypes, formats)
    a = F.get("alleles", F.col("__p.aid"))
    base = lambda i: F.struct((a["npos"] + i - 1).cast("int").alias("pos"), F.substring(a["nref"], i, F.lit(1)).alias("ref"), F.substring(a["nalt"], i, F.lit(1)).alias("alt"))
    same = F.array(F.struct(F.col("pos").cast("int").alias("pos"), "ref", "alt"))
    split = F.col("__p.aid") >= 0
    rows = exploded(rows, F.when(split, F.transform(_differing(a["nref"], a["nalt"]), base)).otherwise(same), "__b", *records.columns, split.alias("__split"))
    info = F.when(F.col("__split"), fields.with_entry(F.col("info"), F.lit("FROM_MNP"))).otherwise(F.col("info"))
    return rows.withColumns({"pos": F.col("__b.pos"), "ref": F.col("__b.ref"), "alt": F.col("__b.alt"), "info": info}).select(records.columns)
