"""Allele algebra: trimming, classes, base changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SNP, MNP, INS, DEL, COMPLEX, SV, BND = "snp", "mnp", "ins", "del", "complex", "sv", "rearrangement"
CLASSES = (SNP, MNP, INS, DEL, COMPLEX, SV, BND)


def _most(upto: Column, same) -> Column:
    return F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(upto, F.lit(0))), same))


def trim(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(npos, nref, nalt): the common suffix goes, then the common prefix; one base stays in
    each, and the position moves by the prefix."""

    def front(x: Column) -> Column:
        r, a = x["r"], x["a"]
        n = _most(F.least(F.length(r), F.length(a)) - 1, lambda k: F.left(r, k) == F.left(a, k))
        return let(n, lambda p: F.struct((pos + p).cast("int").alias("npos"), F.substring(r, p + 1, F.length(r)).alias("nref"), F.substring(a, p + 1, F.length(a)).alias("nalt")))

    def back(k: Column) -> Column:
        return F.struct(F.left(ref, F.length(ref) - k).alias("r"), F.left(alt, F.length(alt) - k).alias("a"))

    tail = _most(F.least(F.length(ref), F.length(alt)) - 1, lambda k: F.right(ref, k) == F.right(alt, k))
    return let(let(tail, back), front)


def untrimmed(pos: Column, ref: Column, alt: Column) -> Column:
    return F.struct(pos.cast("int").alias("npos"), ref.alias("nref"), alt.alias("nalt"))


def structural(alt: Column) -> Column:
    return alt.startswith("<") | alt.contains("[") | alt.contains("]")


def allele_class(alt: Column, nref: Column, nalt: Column) -> Column:
    """The class of an allele from its text and its trimmed form."""
    r, a = F.length(nref), F.length(nalt)
    same_first = F.left(nref, F.lit(1)) == F.left(nalt, F.lit(1))
    return (
        F.when(alt.startswith("<"), SV)
        .when(alt.contains("[") | alt.contains("]"), BND)
        .when((r == 1) & (a == 1), SNP)
        .when(r == a, MNP)
        .when((r == 1) & same_first, INS)
        .when((a == 1) & same_first, DEL)
        .otherwise(COMPLEX)
    )


def alleles(pos: Column, ref: Column, alt: Column) -> Column:
    """array<struct(aid, alt, npos, nref, nalt, cls)> of a record, in the order of ALT. An empty
    or missing (".") ALT has no alleles."""

    def one(a: Column, i: Column) -> Column:
        short = (F.length(ref) == 1) & (F.length(a) == 1) | structural(a)
        form = F.when(short, untrimmed(pos, ref, a)).otherwise(trim(pos, ref, a))
        return let(form, lambda f: F.struct(i.alias("aid"), a.alias("alt"), f["npos"].alias("npos"), f["nref"].alias("nref"), f["nalt"].alias("nalt"), allele_class(a, f["nref"], f["nalt"]).alias("cls")))

    return F.when(alt.isNull() | alt.isin("", "."), F.array()).otherwise(F.transform(F.split(alt, ","), one))


def base_change(ref: Column, alt: Column, kind: str) -> Column:
    """Whether a one-base change is a transition ("ts"), transversion ("tv"), deamination ("deam")
    or amination ("am"); letters other than ACGT are none."""
    pair = F.concat(F.upper(ref), F.upper(alt))
    return pair.isin(*CHANGES[kind])


CHANGES = {
    "ts": ("AG", "GA", "CT", "TC"),
    "tv": ("AC", "CA", "AT", "TA", "CG", "GC", "GT", "TG"),
    "deam": ("CT", "GA"),
    "am": ("TC", "AG"),
}
