"""Validation rules: each gives rows (record_id, sample, field, rule, message); together they are
one narrow pass over the records. A missing value (".") breaks no rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import genotype_count, let
from .alleles import exploded

TYPES = {"Integer": r"^[+-]?\d+$", "Float": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|nan|Inf|NaN|INF)$", "Character": r"^.$"}


@dataclass(frozen=True)
class Field:
    """A declared INFO or FORMAT field: number is A, G, R, "." or digits."""

    id: str
    number: str
    type: str


def _fault(ok: Column, sample: Column, name: Column | str, rule: str, message: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(~ok, F.struct(sample.alias("sample"), lit(name).alias("field"), F.lit(rule).alias("rule"), lit(message).alias("message")))


def _typed(values: Column, kind: str) -> Column:
    pattern = TYPES.get(kind)
    return F.lit(True) if pattern is None else F.forall(values, lambda v: (v == ".") | v.rlike(pattern))


def _number(f: Field, values: Column, n_alt: Column, ploidy: Column | None) -> Column:
    missing = (F.size(values) == 1) & (F.get(values, F.lit(0)) == ".")
    if f.number == "A":
        return missing | (F.size(values) == n_alt)
    if f.number == "R":
        return missing | (F.size(values) == n_alt + 1)
    if f.number == "G" and ploidy is not None:
        return missing | (F.size(values) == genotype_count(n_alt, ploidy))
    if f.number.isdigit() and f.number != "0":
        return missing | (F.size(values) == int(f.number))
    return F.lit(True)


def n_alt(alt: Column) -> Column:
    return F.when(alt.isin("", "."), 0).otherwise(F.size(F.split(alt, ",")))


def info_faults(records: DataFrame, declared: Sequence[Field]) -> DataFrame:
    """Undeclared tags, numbers of values and types of INFO."""
    none = F.lit(None).cast("string")
    count = n_alt(F.col("alt"))
    ids = [f.id for f in declared]
    faults = [F.transform(F.filter(fields.tags(F.col("info")), lambda t: ~t.isin(*ids)), lambda t: F.struct(none.alias("sample"), t.alias("field"), F.lit("undeclared").alias("rule"), F.lit("tag is not in the header").alias("message")))]
    for f in declared:
        v = fields.values(F.col("info"), f.id)
        if f.number == "0" or f.type == "Flag":
            checks = [_fault((F.size(v) == 0) & F.lit(f.type == "Flag"), none, f.id, "flag", "a flag has no value and type Flag")]
        else:
            checks = [
                _fault(_number(f, v, count, None), none, f.id, "number", F.concat(F.lit(f"Number={f.number}, values: "), F.size(v).cast("string"))),
                _fault(_typed(v, f.type), none, f.id, "type", f"not of type {f.type}"),
            ]
        faults.append(F.when(v.isNull(), F.array()).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull())))
    return _exploded(records, F.concat(*faults))


def genotype_faults(records: DataFrame, samples: Sequence[str], declared: Sequence[Field]) -> DataFrame:
    """Fields per sample, separators and allele numbers of GT, numbers and types of the others."""
    by_id = {f.id: f for f in declared}
    names = F.split("format", ":")
    count = n_alt(F.col("alt"))
    none = F.lit(None).cast("string")
    unknown = F.transform(F.filter(names, lambda t: ~t.isin("GT", *by_id)), lambda t: F.struct(none.alias("sample"), t.alias("field"), F.lit("undeclared").alias("rule"), F.lit("format is not in the header").alias("message")))
    faults = [unknown]
    for s in samples:
        own, who = F.split(s, ":"), F.lit(s)
        genotype = fields.gt(F.col(s))
        parts = fields.gt_alleles(genotype)
        has_gt = F.get(names, F.lit(0)) == "GT"
        checks = [
            _fault(F.size(own) == F.size(names), who, "FORMAT", "fields", "fields differ from FORMAT"),
            _fault(~has_gt | ~(genotype.contains("/") & genotype.contains("|")), who, "GT", "phase", "both separators"),
            _fault(~has_gt | F.forall(parts, lambda a: (a == ".") | a.rlike(r"^\d+$")), who, "GT", "allele", "not a number"),
            _fault(~has_gt | F.forall(parts, lambda a: F.coalesce(a.try_cast("int") <= count, F.lit(True))), who, "GT", "range", "no such allele"),
        ]
        for f in declared:
            if f.id == "GT":
                continue
            v = let(fields.field_of(F.col(s), F.col("format"), f.id), lambda x: F.split(x, ","))
            checks += [
                _fault(F.coalesce(_number(f, v, count, F.size(parts)), F.lit(True)), who, f.id, "number", f"Number={f.number}"),
                _fault(F.coalesce(_typed(v, f.type), F.lit(True)), who, f.id, "type", f"not of type {f.type}"),
            ]
        faults.append(F.when(F.col(s) == ".", F.array()).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull())))
    return _exploded(records, F.concat(*faults))


def record_faults(records: DataFrame) -> DataFrame:
    """Positions and qualities that are no numbers, from the texts that were read."""
    none = F.lit(None).cast("string")
    checks = [
        _fault(F.col("pos_raw").rlike(TYPES["Integer"]), none, "POS", "type", "not a whole number"),
        _fault((F.col("qual_raw") == ".") | F.col("qual_raw").rlike(TYPES["Float"]), none, "QUAL", "type", "not a number"),
    ]
    return _exploded(records, F.filter(F.array(*checks), lambda x: x.isNotNull()))


def interval_faults(intervals: DataFrame) -> DataFrame:
    return intervals.filter("e < s")


def structural_alleles(alleles: DataFrame) -> DataFrame:
    """Symbolic alleles and breakends, to be looked at; no rule checks them."""
    return alleles.filter(F.col("cls").isin("sv", "rearrangement"))


def header_faults(fields_: DataFrame) -> DataFrame:
    """Declared fields whose Number or Type cannot be read."""
    return fields_.filter("NOT ok")


def _exploded(records: DataFrame, faults: Column) -> DataFrame:
    rows = exploded(records, faults, "f", "record_id", "chrom", "pos")
    return rows.select("record_id", "chrom", "pos", "f.sample", "f.field", "f.rule", "f.message")


def clean(faults: DataFrame) -> bool:
    return faults.isEmpty()
