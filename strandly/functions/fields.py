"""INFO, FILTER and genotype fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def entries(info: Column) -> Column:
    """Entries of INFO: none for "." or ""."""
    return F.when(info.isNull() | info.isin(".", ""), F.array().cast("array<string>")).otherwise(F.filter(F.split(info, ";"), lambda x: x != ""))


def tag(entry: Column) -> Column:
    return F.split(entry, "=", 2)[0]


def tags(info: Column) -> Column:
    return F.transform(entries(info), tag)


def joined(found: Column, mark: str = ";") -> Column:
    """The list as a field, "." if empty."""
    return F.when(F.size(found) == 0, ".").otherwise(F.array_join(found, mark))


def values(info: Column, name: str) -> Column:
    """Values of a tag (the last if it repeats); null without it, empty for a flag."""
    own = F.filter(entries(info), lambda x: tag(x) == name)
    last = F.get(own, F.size(own) - 1)
    return F.when(F.size(own) == 0, F.lit(None)).when(last.contains("="), F.split(F.split(last, "=", 2)[1], ",")).otherwise(F.array().cast("array<string>"))


def has_any(info: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(tags(info), F.array(*map(F.lit, names)))


def without(info: Column, names: Sequence[str]) -> Column:
    return joined(F.filter(entries(info), lambda x: ~tag(x).isin(*names)))


def with_entry(info: Column, entry: Column) -> Column:
    """INFO with one more entry; it replaces "." """
    return F.when(info.isNull() | info.isin(".", ""), entry).otherwise(F.concat_ws(";", info, entry))


def keep_alleles(info: Column, keep: Column, per_allele: Sequence[str], with_reference: Sequence[str] = ()) -> Column:
    """INFO after alleles were removed: tags with a value for each allele (Number=A) keep those of
    the alleles with true in `keep`, tags that begin with the reference (Number=R) that one as
    well; all others, and the order, stay."""

    def rewrite(x: Column) -> Column:
        name, own = tag(x), F.split(x, "=", 2)[1]
        out = F.when(name.isin(*per_allele) & x.contains("="), F.concat(name, F.lit("="), kept_values(own, keep, "A")))
        if with_reference:
            out = out.when(name.isin(*with_reference) & x.contains("="), F.concat(name, F.lit("="), kept_values(own, keep, "R")))
        return out.otherwise(x)

    return joined(F.transform(entries(info), rewrite))


def kept_values(value: Column, keep: Column, number: str) -> Column:
    """A list of values, one for each allele (A) or the reference and each allele (R), without
    those of removed alleles; "." stays."""
    at = 0 if number == "A" else 1
    own = F.filter(F.split(value, ","), lambda _, i: (i < at) | F.coalesce(F.get(keep, i - at), F.lit(False)))
    return F.when(value == ".", value).otherwise(joined(own, ","))


def filters(flt: Column) -> Column:
    """Names in FILTER, without "." """
    return F.filter(F.split(F.coalesce(flt, F.lit(".")), ";"), lambda x: ~x.isin(".", ""))


def gt(sample: Column) -> Column:
    """The genotype of a sample column whose first field is GT."""
    return F.split(sample, ":", 2)[0]


def gt_alleles(genotype: Column) -> Column:
    """Alleles as texts, "." for missing ones."""
    return F.split(F.translate(genotype, "|", "/"), "/")


def phased(genotype: Column) -> Column:
    return genotype.contains("|")


def zygosity(genotype: Column) -> Column:
    """"unknown" (any allele missing), "hom_ref", "hom_alt", "het" (one reference allele), "mixed"
    (two different alternates); one allele alone counts as homozygous."""

    def of(a: Column) -> Column:
        first, distinct = F.get(a, F.lit(0)), F.size(F.array_distinct(a))
        return (
            F.when(F.array_contains(a, "."), "unknown")
            .when((distinct == 1) & (first == "0"), "hom_ref")
            .when(distinct == 1, "hom_alt")
            .when(F.array_contains(a, "0"), "het")
            .otherwise("mixed")
        )

    return let(gt_alleles(genotype), of)


def numbers(keep: Column) -> Column:
    """Of each allele its number, as text, after those with false in `keep` were removed; "." for these."""
    return F.transform(keep, lambda k, i: F.when(k, F.size(F.filter(F.slice(keep, 1, i + 1), lambda x: x)).cast("string")).otherwise("."))


def renumbered(genotype: Column, keep: Column) -> Column:
    """The genotype after alleles were removed: survivors are numbered anew, removed ones become
    "."; reference, missing alleles and the separators stay."""
    return with_numbers(genotype, numbers(keep))


def with_numbers(genotype: Column, new: Column) -> Column:
    """The genotype with the numbers of `new` (see `numbers`) for its alleles."""

    def one(x: Column) -> Column:
        at = x.try_cast("int")
        return F.when(at.isNull() | (at == 0), x).otherwise(F.coalesce(F.get(new, at - 1), F.lit(".")))

    plain = lambda mark, pattern: F.array_join(F.transform(F.split(genotype, pattern), one), mark)
    mixed = F.array_join(F.transform(F.split(genotype, r"(?<=[/|])|(?=[/|])"), one), "")
    return F.when(~genotype.contains("|"), plain("/", "/")).when(~genotype.contains("/"), plain("|", r"\|")).otherwise(mixed)


def sample_kept(sample: Column, format_: Column, new: Column, keep: Column, numbers_: Mapping[str, str]) -> Column:
    """A sample after alleles were removed: GT, the first field, is numbered anew; of the fields in
    `numbers_` those with a value for each allele (A, R) keep those of the alleles that stay, and
    those with one for each genotype (G) become "."."""
    if not numbers_:
        return F.concat_ws(":", with_numbers(gt(sample), new), F.get(F.split(sample, ":", 2), F.lit(1)))
    of = lambda number: [k for k, n in numbers_.items() if n == number]
    names = F.split(format_, ":")

    def one(value: Column, i: Column) -> Column:
        name = F.get(names, i)
        out = F.when(name == "GT", with_numbers(value, new))
        for number in ("A", "R"):
            if of(number):
                out = out.when(name.isin(*of(number)), kept_values(value, keep, number))
        if of("G"):
            out = out.when(name.isin(*of("G")), F.lit("."))
        return out.otherwise(value)

    return F.array_join(F.transform(F.split(sample, ":"), one), ":")


def field_of(sample: Column, format_: Column, name: str) -> Column:
    """A named field of a sample; null if FORMAT lacks it or the sample ends before it."""
    at = F.array_position(F.split(format_, ":"), name)
    return F.when(at > 0, F.get(F.split(sample, ":"), (at - 1).cast("int")))
