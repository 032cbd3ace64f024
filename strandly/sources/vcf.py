"""Call set text files: header, records, and writing them again."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leading_double, leading_int
from ..operators.validate import Field

COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
KINDS = ("INFO", "FILTER", "FORMAT", "ALT")
NUMBER = re.compile(r"^([AGR.]|\d+)$")
TYPES = ("Integer", "Float", "Flag", "Character", "String")


class HeaderError(ValueError):
    """A header that records cannot be read by."""


@dataclass
class Header:
    """Declared fields by kind and id (the last definition of an id wins), all other meta lines in
    their order, and the samples."""

    fields: dict[str, dict[str, dict[str, str]]] = field(default_factory=lambda: {k: {} for k in KINDS})
    other: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> Header:
        out, titled = cls(), False
        for line in lines:
            if m := re.match(r"##(INFO|FILTER|FORMAT|ALT)=<(.*?)>\s*$", line):
                got = {k: v[1:-1] if v.startswith('"') else v for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2])}
                got["raw"] = line
                out.fields[m[1]].pop(got.get("ID", ""), None)
                out.fields[m[1]][got.get("ID", "")] = got
            elif line.startswith("##"):
                out.other.append(line)
            elif line.startswith("#"):
                titles = line[1:].split("\t")
                if len(titles) < len(COLUMNS):
                    raise HeaderError(f"the title line has {len(titles)} columns, {len(COLUMNS)} are needed")
                out.samples = titles[9:]
                titled = True
        if not titled:
            raise HeaderError("there is no title line")
        return out

    def declared(self, kind: str) -> list[Field]:
        return [Field(i, f.get("Number", "."), f.get("Type", "String")) for i, f in self.fields[kind].items()]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(kind, id, number, type, description, ok, raw); ok is whether number and type can be read."""
        rows = [
            (k, i, f.get("Number"), f.get("Type"), f.get("Description"), k in ("FILTER", "ALT") or bool(NUMBER.match(f.get("Number", ""))) and f.get("Type") in TYPES, f["raw"])
            for k in KINDS
            for i, f in self.fields[k].items()
        ]
        return spark.createDataFrame(rows, "kind string, id string, number string, type string, description string, ok boolean, raw string")

    def add(self, kind: str, name: str, number: str = "", type_: str = "", description: str = "") -> None:
        parts = [f"ID={name}", *([f"Number={number}", f"Type={type_}"] if kind in ("INFO", "FORMAT") else []), f'Description="{description}"']
        self.fields[kind].setdefault(name, {"ID": name, "Number": number, "Type": type_, "Description": description, "raw": f"##{kind}=<{','.join(parts)}>"})

    def lines(self, genotypes: bool = True, task: str = "") -> list[str]:
        """Other lines, the task, then INFO, FILTER, FORMAT and ALT by id, and the titles."""
        first = [x for x in self.other if x.startswith("##fileformat")]
        out = first + [x for x in self.other if x not in first] + ([f"##task={task}"] if task else [])
        for k in KINDS:
            if genotypes or k != "FORMAT":
                out += [self.fields[k][i]["raw"] for i in sorted(self.fields[k])]
        titles = [*COLUMNS, *(["FORMAT", *self.samples] if genotypes and self.samples else [])]
        return [*out, "#" + "\t".join(titles)]


def read_header(spark: SparkSession, path: str) -> Header:
    """Meta lines of a file. They are few and reach the driver; records do not.

    They are read from the beginning, up to the title line. Only where a record comes before it,
    as in folders whose first part is not read first, all lines are looked through."""
    text = spark.read.text(path)
    for n in (1_000, 100_000):
        found = [r["value"].rstrip("\r") for r in text.head(n)]
        meta = list(takewhile(lambda x: x.startswith("#"), found))
        if any(not x.startswith("##") for x in meta):
            return Header.parse(meta)
        if len(meta) < len(found) or len(found) < n:
            break
    return Header.parse([r["value"].rstrip("\r") for r in text.filter(F.col("value").startswith("#")).collect()])


def parse(lines: DataFrame, header: Header, file_idx: int = 0, numbered: bool = True) -> DataFrame:
    """Records of a DataFrame of lines (value), samples as columns by name.

    A position that is no whole number is 0 and a quality that is none is null; both texts are
    kept as pos_raw and qual_raw for the validation rules. record_id follows the order of the
    scan: splits of a file in order, lines in order; without `numbered` there is none (streams)."""
    own = (lines.withColumn("record_id", F.monotonically_increasing_id()) if numbered else lines).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    n = len(COLUMNS) + 1 + len(header.samples)
    own = own.withColumn("p", F.split(F.rtrim(F.col("value"), F.lit("\r\n")), "\t", n if header.samples else -1))
    at = lambda i: F.get("p", F.lit(i))
    qual = F.when(at(5) == ".", None).otherwise(leading_double(at(5)))
    cols = [
        *(["record_id"] if numbered else []),
        at(0).alias("chrom"),
        leading_int(at(1)).cast("int").alias("pos"),
        at(2).alias("rsid"),
        at(3).alias("ref"),
        at(4).alias("alt"),
        qual.alias("qual"),
        at(5).alias("qual_raw"),
        at(1).alias("pos_raw"),
        at(6).alias("flt"),
        at(7).alias("info"),
        F.lit(file_idx).alias("file_idx"),
    ]
    if header.samples:
        cols += [at(8).alias("format"), *[F.coalesce(at(9 + i), F.lit(".")).alias(s) for i, s in enumerate(header.samples)]]
    return own.select(*cols)


def read(spark: SparkSession, path: str, file_idx: int = 0) -> tuple[DataFrame, Header]:
    header = read_header(spark, path)
    return parse(spark.read.text(path), header, file_idx), header


def lines(records: DataFrame, samples: list[str]) -> DataFrame:
    """Records as text lines; the quality's text is the one read where there is one."""
    from ..operators.filters import quality_text

    rows = quality_text(records)
    parts = ["chrom", F.col("pos").cast("string"), "rsid", "ref", "alt", "qual_raw", "flt", "info"]
    if samples and "format" in records.columns:
        parts += ["format", *samples]
    return rows.select("chrom", "pos", "record_id", F.concat_ws("\t", *[F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(".")) for x in parts]).alias("value"))


def write(records: DataFrame, header: Header, path: str, task: str = "", ordered: bool = True, single: bool = False) -> None:
    """A folder of part files: the header in the first, then records by contig of first appearance
    and position. `single` brings all records into one file, for small results."""
    spark = records.sparkSession
    genotypes = "format" in records.columns
    own = lines(records, header.samples if genotypes else [])
    if ordered:
        first = own.groupBy("chrom").agg(F.min("record_id").alias("first"))
        own = own.join(F.broadcast(first), "chrom")
    else:
        own = own.withColumn("first", F.lit(0).cast("long"))
    head = spark.createDataFrame([("", i - 1_000_000, 0, x, -1) for i, x in enumerate(header.lines(genotypes, task))], "chrom string, pos int, record_id long, value string, first long")
    both = head.unionByName(own.select(head.columns))
    both = both.coalesce(1).sortWithinPartitions("first", "pos", "record_id") if single else both.orderBy("first", "pos", "record_id") if ordered else both
    both.select("value").write.mode("overwrite").text(path)
