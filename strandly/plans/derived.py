"""Call sets, genotypes and intervals derived from the driver's tables.

The expressions are read by Spark and by DuckDB alike, so both start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES = ("S1", "S2", "S3")
FORMAT = "GT:GQ"
_B = [f"substring('{s}', cast(l_partkey % 4 as int) + 1, 1)" for s in ("ACGT", "CGTA", "GTAC", "TACG")]
B0, B1, B2, B3 = _B
K = "(l_partkey + l_linenumber) % 12"
#: REF and ALT by K.
ALLELES = [
    (B0, B2),
    (B0, B1),
    (B0, f"concat({B1}, ',', {B2})"),
    (B0, f"concat({B1}, ',', {B2}, ',', {B3})"),
    (f"concat({B0}, 'CG')", f"concat({B2}, 'CA')"),
    (f"concat('CA', {B0}, 'TT')", f"concat('CA', {B2}, 'TT')"),
    (B0, f"concat({B0}, 'TG')"),
    (f"concat({B0}, 'GT')", B0),
    (f"concat({B0}, 'GT')", f"concat({B1}, 'A')"),
    (B0, "'<DEL>'"),
    (B0, f"concat({B0}, '[chr2:321[')"),
    (f"concat({B0}, 'GT')", f"concat({B0}, ',', {B2}, 'GT')"),
]


def _case(which: int) -> str:
    return f"case {K} " + " ".join(f"when {k} then {x[which]}" for k, x in enumerate(ALLELES)) + " end"


#: A row's own number from its columns: narrow, where numbering rows would bring them together.
RECORD_ID = "((cast(l_orderkey as bigint) * 8 + l_linenumber) * 64 + cast(l_quantity as int)) * 4194304 + (l_partkey * 31 + l_suppkey) % 4194304"
N_ALT = f"case {K} when 2 then 2 when 3 then 3 when 11 then 2 else 1 end"
_AC = f"concat('AC=', cast(l_linenumber % 5 + 1 as int), case when {N_ALT} > 1 then concat(',', cast(l_linenumber % 5 + 2 as int)) else '' end, case when {N_ALT} > 2 then concat(',', cast(l_linenumber % 5 + 3 as int)) else '' end, case when l_partkey % 50 = 0 then ',9' else '' end)"


def _sample(i: int) -> str:
    gt = f"case (l_partkey + {i}) % 6 when 0 then '0/0' when 1 then '0/1' when 2 then '1/1' when 3 then './.' when 4 then '1|0' else '.' end"
    return f"case when (l_partkey + {i}) % 6 = 5 then '.' else concat({gt}, ':', cast(l_quantity as int) + {i}) end"


VARIANT = {
    "record_id": RECORD_ID,
    "chrom": "concat('chr', l_suppkey % 22 + 1)",
    "pos": "cast(l_orderkey * 40 + l_linenumber * 5 + 1 as int)",
    "rsid": "case when l_partkey % 3 = 0 then concat('rs', l_partkey) else '.' end",
    "ref": _case(0),
    "alt": _case(1),
    "qual": "l_quantity",
    "flt": "case l_returnflag when 'A' then 'PASS' when 'N' then '.' else 'q10;s50' end",
    "info": f"concat('DP=', cast(l_quantity as int), ';', {_AC}, case when l_partkey % 3 = 0 then ';DB' else '' end)",
    "format": f"'{FORMAT}'",
    **{s: _sample(i) for i, s in enumerate(SAMPLES, 1)},
}
#: Samples whose fields have a value for each allele (AO), that and the reference (AD), or each genotype (GL).
_VALUES = lambda first, n: f"concat(cast({first} as int), case when {n} > 1 then concat(',', cast({first} + 1 as int)) else '' end, case when {n} > 2 then concat(',', cast({first} + 2 as int)) else '' end)"
NUMBERED = {
    "format": "'GT:AO:AD:GL'",
    **{s: f"case when (l_partkey + {i}) % 6 = 5 then '.' else concat(case (l_partkey + {i}) % 6 when 0 then '0/0' when 1 then '0/1' when 2 then '1/1' when 3 then './.' else '1|0' end, ':', {_VALUES('l_linenumber', N_ALT)}, ':', cast(l_quantity as int), ',', {_VALUES('l_linenumber * 3', N_ALT)}, ':0.1,0.2,0.7') end" for i, s in enumerate(SAMPLES, 1)},
}
A_ROWS, B_ROWS = "l_orderkey % 3 <> 0", "l_orderkey % 3 <> 1"
#: In call set B some records have another allele at the same place.
B_ALT = f"case when {K} in (0, 1) and l_suppkey % 5 = 0 then {B3} else {_case(1)} end"
INTERVAL = {
    "chrom": "concat('chr', o_custkey % 22 + 1)",
    "s": "cast(o_orderkey * 40 + 1 as int)",
    "e": "cast(o_orderkey * 40 + 1 + o_custkey % 600 as int)",
    "name": "o_orderpriority",
}
COLUMNS = list(VARIANT)


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


#: Bytes of a file a core reads well; smaller inputs come in fewer pieces than there are cores.
PIECE = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores. A file of one row group is one task's work however many cores
    there are; only inputs under PIECE bytes a core are dealt anew, larger ones come in pieces."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < PIECE * cores else rows


def _table(spark: SparkSession, sf_dir: str, name: str, where: str = "true") -> DataFrame:
    columns = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"], "orders": ["o_orderkey", "o_custkey", "o_orderpriority"]}[name]
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").filter(where).select(columns))


def _derived(columns: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in columns.items()]


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*_derived(VARIANT))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*_derived(VARIANT | NUMBERED))


def calls_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem", A_ROWS).selectExpr(*_derived(VARIANT))


def calls_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem", B_ROWS).selectExpr(*_derived(VARIANT | {"alt": B_ALT}))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*_derived(INTERVAL))
