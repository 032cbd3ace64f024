"""Allele algebra, files, joins, intervals, statistics and rules on small hand-written inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandly import __main__ as cli
from strandly import registry
from strandly.functions import align, fields, text
from strandly.functions import alleles as A
from strandly.operators import alleles as O
from strandly.operators import distributions, filters, intervals, joins, stats, validate
from strandly.sources import bed, fasta, samples, vcf
from strandly.streaming.filters import filter_stream

HEADER = """##fileformat=VCFv4.1
##contig=<ID=1>
##INFO=<ID=AC,Number=A,Type=Integer,Description="Counts, of alleles">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=PL,Number=2,Type=Float,Description="Two">
##FILTER=<ID=q10,Description="Low">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="Likelihoods">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNA1\tNA2
"""
RECORDS = [
    "1\t10\trs1\tA\tG\t50\tPASS\tDP=5;AC=1;DB\tGT:GQ\t0/1:30\t1/1:9",
    "1\t20\t.\tA\tC,G\t5\t.\tAC=1,2;DP=7\tGT:GQ\t1|2:30\t.",
    "1\t30\t.\tCAGTT\tCATTT\t.\tPASS\tDP=9\tGT:GQ\t0/0:30\t./.:1",
    "1\t40\trs4\tA\tATG\t60\tq10\t.\tGT:GQ\t0/1:40\t0/0:40",
    "2\t5\t.\tAGT\tA,GGT\t70\tPASS\tAC=3,4;PL=1.5,2\tGT:GQ\t2/1:40\t0/2:40",
    "2\t50\t.\tGC\tAT\t70\tPASS\tDP=1\tGT:GQ\t0/1:40\t1/1:40",
    "2\t60\t.\tAGT\tCA\t70\tPASS\tDP=1\tGT:GQ\t0/1:40\t0/0:40",
    "2\t70\t.\tA\t<DEL>\t70\tPASS\tDP=1\tGT:GQ\t0/1:40\t0/0:40",
    "2\t80\t.\tA\tA[chr2:321[\t70\tPASS\tDP=1\tGT:GQ\t0/1:40\t0/0:40",
]


def put(folder, name, lines):
    path = folder / name
    path.write_text(HEADER + "\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    return vcf.read(spark, put(tmp_path_factory.mktemp("calls"), "a.vcf", RECORDS))


def by_pos(rows, *columns):
    return {x["pos"]: tuple(x[c] for c in columns) if len(columns) > 1 else x[columns[0]] for x in rows.collect()}


def test_trim_equals_a_loop(spark):
    r = random.Random(0)
    pairs = [("".join(r.choice("ACGT") for _ in range(r.randint(1, 8))), "".join(r.choice("ACGT") for _ in range(r.randint(1, 8)))) for _ in range(400)]
    pairs += [(a[0] + "TG" * 3, a[0] + "TG" * 2) for a, _ in pairs[:20]]
    df = spark.createDataFrame([(7, a, b) for a, b in pairs], "pos int, r string, a string")
    got = df.select("r", "a", A.trim(F.col("pos"), F.col("r"), F.col("a")).alias("t")).collect()
    for x in got:
        p, a, b = 7, x["r"], x["a"]
        while min(len(a), len(b)) > 1 and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        while min(len(a), len(b)) > 1 and a[0] == b[0]:
            a, b, p = a[1:], b[1:], p + 1
        assert tuple(x["t"]) == (p, a, b)


def test_classes(calls):
    rows = O.explode_alleles(calls[0].withColumnRenamed("rsid", "x")).collect()
    got = [(x["npos"], x["nref"], x["nalt"], x["cls"], x["snp_arity"]) for x in rows]
    assert got == [
        (10, "A", "G", "snp", 2), (20, "A", "C", "snp", 3), (20, "A", "G", "snp", 3), (32, "G", "T", "snp", 2), (40, "A", "ATG", "ins", None),
        (5, "AGT", "A", "del", None), (5, "A", "G", "snp", 2), (50, "GC", "AT", "mnp", None), (60, "AGT", "CA", "complex", None), (70, "A", "<DEL>", "sv", None), (80, "A", "A[chr2:321[", "rearrangement", None),
    ]
    assert O.explode_alleles(calls[0].limit(1).withColumn("alt", F.lit("."))).count() == 0


def test_header_and_round_trip(spark, calls, tmp_path):
    records, header = calls
    assert header.samples == ["NA1", "NA2"] and header.declared("INFO")[0] == validate.Field("AC", "A", "Integer")
    assert [x["ok"] for x in header.frame(spark).collect()] == [True] * 8
    vcf.write(records, header, str(tmp_path / "out"), "test", single=True)
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[: 3] == ["##fileformat=VCFv4.1", "##contig=<ID=1>", "##task=test"]
    assert [x for x in lines if not x.startswith("#")] == RECORDS
    again, h2 = vcf.read(spark, str(tmp_path / "out"))
    assert again.count() == len(RECORDS) and h2.samples == header.samples
    with pytest.raises(vcf.HeaderError):
        vcf.Header.parse(["##x=1", "#CHROM\tPOS"])
    with pytest.raises(vcf.HeaderError):
        vcf.Header.parse(["##x=1"])
    bad = vcf.Header.parse(['##INFO=<ID=X,Number=Z,Type=Integer,Description="">', *HEADER.strip().split("\n")])
    assert [x["id"] for x in validate.header_faults(bad.frame(spark)).collect()] == ["X"]


def test_filters(calls):
    records, header = calls
    f = lambda **o: by_pos(filters.filter_records(records, **o), "flt")
    assert f(quality=20) == {10: "PASS", 20: "Q20", 30: "Q20", 40: "q10", 5: "PASS", 50: "PASS", 60: "PASS", 70: "PASS", 80: "PASS"}
    assert set(f(mark_pass=True).values()) == {"PASS"} and f()[20] == "."
    assert 40 not in f(quality=20, pass_only=True)
    assert by_pos(filters.filter_records(records, delete_info=["DP", "DB"]), "info")[30] == "."
    assert set(by_pos(filters.filter_records(records, keep_records=["DB", "PL"]), "info")) == {10, 5}
    assert 10 not in by_pos(filters.filter_records(records, strip_records=["DB"]), "info")
    assert filters.filter_records(records, remove_genotypes=True, samples=header.samples).columns[-1] == "file_idx"
    with pytest.raises(ValueError):
        filters.filter_records(records, strip_records=["a"], keep_records=["b"])
    assert by_pos(filters.find_hets(records, header.samples), "info")[10] == "DP=5;AC=1;DB;HET=NA1"
    assert set(by_pos(filters.sample_subset(records, header.samples, ["NA2", "none"]), "info")) == {10, 5, 50}
    assert by_pos(filters.quality_text(records.withColumn("qual_raw", F.lit(None).cast("string"))), "qual_raw")[30] == "."


def test_alleles_removed(calls):
    records, header = calls
    kept = O.select_classes(records, [A.SNP], ["AC"], header.samples)
    got = by_pos(kept, "alt", "info", "NA1", "NA2")
    assert got[5] == ("GGT", "AC=4;PL=1.5,2", "1/.:40", "0/1:40")
    assert got[20] == ("C,G", "AC=1,2;DP=7", "1|2:30", ".")
    assert set(got) == {10, 20, 30, 5}
    anchored = O.reanchor(records, per_allele=["AC"], genotypes=header.samples)
    assert anchored.columns == records.columns
    assert [tuple(x) for x in anchored.select("pos", "ref", "alt", "info", "NA1").collect()] == [
        (10, "A", "G", "DP=5;AC=1;DB", "0/1:30"), (20, "A", "C,G", "AC=1,2;DP=7", "1|2:30"), (32, "G", "T", "DP=9", "0/0:30"), (5, "A", "G", "AC=4;PL=1.5,2", "1/.:40")]
    split = O.split_mnps(records).collect()
    assert [(x["pos"], x["ref"], x["alt"], x["info"]) for x in split] == [(50, "G", "A", "DP=1;FROM_MNP"), (51, "C", "T", "DP=1;FROM_MNP")]


MIXED = [
    "1\t10\t.\tA\tG,ATT\t50\tPASS\tAC=1,2;AD=5,6,7\tGT:AO:AD:GL\t0/1:7,9:1,2,3:1,2,3,4,5,6\t1|2:7,9:.:.",
    "1\t20\t.\tAC\tGT,A\t50\tPASS\tAC=1,2\tGT:AO\t1/2:3,4\t.",
    "1\t30\t.\tC\t.\t50\tPASS\tDP=1\tGT\t0/0\t.",
]
NUMBERS = {"GT": "1", "AO": "A", "AD": "R", "GL": "G"}


def test_fields_by_number(spark, tmp_path):
    records, header = vcf.read(spark, put(tmp_path, "m.vcf", MIXED))
    kept = O.select_classes(records, [A.SNP], {"AC": "A", "AD": "R"}, header.samples, NUMBERS)
    assert by_pos(kept, "alt", "info", "NA1", "NA2") == {10: ("G", "AC=1;AD=5,6", "0/1:7:1,2:.", "1|.:7:.:.")}
    split = O.split_mnp_records(records, {"AC": "A"}, header.samples, NUMBERS).collect()
    assert sorted((x["pos"], x["ref"], x["alt"], x["info"], x["NA1"]) for x in split if x["pos"] != 10) == [
        (20, "A", "G", "AC=1;FROM_MNP", "1/.:3"), (20, "AC", "A", "AC=2", "./1:4"), (21, "C", "T", "AC=1;FROM_MNP", "1/.:3"), (30, "C", ".", "DP=1", "0/0")]
    whole = [x for x in split if x["pos"] == 10][0]
    assert whole["alt"] == "G,ATT" and whole["NA1"] == "0/1:7,9:1,2,3:1,2,3,4,5,6"


def test_report_has_every_row(spark):
    assert len(stats.report(spark.range(12_345)).splitlines()) == 12_346


def test_six_digits_and_numbers(spark):
    xs = [0.0, 1.0, 50.25, 123456.7, 1234567.0, 0.00001234, 1e-4, 99999.95, 3.14159265, 1e20, 12.5, -7.125]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.six_digits(F.col("x")).alias("t")).collect()
    assert [x["t"] for x in got] == [f"{x:g}" for x in xs]
    df = spark.createDataFrame([("12abc",), ("x",), ("-3.5e2z",), ("",)], "s string")
    assert [tuple(x) for x in df.select(text.leading_int(F.col("s")), text.leading_double(F.col("s"))).collect()] == [(12, 12.0), (0, 0.0), (-3, -350.0), (0, 0.0)]
    df = spark.createDataFrame([("a;;b;",), ("",), ("x",)], "s string")
    assert [tuple(x) for x in df.select(text.split_char(F.col("s"), ";"), text.split_any(F.col("s"), ";x"), text.split_most(F.col("s"), ";", 2)).collect()] == [(["a", "", "b"], ["a", "b"], ["a", ";b;"]), ([], [], [""]), (["x"], [], ["x"])]
    import math

    df = spark.createDataFrame([(a, p) for a in range(6) for p in range(5)], "a int, p int")
    assert all(x["n"] == math.comb(x["a"] + x["p"], x["p"]) for x in df.select("a", "p", text.genotype_count(F.col("a"), F.col("p")).alias("n")).collect())


def test_genotypes(spark):
    df = spark.createDataFrame([(g,) for g in ("0/1", "1|0", "./.", "1", "2/1", "0/2", "0/0", "1/1")], "g string")
    assert [x[0] for x in df.select(fields.zygosity(F.col("g"))).collect()] == ["het", "het", "unknown", "hom_alt", "mixed", "het", "hom_ref", "hom_alt"]
    keep = F.array(F.lit(False), F.lit(True))
    assert [x[0] for x in df.select(fields.renumbered(F.col("g"), keep)).collect()] == ["0/.", ".|0", "./.", ".", "1/.", "0/1", "0/0", "./."]


def other(spark, tmp_path):
    lines = ["2\t80\trs9\tA\tA[chr2:321[\t1\tq10\tDP=1\tGT\t0/1\t0/0", "1\t10\trs7\tA\tG\t99\tq10\tDP=5\tGT\t0/1\t0/0", "1\t20\trs8\tA\tT\t1\tPASS\tDP=5\tGT\t0/1\t0/0", "1\t31\trs5\tAGT\tATT\t1\ts50\tDP=5\tGT\t0/1\t0/0", "3\t1\t.\tA\tC\t1\t.\tDP=5\tGT\t0/1\t0/0"]
    return vcf.read(spark, put(tmp_path, "b.vcf", lines))


def test_joins(spark, calls, tmp_path):
    a = O.explode_alleles(calls[0], ["qual"])
    records_b, _ = other(spark, tmp_path)
    b = O.explode_alleles(records_b, ["qual"])
    places = lambda df: sorted((x["npos"], x["nalt"]) for x in df.collect())
    assert places(joins.common(a, b)) == [(10, "G"), (32, "T")]
    assert places(joins.common(a, b, sites_only=True)) == [(10, "G"), (20, "C"), (20, "G"), (32, "T")]
    assert (80, "A[chr2:321[") not in places(joins.unique(a, b)) and (70, "<DEL>") in places(joins.unique(a, b))
    compared = a.filter(~F.col("cls").isin("sv", "rearrangement"))
    both = joins.common(a, b).count() + joins.unique(a, b).filter(~F.col("cls").isin("sv", "rearrangement")).count()
    assert both == compared.count()
    assert joins.union(a, b).count() == a.count() + 2
    best = {x["npos"]: (x["qual"], x["source"]) for x in joins.best_quality(a, b, ["qual"]).collect()}
    assert best == {10: (99.0, 1), 32: (1.0, 1)}
    got = by_pos(joins.annotate_dbsnp(calls[0], records_b), "rsid", "info")
    assert got[10] == ("rs7", "DP=5;AC=1;DB;dbSNP") and got[30] == ("rs5", "DP=9;dbSNP") and got[20] == (".", "AC=1,2;DP=7") and len(got) == 9
    assert by_pos(joins.annotate_filter(calls[0], records_b), "info")[10] == "DP=5;AC=1;DB;q10"
    checked = {x["chrom"]: tuple(x)[1:] for x in joins.contig_check(calls[0], records_b).collect()}
    assert checked == {"1": (4, 3, True), "2": (5, 1, True), "3": (0, 1, False)}
    order = {x["chrom"]: x["contiguous"] for x in joins.contig_order(records_b).collect()}
    assert order == {"2": True, "1": True, "3": True}
    assert joins.merge([calls[0], records_b], ordered=True).select("pos").collect()[0][0] == 10
    # no order of the inputs matters
    assert places(joins.common(a.orderBy(F.rand(1)), b.orderBy(F.rand(2)))) == places(joins.common(a, b))


def test_intervals(spark, tmp_path):
    r = random.Random(6)
    ivs = [(c, s, s + r.choice((0, 3, 40, 9000)), f"n{r.randrange(4)}") for c in ("1", "2") for s in (r.randrange(1, 60_000) for _ in range(60))]
    ivs += [("3", 1, 5, "a"), ("3", 6, 9, "b"), ("3", 1, 5, "a;c")]
    df = spark.createDataFrame(ivs, "chrom string, s int, e int, name string")
    places = [(i, 0, r.choice("123"), r.randrange(1, 70_000), "A" * r.choice((1, 1, 2, 30, 6000)), "A") for i in range(300)]
    al = spark.createDataFrame(places, "record_id long, aid int, chrom string, npos int, nref string, nalt string")
    hit = lambda p, w: [v for v in ivs if v[0] == p[2] and (p[3] >= v[1] and p[3] + len(p[4]) - 1 <= v[2] if w else p[3] <= v[2] and p[3] + len(p[4]) - 1 >= v[1])]
    for w in (False, True):
        want = sorted(p[0] for p in places if hit(p, w))
        assert sorted(x["record_id"] for x in intervals.interval_join(al, df, w).collect()) == want
        assert sorted(x["record_id"] for x in intervals.outside(al, df, w).collect()) == sorted(p[0] for p in places if not hit(p, w))
        pairs = Counter((x["record_id"], x["name"]) for x in intervals.interval_join(al, df, w, "inner", ("name",)).collect())
        assert pairs == Counter((p[0], v[3]) for p in places for v in hit(p, w))
    covered = Counter((c, i) for c, s, e, _ in ivs for i in range(s, e + 1))
    got = Counter()
    for x in intervals.segments(df).collect():
        for i in range(x["s"], x["e"] + 1):
            assert (x["chrom"], i) not in got
            got[x["chrom"], i] = x["depth"]
    assert got == covered
    merged = sorted((x["chrom"], x["s"], x["e"]) for x in intervals.merged(df).collect())
    assert {(c, i) for c, s, e in merged for i in range(s, e + 1)} == set(covered)
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(merged, merged[1:], strict=False))
    names = {(x["chrom"], x["s"]): x["names"] for x in intervals.segments_named(df).collect()}
    assert names["3", 1] == "a;c" and names["3", 6] == "b"
    spots = spark.createDataFrame([(p[2], p[3], p[0]) for p in places] + [("9", 4, -1)], "chrom string, pos int, id long")
    for x in intervals.distances(spots, df).collect():
        own = [v for v in ivs if v[0] == x["chrom"]]
        inside = any(v[1] <= x["pos"] <= v[2] for v in own)
        left = min((x["pos"] - v[2] for v in own if v[2] < x["pos"]), default=None)
        right = min((v[1] - x["pos"] for v in own if v[1] > x["pos"]), default=None)
        want = None if not own else 0 if inside else -left if right is None or left is not None and left < right else right
        assert x["dist"] == want
    t = intervals.target_stats(df).first()
    assert (t["n"], t["total"]) == (len(ivs), sum(e - s + 1 for _, s, e, _ in ivs))
    bed.write(df, str(tmp_path / "bed"))
    assert sorted(map(tuple, bed.read(spark, str(tmp_path / "bed")).collect())) == sorted(ivs)
    (tmp_path / "x.bed").write_text("#h\n1\t5\t9\n1\t9\t3\tbad\n")
    assert validate.interval_faults(bed.read(spark, str(tmp_path / "x.bed"), strict=False)).count() == 1
    with pytest.raises(Exception, match="ends before it starts"):
        bed.read(spark, str(tmp_path / "x.bed")).collect()


def test_stats(calls):
    records, header = calls
    rows = O.explode_alleles(records, ["rsid", "flt", "info", *header.samples])
    got = {(x["chrom"], x["ft"]): x for x in stats.by_filter(rows).collect()}
    total, passed = got["total", "all"], got["total", "PASS"]
    assert (total["known_ts"], total["novel_ts"], total["novel_tv"], total["multi"], total["mnp"], total["ins"], total["del"], total["complex"], total["other"]) == (1, 1, 1, 1, 1, 1, 1, 1, 2)
    assert (passed["known_ts"], passed["multi"], passed["tstv"], passed["pct_dbsnp"]) == (1, 0, 2.0, round(100 / 3, 6))
    for c in ("known_ts", "novel_ts", "novel_tv", "multi", "mnp", "ins", "del"):
        assert sum(x[c] for k, x in got.items() if k[0] != "total" and k[1] == "all") == total[c]
    s = {x["sample"]: x for x in stats.by_sample(records, header.samples, 20).collect()}
    assert (s["NA1"]["het"], s["NA1"]["mixed"], s["NA1"]["hom_ref"], s["NA1"]["known_het_ts"], s["NA1"]["het_mnp"]) == (6, 2, 1, 1, 1)
    assert s["NA2"]["hom_mnp"] == 1 and s["NA2"]["het"] == 1 and s["NA2"]["unknown"] == 1
    assert [tuple(x) for x in stats.mnp_lengths(rows).collect()] == [(2, 1)]
    assert sorted(tuple(x)[:3] for x in stats.indel_lengths(rows).collect()) == [(-1, 0, 1), (2, 0, 1)]
    d = {x["pos"]: x for x in stats.detailed(records, header.samples, "GQ", 5).collect()}
    assert (d[10]["change"], d[10]["het_samples"], d[10]["hom_alt_samples"], d[10]["mean_het"]) == ("ts", "NA1", "NA2", 30.0)
    assert [tuple(x) for x in stats.annotation_counts(rows).collect()] == [("DB", 1, 0, 0.0)]
    assert {x["value"]: x["n"] for x in distributions.primary(records, "DP", ["AC"]).collect()}["1"] == 4
    assert {(x["tag"], x["value"]): x["n"] for x in distributions.histogram(records, ["DP"]).collect()}["QUAL", 70.0] == 5
    assert "total" in stats.report(stats.by_filter(rows))


def test_validate(spark, tmp_path):
    lines = [
        "1\t1\t.\tA\tG\t1\t.\tDP=x;AC=1\tGT:GQ\t0/1:3\t0/1:3",
        "1\t2\t.\tA\tG,C\t1\t.\tAC=1;ZZ=1\tGT:GQ\t0/3:3\t0/1",
        "1\t3\t.\tA\tG\tabc\t.\tDB=1;PL=1\tGT:GQ\t0/1|0:3\tx/1:3",
        "1\t4x\t.\tA\tG\t1\t.\tDP=.;AC=.\tGT:GL\t0/1:1,2\t./.:.",
        "1\t5\t.\tA\tG\t1\t.\t.\tGT:QQ\t.\t.",
        "1\t6\t.\tA\tG\t1\t.\tDP=0;PL=0.00,1e-3\tGT:GL\t0/1:1,2,3\t1:1,2",
    ]
    records, header = vcf.read(spark, put(tmp_path, "v.vcf", lines))
    found = validate.record_faults(records).unionByName(validate.info_faults(records, header.declared("INFO"))).unionByName(validate.genotype_faults(records, header.samples, header.declared("FORMAT")))
    got = sorted((x["pos"], x["sample"] or "", x["field"], x["rule"]) for x in found.collect())
    assert got == sorted([
        (1, "", "DP", "type"), (2, "", "AC", "number"), (2, "", "ZZ", "undeclared"), (2, "NA1", "GT", "range"), (2, "NA2", "FORMAT", "fields"),
        (3, "", "QUAL", "type"), (3, "", "DB", "flag"), (3, "", "PL", "number"), (3, "NA1", "GT", "phase"), (3, "NA2", "GT", "allele"),
        (4, "", "POS", "type"), (4, "NA1", "GL", "number"), (5, "", "QQ", "undeclared"),
    ])
    assert not validate.clean(found)


def test_alignment(spark):
    assert align.left_align(10, "G", "GTG", "ACCATGTGT") == (4, "A", "ATG")
    assert align.left_align(10, "GTG", "G", "ACCATGTGT") == (4, "ATG", "A")
    assert align.left_align(3, "C", "T", "AC") == (3, "C", "T") and align.left_align(1, "A", "AA", "") == (1, "A", "AA")
    assert align.left_align(5, "TCA", "TGA", "ACGT") == (6, "C", "G")
    r = random.Random(1)
    for _ in range(300):  # the same sequence, and no further to the left
        ref = "".join(r.choice("AT") for _ in range(30))
        p, n = r.randrange(8, 20), r.randrange(1, 3)
        a, b = (ref[p], ref[p] + "".join(r.choice("AT") for _ in range(n))) if r.random() < 0.5 else (ref[p : p + n + 1], ref[p])
        q, c, d = align.left_align(p + 1, a, b, ref[:p])
        assert ref[:p] + b + ref[p + len(a) :] == ref[: q - 1] + d + ref[q - 1 + len(c) :] and ref[q - 1 : q - 1 + len(c)] == c and q <= p + 1
        assert c[-1] != d[-1] or q == 1 or min(len(c), len(d)) > 1 or len(c) == len(d)
    x = align.smith_waterman("ACGTACGTACGT", "ACGTACTTACGT")
    assert x.cigar == "6=1X5=" and x.score == 11 * 10 - 9
    assert align.align_allele("A", "ATG", "CCGATCCA", "CCTAGCAT").cigar == "9=2I8="
    assert align.smith_waterman("ACGTACCCGTTA", "ACGTAGTTA").score == pytest.approx(90 - 15 - 2 * 6.66)
    assert align.matches("R", "a") and not align.matches("N", "A") and not align.matches("X", "X")
    assert align.smith_waterman("", "A").cigar == ""


def test_alignments_together_are_those_alone():
    r = random.Random(5)
    word = lambda n, of: "".join(r.choice(of) for _ in range(n))
    pairs = [(word(r.randint(0, 14), "ACGT"), word(r.randint(0, 14), "ACGTNRYacg")) for _ in range(150)]
    pairs += [(x, x[:i] + word(r.randint(0, 3), "ACGT") + x[i + r.randint(0, 3) :]) for x in (word(30, "ACGT") for _ in range(60)) for i in (12,)]
    for homopolymer in (0.0, 5.0):
        assert align.smith_watermans(pairs + pairs[:5], homopolymer) == [align.smith_waterman(a, b, homopolymer) for a, b in pairs + pairs[:5]]


def test_sequences(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 one\nACGTAC\nGTACCA\nTTG\n>chr2\nGGGCCC\n")
    chunks = fasta.read(spark, str(tmp_path / "r.fa"), 4)
    assert {x["name"]: x["length"] for x in fasta.lengths(chunks).collect()} == {"chr1": 15, "chr2": 6}
    assert fasta.whole(chunks, "chr1").first()["seq"] == "ACGTACGTACCATTG" and fasta.first_with(chunks, "chr") == "chr1"
    places = spark.createDataFrame([("chr1", 2, 6), ("chr1", 12, 9), ("chr2", 0, 6), ("chr2", -2, 4)], "chrom string, start int, len int")
    assert {(x["chrom"], x["start"]): x["bases"] for x in fasta.slices(places, chunks, chunk=4).collect()} == {("chr1", 2): "GTACGT", ("chr1", 12): "TTG", ("chr2", 0): "GGGCCC", ("chr2", -2): "GG"}
    assert [tuple(x) for x in fasta.index(spark, str(tmp_path / "r.fa")).collect()] == [("chr1", 15, 10, 6, 7, True), ("chr2", 6, 34, 6, 7, True)]
    seqs = spark.createDataFrame([("c", "ACCATGTGTGAA")], "name string, seq string")
    al = spark.createDataFrame([(1, 0, "c", 10, "G", "GTG", "ins"), (2, 0, "c", 3, "C", "T", "snp")], "record_id long, aid int, chrom string, npos int, nref string, nalt string, cls string")
    done = align.left_aligned(align.with_left(al, fasta.chunked(seqs)))
    assert sorted((x["record_id"], x["npos"], x["nref"], x["nalt"]) for x in done.collect()) == [(1, 4, "A", "ATG"), (2, 3, "C", "T")]


def test_long_sequences_in_splits(spark, tmp_path):
    r = random.Random(4)
    seqs = {f"c{i}": "".join(r.choice("ACGTN") for _ in range(n)) for i, n in enumerate((700_001, 0, 59, 60, 300_000))}
    path = tmp_path / "long.fa"
    path.write_text("".join(f">{k} about\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for k, s in seqs.items()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        chunks = {(x["name"], x["chunk"]): x["seq"] for x in fasta.read(spark, str(path), 10_000).collect()}
        rows = [tuple(x) for x in fasta.index(spark, str(path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert chunks == {(k, i): s[10_000 * i : 10_000 * i + 10_000] for k, s in seqs.items() for i in range(-(-len(s) // 10_000))}
    raw = path.read_text()
    want = [(k, len(s), raw.index(f">{k} about\n") + len(k) + 8, min(60, len(s)), min(60, len(s)) + (len(s) > 0), True) for k, s in seqs.items()]
    assert rows == want


def test_registry_and_samples(spark, tmp_path):
    names = registry.register(spark)
    assert "is_ts" in names and "joins.common" in registry.OPERATORS
    row = spark.sql("SELECT is_ts('a', 'G') t, genotype_count(2, 2) g, allele_trim(30, 'CAGTT', 'CATTT').npos p, left_align(10, 'G', 'GTG', 'ACCATGTGT').npos l, sw_cigar('A', 'G', 'CCGT', 'TTCA') c").first()
    assert tuple(row) == (True, 6, 32, 4, "4=1X4=")
    (tmp_path / "s").write_text("NA2\nnobody\n")
    with pytest.warns(UserWarning, match="nobody"):
        assert samples.read(spark, str(tmp_path / "s"), ["NA1", "NA2"]) == ["NA2"]


def test_stream(spark, calls, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.vcf", RECORDS)
    query = filter_stream(spark, str(folder), calls[1], (A.SNP,), ("AC",), quality=20, pass_only=True).writeStream.format("memory").queryName("stream").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(x["pos"] for x in spark.table("stream").collect()) == [5, 10]


def test_command_line(spark, tmp_path, capsys):
    a = put(tmp_path, "a.vcf", RECORDS)
    b = put(tmp_path, "b.vcf", ["1\t10\trs7\tA\tG\t99\tq10\tDP=5\tGT\t0/1\t0/0"])
    (tmp_path / "t.bed").write_text("1\t5\t15\tx\n")

    def run(*args):
        code = cli.main(list(args), spark)
        return code, [x for x in capsys.readouterr().out.split("\n") if x and not x.startswith("#")]

    assert len(run("filter", "-i", a, "-q", "20", "-l", "-1")[1]) == 2
    assert len(run("filter", "-i", a, "-p", "-2", "-e")[1]) == 2
    assert run("intersect", "-i", a, "-i", b, "-c", "a")[1] == [RECORDS[0]]
    assert len(run("intersect", "-i", a, "-i", b, "-q", "a")[1]) == 8 and len(run("intersect", "-i", a, "-i", b, "-u", "a")[1]) == 9
    assert len(run("intersect", "-i", a, "-i", b, "-c", "q")[1]) == 1
    assert run("intersect", "-i", a, "-b", str(tmp_path / "t.bed"), "-c", "a")[1] == [RECORDS[0]]
    assert "x" in run("annotate", "-i", a, "-b", str(tmp_path / "t.bed"))[1][0].split("\t")[7].split(";")
    assert len(run("merge", "-i", a, "-i", b)[1]) == 10
    assert run("stats", "-i", a, "-s", "20", "-a", "-n", "all", "-p")[0] == 0
    assert run("validate", "-i", a)[0] == 0 and run("distributions", "-i", a, "-p", "DP", "-d", "AC")[0] == 0
    cli.main(["filter", "-i", a, "-m", "-o", str(tmp_path / "out")], spark)
    assert vcf.read(spark, str(tmp_path / "out"))[0].filter("flt = 'PASS'").count() == 9
