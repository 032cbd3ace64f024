"""Intervals (chrom, s, e, name), one-based and inclusive: joins, segments, distances.

No plan here brings a contig into one task: joins are on bins, and running values come in two
levels, over bins of a contig and inside a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the join bins, and of the bins of running values.
BIN, SPAN = 4096, 1 << 16


def with_end(alleles: DataFrame) -> DataFrame:
    """Alleles with `epos`, the last position that the longer of both texts covers."""
    return alleles.withColumn("epos", F.col("npos") + F.greatest(F.length("nref"), F.length("nalt")) - 1)


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def interval_join(alleles: DataFrame, intervals: DataFrame, within: bool = False, how: str = "left_semi", columns: tuple[str, ...] = (), width: int = BIN) -> DataFrame:
    """Alleles that overlap an interval (or lie within one): "left_semi", or "inner" for one row
    per pair with the interval's `columns`.

    Alleles of at most one bin are keyed by the bin of their start; intervals take the bins they
    cover and the one before, so each pair meets once and nothing is made distinct. An interval
    that holds an allele covers its start, so `within` needs no other bin. Longer alleles take all
    their bins and meet an interval in the first bin that both cover. One pass over each side."""
    a, own, on = _binned(alleles, intervals, within, columns, width)
    out = [F.col(f"a.{c}") for c in alleles.columns]
    if how == "inner":
        return a.join(own, on, how).select(*out, *[F.col(f"b.{c}") for c in columns])
    hit = a.join(own, on, "left_semi").select(*out)
    return hit if within else hit.dropDuplicates(["record_id", "aid"])


def _binned(alleles: DataFrame, intervals: DataFrame, within: bool, columns: tuple[str, ...], width: int) -> tuple[DataFrame, DataFrame, Column]:
    """Alleles "a" with a row for each bin they are looked up in and the number of these, intervals
    "b" with one for each bin they are found in, and when they meet."""
    first = F.floor(F.col("npos") / width)
    a = with_end(alleles)
    if within:
        a = a.withColumn("bin", first).withColumn("bins", F.lit(1).cast("long"))
    else:
        last = F.when(F.col("epos") - F.col("npos") < width, first).otherwise(F.floor(F.col("epos") / width))
        a = a.withColumn("bins", last - first + 1).withColumn("bin", F.explode_outer(F.sequence(first, last)))
    own = intervals.select("chrom", "s", "e", *columns).withColumn("bin", _bins(F.col("s") - (0 if within else width), F.col("e"), width))
    hit = (F.col("a.npos") >= F.col("b.s")) & (F.col("a.epos") <= F.col("b.e")) if within else (F.col("a.npos") <= F.col("b.e")) & (F.col("a.epos") >= F.col("b.s"))
    once = (F.col("a.bins") == 1) | (F.col("a.bin") == F.floor(F.greatest("a.npos", "b.s") / width))
    return a.alias("a"), own.alias("b"), (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.bin") == F.col("b.bin")) & hit & once


def outside(alleles: DataFrame, intervals: DataFrame, within: bool = False, width: int = BIN) -> DataFrame:
    """Alleles that no interval meets, by one anti join on the bins. An allele of several bins is
    outside if none of them has a hit; for others nothing is counted across rows."""
    a, own, on = _binned(alleles, intervals, within, (), width)
    left = a.join(own, on, "left_anti")
    if within:
        return left.select(alleles.columns)
    keys = [c for c in alleles.columns if c in ("record_id", "aid")]
    rest = [c for c in alleles.columns if c not in keys]
    left = left.groupBy(*keys, "bins").agg(F.count(F.lit(1)).alias("free"), *[F.any_value(c).alias(c) for c in rest]).filter("free = bins")
    return left.select(alleles.columns)


def annotate_intervals(records: DataFrame, alleles: DataFrame, intervals: DataFrame, within: bool = False) -> DataFrame:
    """All records; INFO gets the distinct names of the intervals that their alleles overlap."""
    from ..functions.fields import with_entry

    pairs = interval_join(alleles.select("record_id", "aid", "chrom", "npos", "nref", "nalt"), intervals, within, "inner", ("name",))
    found = pairs.filter("name IS NOT NULL").groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("__names"))
    rows = records.join(found, "record_id", "left")
    return rows.withColumn("info", F.when(F.col("__names").isNotNull(), with_entry(F.col("info"), F.col("__names"))).otherwise(F.col("info"))).drop("__names")


def _edges(intervals: DataFrame) -> DataFrame:
    """(chrom, p, delta): how the cover changes at p."""
    both = intervals.select("chrom", F.explode(F.array(F.struct(F.col("s").cast("long").alias("p"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).cast("long").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    return both.groupBy("chrom", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d"))


def cover(intervals: DataFrame, span: int = SPAN) -> DataFrame:
    """(chrom, s, e, depth): elementary segments between neighbouring starts and ends."""
    edges = _edges(intervals).withColumn("bin", F.floor(F.col("p") / span))
    bins = edges.groupBy("chrom", "bin").agg(F.sum("d").alias("sum"), F.min("p").alias("first"))
    over = Window.partitionBy("chrom").orderBy("bin")
    bins = bins.select("chrom", "bin", F.coalesce(F.sum("sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(over).alias("after"))
    inner = Window.partitionBy("chrom", "bin").orderBy("p")
    rows = edges.join(bins, ["chrom", "bin"])
    rows = rows.select("chrom", F.col("p").alias("s"), (F.coalesce(F.lead("p").over(inner), F.col("after")) - 1).alias("e"), (F.col("before") + F.sum("d").over(inner)).alias("depth"))
    return rows.filter("e is not null")


def segments(intervals: DataFrame) -> DataFrame:
    """Disjoint elementary segments that cover exactly what the intervals cover."""
    return cover(intervals).filter("depth > 0")


def segments_named(intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Segments with the distinct names, joined by ";", of the intervals over each."""
    seg = segments(intervals).select("chrom", F.col("s").alias("ss"), F.col("e").alias("se"))
    a = seg.withColumn("bin", F.floor(F.col("ss") / width))
    b = intervals.withColumn("bin", _bins(F.col("s"), F.col("e"), width))
    pairs = a.join(b, ["chrom", "bin"]).filter("s <= ss AND e >= se")
    parts = F.transform(F.split("name", ";"), lambda x: x)
    return pairs.groupBy("chrom", F.col("ss").alias("s"), F.col("se").alias("e")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(parts)))), ";").alias("names"))


def merged(intervals: DataFrame) -> DataFrame:
    """(chrom, s, e): overlapping and adjoining intervals as one. Only places where the cover
    begins or ends are kept, and each beginning meets the next end: both levels again."""
    parts = cover(intervals).select("chrom", "s", "e", (F.col("depth") > 0).alias("on"))
    edges = parts.filter("on").select("chrom", "s", "e")
    begins = edges.select("chrom", F.col("s").alias("p"))
    ends = edges.select("chrom", (F.col("e") + 1).alias("p"))
    starts = begins.join(ends, ["chrom", "p"], "left_anti").withColumn("kind", F.lit(0))
    stops = ends.join(begins, ["chrom", "p"], "left_anti").withColumn("kind", F.lit(1))
    both = starts.unionAll(stops).withColumn("bin", F.floor(F.col("p") / SPAN))
    over = Window.partitionBy("chrom").orderBy("bin")
    bins = both.groupBy("chrom", "bin").agg(F.min("p").alias("first")).withColumn("after", F.lead("first").over(over)).drop("first")
    inner = Window.partitionBy("chrom", "bin").orderBy("p")
    rows = both.join(bins, ["chrom", "bin"]).withColumn("next", F.coalesce(F.lead("p").over(inner), F.col("after")))
    return rows.filter("kind = 0").select("chrom", F.col("p").alias("s"), (F.col("next") - 1).alias("e"))


def target_stats(intervals: DataFrame) -> DataFrame:
    """Number, total length and mean length of the intervals."""
    size = F.col("e") - F.col("s") + 1
    return intervals.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("total"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean"))


def distances(places: DataFrame, intervals: DataFrame, span: int = SPAN) -> DataFrame:
    """Places (chrom, pos, ...) with `dist`: 0 inside an interval, minus the way to the nearest end
    on the left if that is nearer, else the way to the next start on the right; null on a contig
    without intervals. As-of over a union of both, in two levels."""
    cols = [c for c in places.columns if c not in ("chrom", "pos")]
    ivs = intervals.select("chrom", F.col("s").cast("long").alias("p"), F.lit(0).alias("kind"), F.col("e").cast("long").alias("e"), F.lit(None).alias("row"))
    own = places.select("chrom", F.col("pos").cast("long").alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("e"), F.struct(F.lit(1).alias("__"), *cols).alias("row"))
    both = ivs.withColumn("row", F.col("row").cast(own.schema["row"].dataType)).unionAll(own).withColumn("bin", F.floor(F.col("p") / span))
    start = F.when(F.col("kind") == 0, F.col("p"))
    bins = both.groupBy("chrom", "bin").agg(F.max("e").alias("e"), F.min(start).alias("s"))
    over = Window.partitionBy("chrom").orderBy("bin")
    bins = bins.select("chrom", "bin", F.max("e").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("e0"), F.min("s").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("s0"))
    inner = Window.partitionBy("chrom", "bin").orderBy("p", "kind")
    rows = both.join(bins, ["chrom", "bin"])
    left = F.greatest(F.max("e").over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("e0"))
    right = F.least(F.min(start).over(inner.rowsBetween(0, Window.unboundedFollowing)), F.col("s0"))
    rows = rows.select("chrom", "p", "kind", "row", left.alias("l"), right.alias("r")).filter("kind = 1")
    back, ahead = F.col("p") - F.col("l"), F.col("r") - F.col("p")
    dist = F.when(F.col("l") >= F.col("p"), 0).when(F.col("r").isNull() | (back < ahead), -back).otherwise(ahead)
    return rows.select("chrom", F.col("p").cast("int").alias("pos"), *[F.col(f"row.{c}").alias(c) for c in cols], dist.cast("long").alias("dist"))


def distance_histogram(places: DataFrame, intervals: DataFrame) -> DataFrame:
    return distances(places.select("chrom", "pos"), intervals).filter("dist is not null").groupBy("chrom", "dist").agg(F.count(F.lit(1)).alias("n"))
