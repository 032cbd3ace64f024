"""Reference sequences as chunks, with their index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import ship

CHUNK = 1 << 16


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Runs of lines of a sequence, CHUNK bases at most and a line: file, block and k give their
    order; name is null where a run goes on with the sequence before it. Splits of a file are read
    apart and lines one by one, so no sequence is ever one value."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "block", "k", "name", "bases", "n", "bytes", "head", "rows", "full", "width", "same", "last"]
        at, k, now, out = None, 0, None, []

        def close() -> None:
            nonlocal now, k
            if now is not None:
                name, lines, size, head, width = now
                full, last = (len(lines[0]), len(lines[-1])) if lines else (None, None)
                out.append((*at, k, name, "".join(lines), sum(map(len, lines)), size, head, len(lines), full, width, all(len(x) == full for x in lines[:-1]), last))
                now, k = None, k + 1

        for batch in batches:
            held = 0
            for value, file, block in zip(batch["value"], batch["file"], batch["block"], strict=True):
                if (file, block) != at:
                    close()
                    at, k = (file, block), 0
                if value.startswith(">"):
                    close()
                    words = value[1:].split()
                    now, held = [words[0] if words else "", [], len(value) + 1, len(value) + 1, None], 0
                    continue
                if now is None:
                    now, held = [None, [], 0, 0, None], 0
                line = value.rstrip("\r")
                now[1].append(line)
                now[2] += len(value) + 1
                now[4] = now[4] or len(value) + 1
                held += len(line)
                if held >= CHUNK:
                    close()
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    return lines.mapInPandas(scan, "file string, block long, k long, name string, bases string, n long, bytes long, head long, rows long, full long, width long, same boolean, last long")


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces without their bases, with the name and number of their sequence in the file, where
    they start in it, and the byte at which they start in the file. One row for CHUNK bases."""
    by = Window.partitionBy("file").orderBy("block", "k")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.drop("bases").withColumns({"seq": F.count("name").over(upto), "at": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "own": F.last("name", True).over(upto)}).filter("seq > 0")
    start = F.sum("n").over(Window.partitionBy("file", "seq").orderBy("block", "k").rowsBetween(Window.unboundedPreceding, -1))
    return rows.drop("name").withColumnRenamed("own", "name").withColumn("start", F.coalesce(start, F.lit(0)))


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(name, chunk, seq): the sequences in pieces of `chunk` bases, upper case as in the file.

    Lines are read in splits of the file, in time linear in its length; only the sizes of pieces
    are put in order, and bases go to their chunk at once."""
    pieces = _pieces(spark, path)
    rows = pieces.drop("name", "n").join(_placed(pieces).select("file", "block", "k", "name", "start", "n"), ["file", "block", "k"]).filter("n > 0")
    rows = rows.withColumn("chunk", F.explode_outer(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.col("n") - 1) / chunk))))
    lo = F.greatest(F.col("chunk") * chunk, F.col("start"))
    hi = F.least((F.col("chunk") + 1) * chunk, F.col("start") + F.col("n"))
    part = F.substring("bases", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    parts = rows.groupBy("name", "chunk").agg(F.array_sort(F.collect_list(F.struct("start", part.alias("s")))).alias("p"))
    return parts.select("name", "chunk", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("name").agg(F.sum(F.length("seq")).alias("length"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, offset, line_bases, line_bytes, ok), as in an index file: ok is false when
    lines before the last differ in length. One row per sequence, in the order of the file."""
    rows = _placed(_pieces(spark, path))
    own = Window.partitionBy("file", "seq").orderBy("block", "k")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"first": F.first("full", True).over(every), "end": F.max(F.when(F.col("rows") > 0, F.struct("block", "k"))).over(every)})
    final = (F.col("end.block") == F.col("block")) & (F.col("end.k") == F.col("k"))
    lead = (F.col("rows") == 1) | (F.col("full") == F.col("first")) & F.col("same")
    fits = (F.col("rows") == 0) | F.when(final, lead & (F.col("last") <= F.col("first"))).otherwise((F.col("full") == F.col("first")) & F.col("same") & (F.col("last") == F.col("first")))
    out = rows.groupBy("file", "seq").agg(
        F.first("name").alias("name"),
        F.sum("n").alias("length"),
        F.min(F.col("at") + F.col("head")).alias("offset"),
        F.coalesce(F.max("first"), F.lit(0)).alias("line_bases"),
        F.coalesce(F.min_by("width", F.when(F.col("rows") > 0, F.struct("block", "k"))), F.lit(0)).alias("line_bytes"),
        F.min(fits).alias("ok"),
    )
    return out.orderBy("file", "seq").drop("file", "seq")


def slices(places: DataFrame, chunks: DataFrame, start: str = "start", length: str = "len", chunk: int = CHUNK) -> DataFrame:
    """Places (chrom, start from 0, len, ...) with `bases`, cut at the ends of the sequence. Each
    place meets only the chunks it covers."""
    cols = places.columns
    own = places.withColumn("__id", F.monotonically_increasing_id()).filter(F.col(length) > 0).withColumn("__from", F.greatest(F.col(start), F.lit(0)))
    last = F.col("__from") + F.col(length) - (F.col("__from") - F.col(start)) - 1
    own = own.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__from") / chunk), F.floor(last / chunk))))
    both = own.join(chunks.withColumnRenamed("name", "chrom"), ["chrom", "chunk"])
    lo = F.greatest(F.col("__from") - F.col("chunk") * chunk, F.lit(0))
    hi = F.least(last - F.col("chunk") * chunk, F.lit(chunk - 1))
    part = F.substring("seq", (lo + 1).cast("int"), (hi - lo + 1).cast("int"))
    joined = both.groupBy("__id", *cols).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("s")))), lambda x: x["s"]), "").alias("bases"))
    return joined.drop("__id")


def chunked(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of rows (name, seq) that hold whole sequences."""
    rows = sequences.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / chunk))))
    return rows.select("name", "chunk", F.substring("seq", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("seq"))


def whole(chunks: DataFrame, name: str) -> DataFrame:
    """One sequence (name, seq) from its chunks."""
    own = chunks.filter(F.col("name") == name).groupBy("name")
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def first_with(chunks: DataFrame, prefix: str) -> str | None:
    """The name of the first sequence whose name begins so."""
    row = chunks.filter(F.col("name").startswith(prefix)).select("name").orderBy("name").first()
    return row["name"] if row else None
