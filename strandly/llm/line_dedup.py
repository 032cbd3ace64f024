"""Line dedup across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, cut, fresh, let


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes, 128 bits of a line's key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with repeated lines taken out of the text, and n_lines, n_dropped.

    A line's key is the line without SPACE at both ends and with A-Z lower-cased. Keys of at
    least `min_chars` code points that at least `min_docs` documents hold lose their lines except
    in the smallest id that holds them. Null or empty text is one empty line, so a null text
    comes back as empty. Rows that repeat an id count as one document and keep their own text;
    null ids are one document that never is the smallest. All columns of `docs` come back; columns
    named n_lines or n_dropped are replaced. Empty tables give no rows.

    Keys are hashed and counted with map-side combining, so a line that a third of all documents
    hold is one row per task. The lines to drop are found by a join that is split at runtime
    where one key has very many rows, and go back to the documents as lists of positions.
    """
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("d"), mark.alias("t"), F.posexplode(F.split(lowered, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.length("line") >= min_chars).select("d", "t", "pos", *_hashes(F.col("line")))
    if min_docs == 2:
        held = rows.groupBy("h1", "h2").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max(F.col("d").isNull()).alias("unnamed"))
        held = held.filter("lo < hi or (lo is not null and unnamed)")
    else:
        held = rows.groupBy("h1", "h2", "d").agg(F.lit(1)).groupBy("h1", "h2").agg(F.min("d").alias("lo"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    held = fresh(cut(held.select("h1", "h2", "lo")), "h1", "h2")
    gone = rows.join(held.hint("merge"), ["h1", "h2"]).filter(~F.col("d").eqNullSafe(F.col("lo")))
    gone = gone.groupBy("d", "t").agg(F.collect_set("pos").alias("__gone"))
    left, right = docs.withColumn("__t", mark), gone.withColumnsRenamed({"d": "__d", "t": "__u"})
    joined = left.join(right.hint("shuffle_hash"), (F.col("__t") == F.col("__u")) & F.col(id_col).eqNullSafe(F.col("__d")), "left")
    lines = _lines(F.col(text_col))

    def rest(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")

    clean = F.when(F.col("__gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(let(lines, rest))
    counts = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    others = [F.col(c) for c in docs.columns if c not in (text_col, *counts)]
    return joined.select(*others, clean.alias(text_col), *[v.alias(k) for k, v in counts.items()])
