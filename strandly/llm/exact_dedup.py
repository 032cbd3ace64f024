"""Exact dedup with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Sketches are kept by the first hex digits of a digest, so that no task merges all of them.
BUCKETS, CANDIDATES, TRACKED = 64, 64, 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of SPACE; null counts as empty. Of
    equal texts the longest original (code points) stays, then the smallest id (null last), then
    one of the repeated rows.

    A frequent-items sketch (Misra-Gries family, error at most rows / TRACKED in a bucket) per
    digest bucket names at most BUCKETS * CANDIDATES digests. They are verified by an exact,
    map-side combined count; the winners (bounded by the same product) are broadcast and their
    rows leave without a shuffle. All other digests are counted with map-side combining and
    joined back by digest; no group of rows is brought together.

    Empty tables give no rows; other columns of `docs` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.translate(text, SPACE, ""), 256)).alias("digest"),
            F.length(text).cast("long").alias("n_chars"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid")))
    size = F.count(F.lit(1))
    named = (
        rows.groupBy(F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("b"))
        .agg(F.expr(f"approx_top_k(hex(digest), {CANDIDATES}, {TRACKED})").alias("top"))
        .select(F.explode("top").alias("t"))
        .select(F.unhex("t.item").alias("digest"))
    )
    hot = cut(rows.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(best.alias("best"), size.alias("group_size")).filter("group_size > 1"))
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(best.alias("best"), size.alias("group_size")).filter("group_size > 1")
    alone = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"))
    cold = cold.join(groups, "digest", "left").withColumns({"best": F.coalesce("best", alone), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    both = rows.join(F.broadcast(hot), "digest").select(cold.columns).unionAll(cold)
    return both.select(
        F.col("doc_id").alias(id_col),
        F.col("best.keep_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("best.keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
