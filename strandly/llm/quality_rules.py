"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio, in DataFrame operations."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, SPACE_RE, UPPER, cut, let, with_ids

#: Runs of letters, digits and underscores, or runs of other signs.
PARTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SYMBOLS = "#*$%&|<>"
#: Cells that n-grams are hashed to, and the mean log-likelihood ratio from which a document stays:
#: in the gap between labelled documents that pass the base rules, good ones (99.9 % above -0.01 at
#: sf0.1) and low-quality ones (99 % below -0.87).
CELLS, THRESHOLD = 16_384, -0.35


def _grams(text: Column, cells: int) -> Column:
    """Cells of the unigrams and bigrams of a text's parts."""
    cell = lambda *x: F.pmod(F.xxhash64(*x), F.lit(cells)).cast("int")

    def of(t: Column) -> Column:
        pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: cell(F.get(t, i), x))
        return F.concat(F.transform(t, lambda x: cell(x)), pairs)

    return let(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(PARTS), F.lit(0)), of)


def llr_table(docs: DataFrame, trusted: DataFrame, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Per cell log p(cell | trusted) - log p(cell | raw), both with one added to each cell.

    Counts cover every document; they are combined on the map side to `cells` rows a task, and
    `cells` rows reach the driver."""
    flagged = trusted.select(F.col(id_col).alias("__id")).distinct().withColumn("__good", F.lit(1))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = with_ids(rows, cut(flagged), "left")
    grams = rows.select(F.coalesce("__good", F.lit(0)).alias("good"), F.explode(_grams(F.col("__text"), cells)).alias("cell"))
    counts = grams.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = [1] * cells, [1] * cells
    for r in counts:
        raw[r["cell"]] += r["raw"]
        good[r["cell"]] += r["good"]
    a, b = math.log(sum(good)), math.log(sum(raw))
    return [math.log(g) - a - math.log(n) + b for g, n in zip(good, raw, strict=True)]


def _repeats(w: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more. Windows are compared by 64-bit
    hashes, sorted with their places, so very long texts stay n log n."""

    def marked(s: Column) -> Column:
        at = lambda j: F.get(s, j)["h"]
        again = F.filter(s, lambda x, j: at(j - 1).eqNullSafe(x["h"]) | at(j + 1).eqNullSafe(x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        found = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    def hashed(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(let(w, hashed), count)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept.

    `trusted` names the documents (by id) that the target distribution is counted on; the raw one
    is counted on all of `docs`. score is the mean log-likelihood ratio of a document's n-grams
    (null without any). kept is false for base_failed, else score >= threshold, for every
    document alike. Null text has no words; other columns are not read; with no trusted document
    all ratios favour rare cells and the rules still give a verdict. Empty tables give no rows."""
    table = llr_table(docs, trusted, cells, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = F.filter(F.split(text, SPACE_RE), lambda x: x != F.lit(""))
    found = lambda signs: F.regexp_count(text, F.lit(f"[{signs}]"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    # a constant that the optimizer evaluates once
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    long = lambda c: c.cast("long")
    rows = docs.select(
        F.col(id_col),
        w.alias("w"),
        long(F.length(text) - found(r"\x20\x09-\x0D")).alias("word_chars"),
        long(found(SYMBOLS)).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        _grams(text, cells).alias("g"),
    )
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + F.get(ratios, x))
    rows = rows.select(
        id_col,
        long(F.size("w")).alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        long(_repeats(F.col("w"))).alias("n_repeat_words"),
        (total / F.nullif(F.size("g"), F.lit(0))).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
