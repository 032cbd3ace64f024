"""The registered queries of the ten operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .common import read
from .exact_dedup import exact_dedup
from .html_extract import extract
from .jaccard_join import jaccard_join
from .kneser_ney import classify
from .line_dedup import line_dedup
from .mixing import Targets, mix
from .quality_rules import quality_rules
from .secrets import find_secrets
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe_decode(bpe_encode(read(spark, sf_dir, "documents"), path, ["doc_id"]), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled good and not toxic."""
    return read(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


#: Weights by domain, then language, then source; sources weigh the same.
MIXTURE = Targets(
    weights={
        (): {"web": 0.45, "books": 0.25, "news": 0.2, "code": 0.1},
        ("*",): {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1, "?": 0.05},
    },
    other=0.05,
)


def domain() -> Column:
    """A source's domain: its trailing number modulo four; "web" without one."""
    number = F.try_to_number(F.regexp_extract(F.col("source"), r"(\d{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.get(F.array(*map(F.lit, ("web", "books", "news", "code"))), F.pmod(number, F.lit(4)).cast("int")), F.lit("web"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules(read(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(read(spark, sf_dir, "documents"), MIXTURE, domain())
    return done.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = find_secrets(read(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str) -> Callable[[Column], Column]:
        return lambda x: x["kind"] == kind

    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return done.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_base_random")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_quality_rules, op4_html_extract, op5_line_dedup, op6_jaccard_join, op7_token_counts, op8_quality_classifier, op9_secrets, op10_mixing)}

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id)""",
    "op6_jaccard_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) p
          JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 75 * (m.n + o.n - c)),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
        FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        d AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        f AS (SELECT k.*, d.lo IS NOT NULL AND d.lo <> k.doc_id AS gone FROM k LEFT JOIN d USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
}
