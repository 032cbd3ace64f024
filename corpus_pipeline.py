"""A training-data pipeline over `documents`: five of the operators, one after another."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandly.llm.bpe import bpe_decode, bpe_encode
from strandly.llm.common import cut, read, with_ids
from strandly.llm.jaccard_join import jaccard_join
from strandly.llm.kneser_ney import classify
from strandly.llm.line_dedup import line_dedup
from strandly.llm.mixing import mix
from strandly.llm.queries import MIXTURE, domain, trusted

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Rows that repeat an id stand or fall together (they
    stay if one of them does); rows without an id stay."""
    found = classify(docs, trusted(spark, sf_dir))
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    return with_ids(docs, cut(gone), "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds; n_chars follows the text."""
    done = line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id; of rows that repeat an
    id one stays. Rows without an id stay."""
    found = cut(jaccard_join(docs))
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    left = with_ids(docs, cut(gone), "left_anti")
    again = cut(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return with_ids(left, again, "left_anti").unionAll(with_ids(left, again, "left_semi").dropDuplicates(["doc_id"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mix(docs, MIXTURE, domain()).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, and the digest of the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe_decode(bpe_encode(docs, path, ["doc_id", "lang", "source"]), path)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("bpe", tokens),
]
#: SQL has no language model and no tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i < len(STAGES) - 1 else docs
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
