"""The registered queries: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.centroids import cluster
from tidelog.llm.common import table
from tidelog.llm.decontam import contaminated
from tidelog.llm.lang_id import identify
from tidelog.llm.lexical import search
from tidelog.llm.license_scan import license_spans
from tidelog.llm.near_dups import NearDups, near_duplicates
from tidelog.llm.order_minhash import as_text, compare_edited
from tidelog.llm.piece_codec import digests
from tidelog.llm.quality import quality_scores
from tidelog.llm.secret_scan import KINDS, secret_spans, span_text
from tidelog.llm.token_counts import token_counts
from tidelog.llm.topk_search import exact_top_k
from tidelog.llm.warc import derivatives, responses

PIECES = "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[number(kind) for kind in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op4_contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDups(words=2))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=["doc_id"])


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_license_spans,
        op3_secret_spans,
        op4_contaminated_documents,
        op5_near_duplicates,
        op6_token_counts,
        op7_order_minhash,
        op8_quality_scores,
        op9_warc_derivatives,
        op10_piece_codec,
        op11_exact_top_k,
        op12_centroids,
        op13_ranked_search,
    )
}
