"""From raw documents to encoded training text: language, near-duplicates, benchmark, secrets, pieces.

Each stage is a function of (spark, docs, sf_dir) that works on all rows the one before it kept. All but the
last return the columns of documents. run() writes each stage's rows and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bloom import bloom_of
from tidelog.llm.common import settled, table
from tidelog.llm.decontam import contaminated
from tidelog.llm.lang_id import UNKNOWN, predict, train
from tidelog.llm.near_dups import near_duplicates
from tidelog.llm.piece_codec import encode
from tidelog.llm.secret_scan import redacted

#: A text that takes this many bits per byte in every known language is in none of them: it is no shorter than
#: its own bytes.
MOST_BITS = 8.0
MASK = "<secret>"


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter or in no known language; the others get the language found.

    Without any labelled row no language is known, and all texts stay as they are.
    """
    trees = train(docs, F.lit(True))
    if not trees.langs:
        return docs
    found = predict(docs, trees, keep=docs.columns)
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS)
    return found.where(known).select(
        *[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns]
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near-duplicates (five words, 0.8), any one of those with that
    id or, if there is no id in the group, any one of all."""
    # Made once and stored: a row without an id or with a repeated one can be told by it.
    docs = settled(docs.withColumn("_row", F.monotonically_increasing_id()), compression="snappy")
    groups = near_duplicates(docs, id_col="_row").select("_row", "component_id")
    rows = settled(groups.join(docs.select("_row", "doc_id"), "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    first = rows.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = rows.join(first, "component_id").where("_row != first._row").select("_row")
    return docs.join(settled(dropped), "_row", "left_anti").select(*[c for c in _columns(docs) if c != "`_row`"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows with a passage of the benchmark. That depends on the text alone, so it is the text's digest that is
    reported and compared: ids may be missing or repeated."""
    own = F.struct(F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("digest"))
    found = contaminated(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = settled(found.select("doc_id.key", F.col("doc_id.digest").alias("found")).distinct())
    # Rows that a filter of bounded size rules out are not among those found: they stay where they are.
    suspect = F.expr(bloom_of(found.select("key").distinct()).passes("xxhash64(text)"))
    checked = docs.where(suspect).join(found.select("found"), F.sha2(docs["text"], 256) == F.col("found"), "left_anti")
    return docs.where(~suspect).unionByName(checked).select(*_columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by MASK; n_chars follows the text."""
    masked = redacted(docs, MASK)
    return masked.select(
        *[
            F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text and whether they decode to it."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("pieces", pieces),
]

#: SQL can express neither code lengths of context trees nor piece merges; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
