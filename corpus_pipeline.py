"""A corpus from ``documents``: language ID, exact and near deduplication,
repeated passages, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` writes each stage's result as Parquet below the
shared checkpoint folder and reads it again as the next stage's documents. All
but the last return the columns of ``documents``.

Rows that repeat under one id: a stage's decision holds for the id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import exact_dedup, langid, packing, simhash, suffix_dedup
from winnow.llm.common import keep_once, read
from winnow.session import scratch_path

#: SQL cannot express language ID, the token ids or the packing; the stages are
#: tested against brute force.
ORACLE_SQL = None

#: Passages are found from this length on, in bytes, and cut if they have so many
#: words or 400 bytes: fifty short words come to about 160 bytes.
PASSAGE_BYTES = 160
PASSAGE_WORDS = 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: no letter, or two languages
    about equally near. ``lang`` stays as it was given."""
    return langid.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    found = exact_dedup.exact_dedup(docs)
    judged = found.select(F.col("doc_id").alias("k0"), F.col("text_sha256").alias("k1"),
                          F.col("n_code_points").alias("k2"), F.col("kept").alias("stays"))
    sha = F.sha2(F.encode(exact_dedup.normalised(F.col("text")), "utf-8"), 256)
    return keep_once(docs, judged, [F.col("doc_id"), sha, F.char_length(F.coalesce("text", F.lit("")))])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays;
    equal and NULL ids are told apart by their texts."""
    judged = simhash.near_survivors(docs).select(F.col("doc_id").alias("k0"), F.col("text_sha").alias("k1"), "stays")
    return keep_once(docs, judged, [F.col("doc_id"), simhash.text_sha(F.col("text"))])


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_WORDS`` words or of 400 bytes that repeat elsewhere go; a
    document keeps its row."""
    return suffix_dedup.without_repeats(docs, PASSAGE_BYTES, min_words=PASSAGE_WORDS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs, packing.byte_bpe_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
