"""Queries: job rows, keys, sample text, token report."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.text import with_extracted_text
from winnow.operators.bpe import bpe_tokenizer
from winnow.operators.report import token_estimate, token_report
from winnow.plans.common import EXTRACT_SQL, JOBS_SQL, jobs, recursive_sql, with_sql
from winnow.plans.q_bpe import PRETOKENS_SQL, learnt_sql, trained
from winnow.plans.registry import query
from winnow.session import scratch_path
from winnow.sources.jobs import given_sources, source_samples, union_sources
from winnow.sources.pulled import pull_source, pull_stream, pulled_jobs, write_splits
from winnow.sources.tables import read_table
from winnow.functions.keys import canonical_sample
from winnow.operators.index import group_index


@query("scan_sources", with_sql(JOBS_SQL, body="SELECT source_dataset, config, split, row_index, sample FROM jobs"))
def q_scan_sources(spark, sf_dir):
    return jobs(spark, sf_dir).drop("example_id")


def split_folders(spark, sf_dir):
    """The given tables as files of their splits: [(dataset, folder)]."""
    folders = []
    for source in given_sources(spark, sf_dir):
        path = scratch_path(spark, f"splits-{source.name}")
        write_splits(source, path)
        folders.append((source.name, path))
    return folders


PULLED_SQL = with_sql(JOBS_SQL, body="SELECT source_dataset, config, split, row_index, sample FROM jobs")


@query("pull_sources", PULLED_SQL)
def q_pull_sources(spark, sf_dir):
    """Every row of every config and split, pulled from files; positions come from the files."""
    return union_sources([pulled_jobs(pull_source(spark, path, name)) for name, path in split_folders(spark, sf_dir)])


@query("pull_stream", PULLED_SQL)
def q_pull_stream(spark, sf_dir):
    """The same by streams into one sink, each started twice: the second run finds nothing new."""
    out = scratch_path(spark, "pulled")
    for name, path in split_folders(spark, sf_dir):
        state = scratch_path(spark, "pulled-checkpoint")
        for _ in range(2):
            (pulled_jobs(pull_stream(spark, path, name)).writeStream.format("parquet")
             .option("checkpointLocation", state).option("path", f"{out}/{name}")
             .trigger(availableNow=True).start().awaitTermination())
    return union_sources([spark.read.parquet(f"{out}/{s.name}") for s in given_sources(spark, sf_dir)])


@query("canonical_sample", """
SELECT doc_id, to_json(struct_pack(doc_id := doc_id, lang := lang, n_chars := n_chars, source := source,
                                   text := text))::VARCHAR AS sample
FROM documents""")
def q_canonical_sample(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", canonical_sample(docs).alias("sample"))


@query("row_index", """
SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS row_index
FROM documents""")
def q_row_index(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return group_index(docs, ["source", "lang"], ["doc_id"], out="row_index")


@query("example_key", with_sql(JOBS_SQL, body="SELECT source_dataset, config, split, row_index, example_id FROM keyed"))
def q_example_key(spark, sf_dir):
    return jobs(spark, sf_dir).select("source_dataset", "config", "split", "row_index", "example_id")


@query("source_filter", with_sql(JOBS_SQL, body="""
SELECT source_dataset, config, split, row_index, example_id FROM keyed WHERE source_dataset IN ('conversations')"""))
def q_source_filter(spark, sf_dir):
    # The chosen dataset list is the feature: unselected sources are never scanned.
    return jobs(spark, sf_dir, chosen=["conversations"]).select(
        "source_dataset", "config", "split", "row_index", "example_id")


@query("union_sources", with_sql(JOBS_SQL, body="""
SELECT source_dataset, config, split, count(*) AS n_rows, max(row_index) AS max_row_index
FROM jobs GROUP BY source_dataset, config, split"""))
def q_union_sources(spark, sf_dir):
    return (jobs(spark, sf_dir).groupBy("source_dataset", "config", "split")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.max("row_index").alias("max_row_index")))


@query("extract_text", with_sql(JOBS_SQL, EXTRACT_SQL, body="SELECT example_id, text FROM extracted"))
def q_extract_text(spark, sf_dir):
    return with_extracted_text(jobs(spark, sf_dir), "sample", "text").select("example_id", "text")


REPORT_SQL = with_sql(JOBS_SQL, EXTRACT_SQL, body="""
SELECT rows, total_chars, total_chars / greatest(rows, 1) AS avg_chars_per_row,
       total_chars // 4 AS total_tokens, (total_chars // 4) / greatest(rows, 1) AS avg_tokens_per_row,
       (total_chars // 4) / greatest(total_chars, 1) AS tokens_per_char,
       raw_chars, raw_chars // 4 AS raw_token_estimate, 'chars4' AS tokenizer
FROM (SELECT count(*) AS rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_chars,
             CAST(coalesce(sum(length(sample)), 0) AS BIGINT) AS raw_chars FROM extracted)""")


def samples(spark, sf_dir):
    """All samples, un-numbered: a report needs no positions."""
    return source_samples(given_sources(spark, sf_dir))


@query("token_report", REPORT_SQL, bench=True)
def q_token_report(spark, sf_dir):
    return token_report(samples(spark, sf_dir), tokenizer="chars4")


@query("token_report_char", REPORT_SQL.replace("(total_chars // 4)", "total_chars").replace(
    "total_chars // 4 AS total_tokens", "total_chars AS total_tokens").replace("'chars4'", "'char'"))
def q_token_report_char(spark, sf_dir):
    return token_report(samples(spark, sf_dir), tokenizer="char")


# Chats are the messages joined by newlines, so their words differ from the messages' own.
@query("token_report_bpe", recursive_sql(JOBS_SQL, EXTRACT_SQL, f"""
job_words AS MATERIALIZED (
  SELECT word, count(*) AS times FROM (SELECT unnest({PRETOKENS_SQL}) AS word FROM extracted WHERE text <> '') GROUP BY word)""",
  learnt_sql("SELECT word FROM job_words"), body="""
SELECT rows, total_chars, total_chars / greatest(rows, 1) AS avg_chars_per_row,
       total_tokens, total_tokens / greatest(rows, 1) AS avg_tokens_per_row,
       total_tokens / greatest(total_chars, 1) AS tokens_per_char,
       raw_chars, raw_chars // 4 AS raw_token_estimate, 'tokenize' AS tokenizer
FROM (SELECT count(*) AS rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_chars,
             CAST(coalesce(sum(length(sample)), 0) AS BIGINT) AS raw_chars,
             (SELECT CAST(coalesce(sum(times * len(ids)), 0) AS BIGINT) FROM job_words JOIN word_ids USING (word)) AS total_tokens
      FROM extracted)"""))
def q_token_report_bpe(spark, sf_dir):
    """Tokens of the vocabulary trained on the conversations."""
    return token_report(samples(spark, sf_dir), tokenizer=bpe_tokenizer(*trained(spark, sf_dir)))


@query("token_estimate", with_sql(JOBS_SQL, EXTRACT_SQL, body="""
SELECT CAST(coalesce(sum(length(text)), 0) // 4 AS BIGINT) AS token_estimate,
       CAST(coalesce(sum(length(sample)), 0) // 4 AS BIGINT) AS raw_token_estimate FROM extracted"""))
def q_token_estimate(spark, sf_dir):
    return token_estimate(samples(spark, sf_dir))
