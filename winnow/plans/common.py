"""Shared building blocks of the registered queries (and their SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.sources.jobs import given_sources, scan_sources, with_example_id


def jobs(spark: SparkSession, sf_dir: str, chosen=None) -> DataFrame:
    """Job rows of documents and conversations, keyed."""
    return with_example_id(scan_sources(given_sources(spark, sf_dir), chosen=chosen))


# DuckDB: the same job rows. Documents: config = source, split = lang;
# conversations: one chat row per conv_id, config default, split train.
JOBS_SQL = r"""
jobs AS (
  SELECT 'documents' AS source_dataset, source AS config, lang AS split,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS row_index,
         to_json(struct_pack(doc_id := doc_id, lang := lang, n_chars := n_chars, source := source, text := text))::VARCHAR AS sample
  FROM documents
  UNION ALL
  SELECT 'conversations', 'default', 'train',
         row_number() OVER (ORDER BY conv_id) - 1,
         to_json(struct_pack(conv_id := conv_id, messages := msgs))::VARCHAR
  FROM (SELECT conv_id, list(struct_pack(content := text, role := role) ORDER BY turn) AS msgs
        FROM conversations GROUP BY conv_id)
),
keyed AS (
  SELECT *, concat_ws(chr(31), coalesce(CAST(source_dataset AS VARCHAR), 'None'),
                      coalesce(CAST(config AS VARCHAR), 'None'), coalesce(CAST(split AS VARCHAR), 'None'),
                      coalesce(CAST(row_index AS VARCHAR), 'None')) AS example_id
  FROM jobs
)"""

# DuckDB: plain text of each job's sample (documents -> text field;
# chats -> message contents joined by newline).
EXTRACT_SQL = r"""
extracted AS (
  SELECT k.*,
         CASE WHEN json_exists(sample, '$.messages')
              THEN array_to_string(list_transform(CAST(json_extract(sample, '$.messages') AS JSON[]),
                                                  lambda m: m ->> '$.content'), chr(10))
              ELSE sample ->> '$.text' END AS text
  FROM keyed k
)"""


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def recursive_sql(*ctes: str, body: str) -> str:
    return with_sql(*ctes, body=body).replace("WITH ", "WITH RECURSIVE ", 1)
