"""Queries: messages, role masks, training blocks, holdout, token limits.

Chats are the ``conversations`` table (one example per conv_id, messages in
turn order); tokens come from the character tokenizer (id = 4 + code point),
which DuckDB can state too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.tokens import char_ids
from winnow.operators import blocks as B
from winnow.operators import split as S
from winnow.operators.classify import classify_prompt
from winnow.plans.common import JOBS_SQL, jobs, with_sql
from winnow.plans.q_classify import sql_str
from winnow.operators.classify import SAMPLE_INTRO, SYSTEM_PROMPT
from winnow.plans.registry import query
from winnow.sources.jobs import given_sources, source_samples
from winnow.sources.tables import read_table

PROMPT_TOKEN_LIMIT = 2048

# DuckDB: masked segments and blocks of messages (``msgs``) with their ids.
MASKED_SQL = r"""
segs AS (
  SELECT conv_id, turn, role,
         CASE role WHEN 'user' THEN list_concat([1], ids) WHEN 'assistant' THEN list_concat(ids, [2])
                   ELSE ids END AS seg_ids,
         CASE role WHEN 'user' THEN list_transform(range(len(ids) + 1), lambda x: -100)
                   WHEN 'assistant' THEN list_transform(range(len(ids) + 1), lambda x: 1)
                   ELSE list_transform(range(len(ids)), lambda x: -100) END AS seg_mask
  FROM msgs
),
segments AS (
  SELECT *, CAST(len(seg_ids) AS INTEGER) AS seg_len,
         CAST(coalesce(sum(len(seg_ids)) OVER (PARTITION BY conv_id ORDER BY turn
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           AS "offset"
  FROM segs
),
ex AS (
  SELECT conv_id, flatten(list(seg_ids ORDER BY turn)) AS ids, flatten(list(seg_mask ORDER BY turn)) AS mask
  FROM segments GROUP BY conv_id
),
starts AS (SELECT conv_id, ids, mask, unnest(range(0, len(ids), 64)) AS s FROM ex),
blocks AS (
  SELECT conv_id, s // 64 AS block_no,
         list_resize(ids[s + 1 : s + 64], 64, 0) AS xs,
         list_transform(range(1, 65), lambda k: CASE WHEN s + k < len(ids) AND mask[s + k + 1] = 1
                                                     THEN ids[s + k + 1] ELSE -100 END) AS ys
  FROM starts WHERE s + 1 < len(ids)
)"""

SEGMENTS_SQL = r"""
msgs AS (
  SELECT conv_id, turn, role, list_transform(string_split(text, ''), lambda c: unicode(c) + 4) AS ids
  FROM conversations WHERE text IS NOT NULL AND text <> ''
),""" + MASKED_SQL

HOLDOUT_SQL = r"""
examples AS (SELECT DISTINCT conv_id FROM conversations),
ranked AS (
  SELECT conv_id, row_number() OVER (ORDER BY md5(CAST(conv_id AS VARCHAR) || ':42'), conv_id) - 1 AS shuffle_pos
  FROM examples
),
nval AS (SELECT greatest(1, floor(count(*) * CAST(0.02 AS DOUBLE))) AS n_val FROM examples),
splits AS (
  SELECT conv_id, shuffle_pos, CASE WHEN shuffle_pos < n_val THEN 'val' ELSE 'train' END AS split
  FROM ranked, nval
)"""


def segments(spark, sf_dir):
    return B.role_mask(read_table(spark, sf_dir, "conversations"))


def blocks(spark, sf_dir):
    return B.make_blocks(segments(spark, sf_dir))


def splits(spark, sf_dir):
    examples = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return S.holdout_split(examples, "conv_id", seed=S.SEED, ratio=S.VAL_RATIO)


@query("explode_messages", with_sql(JOBS_SQL, body="""
SELECT k.example_id, CAST(c.pos AS INTEGER) AS pos, c.role, c.text AS content
FROM keyed k
JOIN (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
      FROM conversations) c
  ON k.source_dataset = 'conversations'
 AND k.row_index = (SELECT count(DISTINCT conv_id) FROM conversations c2 WHERE c2.conv_id < c.conv_id)
WHERE c.text <> ''"""))
def q_explode_messages(spark, sf_dir):
    recs = jobs(spark, sf_dir, chosen=["conversations"])
    return B.explode_messages(recs)


@query("span_count", "SELECT count(*) AS n_spans FROM conversations WHERE text IS NOT NULL AND text <> ''")
def q_span_count(spark, sf_dir):
    # Document rows have no messages and add none; a count needs no positions.
    recs = source_samples(given_sources(spark, sf_dir))
    return B.explode_messages(recs, key="source_dataset").agg(F.count(F.lit(1)).alias("n_spans"))


@query("role_mask", with_sql(SEGMENTS_SQL, body="""
SELECT conv_id, turn, role, seg_ids, seg_mask, seg_len, "offset" FROM segments"""))
def q_role_mask(spark, sf_dir):
    return segments(spark, sf_dir)


@query("make_blocks", with_sql(SEGMENTS_SQL, body="SELECT conv_id, block_no, xs, ys FROM blocks"), bench=True)
def q_make_blocks(spark, sf_dir):
    return blocks(spark, sf_dir)


@query("drop_untrainable", with_sql(SEGMENTS_SQL, body="""
SELECT conv_id, block_no, xs, ys FROM blocks WHERE list_bool_or(list_transform(ys, lambda y: y <> -100))"""))
def q_drop_untrainable(spark, sf_dir):
    return B.drop_untrainable(blocks(spark, sf_dir))


# Lengths of examples when every fourth conversation's texts are blanked.
LENGTHS_SQL = """
lengths AS (
  SELECT e.conv_id, CAST(coalesce(l.n_ids, 0) AS BIGINT) AS n_ids
  FROM (SELECT DISTINCT conv_id FROM conversations) e
  LEFT JOIN (SELECT conv_id, sum(seg_len) AS n_ids FROM segments WHERE conv_id % 4 <> 2 GROUP BY conv_id) l USING (conv_id))"""


def lengths(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    blanked = conv.withColumn("text", F.when(F.col("conv_id") % 4 == 2, F.lit("")).otherwise(F.col("text")))
    return B.example_lengths(conv.select("conv_id"), B.role_mask(blanked))


@query("drop_empty_examples", with_sql(SEGMENTS_SQL, LENGTHS_SQL, body="SELECT conv_id, n_ids FROM lengths WHERE n_ids > 0"))
def q_drop_empty_examples(spark, sf_dir):
    return B.drop_empty_examples(lengths(spark, sf_dir))


@query("holdout_split", with_sql(HOLDOUT_SQL, body="SELECT conv_id, shuffle_pos, split FROM splits"))
def q_holdout_split(spark, sf_dir):
    return splits(spark, sf_dir)


@query("eval_sample", with_sql(SEGMENTS_SQL, LENGTHS_SQL, HOLDOUT_SQL, body=f"""
SELECT conv_id, shuffle_pos, split, n_ids FROM splits JOIN lengths USING (conv_id)
WHERE split = 'val' AND n_ids > 0 ORDER BY shuffle_pos LIMIT {S.EVAL_EXAMPLES}"""))
def q_eval_sample(spark, sf_dir):
    return S.eval_sample(splits(spark, sf_dir).join(lengths(spark, sf_dir), "conv_id"), S.EVAL_EXAMPLES, "n_ids")


@query("split_counts", with_sql(SEGMENTS_SQL, HOLDOUT_SQL, body="""
SELECT s.split, count(*) AS n_examples,
       coalesce(max(b.n_blocks), 0) AS n_blocks
FROM splits s
LEFT JOIN (SELECT sp.split, count(*) AS n_blocks FROM blocks bl JOIN splits sp USING (conv_id) GROUP BY sp.split) b
  ON s.split = b.split
GROUP BY s.split"""))
def q_split_counts(spark, sf_dir):
    lengths = B.message_lengths(read_table(spark, sf_dir, "conversations"))
    return S.split_counts(splits(spark, sf_dir), lengths, "conv_id")


@query("truncate_tokens", with_sql(JOBS_SQL, body=f"""
SELECT example_id,
       list_slice(list_transform(string_split({sql_str(SYSTEM_PROMPT)} || {sql_str(SAMPLE_INTRO)} || sample, ''),
                                 lambda c: unicode(c) + 4), 1, {PROMPT_TOKEN_LIMIT}) AS ids
FROM keyed"""))
def q_truncate_tokens(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return j.select("example_id", B.truncate_tokens(char_ids(classify_prompt("sample")), PROMPT_TOKEN_LIMIT)
                    .alias("ids"))
