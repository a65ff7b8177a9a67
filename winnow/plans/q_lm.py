"""Queries: count model over train blocks, scores and metrics on the holdout."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import blocks as B
from winnow.operators import bpe
from winnow.operators import lm as M
from winnow.operators import split as S
from winnow.plans.common import recursive_sql, with_sql
from winnow.plans.q_bpe import ENCODED_SQL, learnt_sql, trained
from winnow.plans.q_tokens import HOLDOUT_SQL, MASKED_SQL, SEGMENTS_SQL, blocks, splits
from winnow.plans.registry import query
from winnow.session import materialize
from winnow.sources.tables import read_table

A = M.ALPHA


def lm_sql(vocab_size: int) -> str:
    return f"""
tok AS (SELECT conv_id, block_no, CAST(unnest(range(64)) AS INTEGER) AS pos, unnest(xs) AS x, unnest(ys) AS y
        FROM blocks),
ttok AS (SELECT t.*, s.split FROM tok t JOIN splits s USING (conv_id) WHERE y <> -100),
pairs AS (SELECT x, y, count(*) AS n FROM ttok WHERE split = 'train' GROUP BY x, y),
uni AS (SELECT y, sum(n) AS cy FROM pairs GROUP BY y),
tot AS (SELECT coalesce(sum(cy), 0) AS "N" FROM uni),
u AS (SELECT y, cy, (cy + 1) / ("N" + {vocab_size}) AS u FROM uni, tot),
ctx AS (SELECT x, sum(n) AS cx FROM pairs GROUP BY x),
ustar AS (SELECT y AS y_star, u AS u_star FROM u ORDER BY u DESC, y ASC LIMIT 1),
scored AS (SELECT p.x, p.y, p.n + CAST({A} AS DOUBLE) * u.u AS s FROM pairs p JOIN u USING (y)),
bestpair AS (SELECT x, y, s FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y ASC) AS rn
                                  FROM scored) WHERE rn = 1),
best AS (SELECT b.x, CASE WHEN b.s > CAST({A} AS DOUBLE) * us.u_star
                            OR (b.s = CAST({A} AS DOUBLE) * us.u_star AND b.y <= us.y_star)
                          THEN b.y ELSE us.y_star END AS best
         FROM bestpair b, ustar us),
sc AS (
  SELECT v.conv_id, v.block_no, v.pos, v.x, v.y,
         round(ln((coalesce(p.n, 0) + CAST({A} AS DOUBLE) * coalesce(u.u, 1.0 / (tot."N" + {vocab_size})))
                  / (coalesce(c.cx, 0) + CAST({A} AS DOUBLE))), 9) AS logp,
         coalesce(b.best, us.y_star) AS guess, coalesce(b.best, us.y_star) = v.y AS correct
  FROM (SELECT * FROM ttok WHERE split = 'val') v
  LEFT JOIN pairs p ON p.x = v.x AND p.y = v.y
  LEFT JOIN ctx c ON c.x = v.x
  LEFT JOIN u ON u.y = v.y
  LEFT JOIN best b ON b.x = v.x
  CROSS JOIN tot CROSS JOIN ustar us
),
vb AS (
  SELECT b.conv_id, b.block_no, (row_number() OVER (ORDER BY b.conv_id, b.block_no) - 1) // {M.EVAL_BATCH} AS batch_id
  FROM blocks b JOIN splits s USING (conv_id) WHERE s.split = 'val'
),
bt AS (SELECT conv_id, block_no, count(*) AS nt, sum(-logp) AS nll FROM sc GROUP BY ALL),
pb AS (
  SELECT batch_id, count(*) AS n_seq, coalesce(sum(nt), 0) AS n_targets, sum(nll) / sum(nt) AS batch_loss
  FROM vb LEFT JOIN bt USING (conv_id, block_no) GROUP BY batch_id
)"""

CTES = (SEGMENTS_SQL, HOLDOUT_SQL, lm_sql(M.VOCAB_SIZE))

# The same on BPE ids.
BPE_SEGMENTS_SQL = """
msgs AS (SELECT conv_id, turn, role, ids FROM encoded WHERE text IS NOT NULL AND text <> ''),""" + MASKED_SQL
BPE_CTES = (learnt_sql(), ENCODED_SQL, BPE_SEGMENTS_SQL)


METRICS_SQL = """
SELECT count(*) AS n_tokens, round(coalesce(sum(-logp), 0) / greatest(1, count(*)), 9) AS loss,
       round(exp(coalesce(sum(-logp), 0) / greatest(1, count(*))), 9) AS perplexity,
       round(count(*) FILTER (WHERE correct) / greatest(1, count(*)), 9) AS accuracy
FROM sc"""


def blocks_with_split(spark, sf_dir):
    lengths = B.message_lengths(read_table(spark, sf_dir, "conversations"))
    return S.with_split(blocks(spark, sf_dir), splits(spark, sf_dir), lengths, "conv_id")


def model(spark, sf_dir):
    """(target tokens with their split, fitted model). Training tokens go
    straight into the pair counts and are never stored; the counts - bounded by
    the vocabulary squared - are written once."""
    t = M.block_tokens(blocks_with_split(spark, sf_dir), keep=["split"])
    pairs = materialize(M.lm_counts(t.where(F.col("split") == "train")), "lm_pairs")
    return t, M.fit_count_model(pairs)


def scored(spark, sf_dir):
    t, fitted = model(spark, sf_dir)
    return M.lm_score(t.where(F.col("split") == "val").drop("split"), fitted)


def bpe_segments(spark, sf_dir):
    """Masked segments on BPE ids, from one pass of the trained tokenizer."""
    vocab, merges = trained(spark, sf_dir)
    return B.role_mask(read_table(spark, sf_dir, "conversations"), tokenize=bpe.bpe_tokenizer(vocab, merges))


@query("role_mask_bpe", recursive_sql(*BPE_CTES, body="""
SELECT conv_id, turn, role, seg_ids, seg_mask, seg_len, "offset" FROM segments"""))
def q_role_mask_bpe(spark, sf_dir):
    return bpe_segments(spark, sf_dir)


@query("make_blocks_bpe", recursive_sql(*BPE_CTES, body="SELECT conv_id, block_no, xs, ys FROM blocks"))
def q_make_blocks_bpe(spark, sf_dir):
    return B.make_blocks(bpe_segments(spark, sf_dir))


@query("lm_metrics_bpe", recursive_sql(*BPE_CTES, HOLDOUT_SQL, lm_sql(bpe.VOCAB_SIZE), body=METRICS_SQL))
def q_lm_metrics_bpe(spark, sf_dir):
    """The count model on BPE blocks: training pairs, validation loss."""
    # Ids are made once: both the blocks and the examples' lengths read them.
    seg = materialize(bpe_segments(spark, sf_dir), "bpe_segments")
    tagged = S.with_split(B.make_blocks(seg), splits(spark, sf_dir), B.segment_lengths(seg), "conv_id")
    t = M.block_tokens(tagged, keep=["split"])
    pairs = materialize(M.lm_counts(t.where(F.col("split") == "train")), "lm_pairs_bpe")
    fitted = M.fit_count_model(pairs, vocab_size=bpe.VOCAB_SIZE)
    return M.lm_metrics(M.lm_score(t.where(F.col("split") == "val").drop("split"), fitted))


def val_blocks(spark, sf_dir):
    return blocks_with_split(spark, sf_dir).where(F.col("split") == "val").drop("split")


@query("lm_counts", with_sql(*CTES, body="SELECT x, y, n FROM pairs"))
def q_lm_counts(spark, sf_dir):
    return model(spark, sf_dir)[1]["pairs"]


@query("lm_score", with_sql(*CTES, body="SELECT conv_id, block_no, pos, x, y, logp, guess, correct FROM sc"))
def q_lm_score(spark, sf_dir):
    return scored(spark, sf_dir)


@query("lm_metrics", with_sql(*CTES, body=METRICS_SQL), bench=True)
def q_lm_metrics(spark, sf_dir):
    return M.lm_metrics(scored(spark, sf_dir))


@query("val_loss_by_sequence", with_sql(*CTES, body="""
SELECT count(*) AS n_batches,
       round(coalesce(sum(batch_loss * n_seq) / greatest(1, sum(n_seq)), 0), 9) AS val_loss
FROM pb WHERE n_targets > 0"""))
def q_val_loss_by_sequence(spark, sf_dir):
    return M.val_loss_by_sequence(val_blocks(spark, sf_dir), scored(spark, sf_dir))


@query("best_checkpoint", with_sql(*CTES, body="""
SELECT step, val_loss, best_before, best_before IS NULL OR val_loss < best_before AS saved
FROM (SELECT batch_id AS step, round(batch_loss, 9) AS val_loss,
             min(round(batch_loss, 9)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS best_before
      FROM pb WHERE n_targets > 0)"""))
def q_best_checkpoint(spark, sf_dir):
    per_batch = M.batch_losses(val_blocks(spark, sf_dir), scored(spark, sf_dir)).where(F.col("n_targets") > 0)
    # The evaluation log: one row per evaluation, written once.
    metrics = materialize(per_batch.select(F.col("batch_id").alias("step"),
                                           F.round("batch_loss", 9).alias("val_loss")), "lm_eval_log")
    return M.best_checkpoint(metrics)


@query("topk_next", with_sql(*CTES, body=f"""
SELECT x, y, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank, round(w / sum(w) OVER (PARTITION BY x), 9) AS prob
FROM (SELECT x, y, n, rank, pow(n / sum(n) OVER (PARTITION BY x), {1.0 / M.TEMPERATURE}) AS w
      FROM (SELECT x, y, n, rank() OVER (PARTITION BY x ORDER BY n DESC) AS rank
            FROM (SELECT x, y, n FROM pairs UNION ALL SELECT -1 AS x, y, sum(n) AS n FROM pairs GROUP BY y))
      WHERE rank <= {M.TOP_K})"""))
def q_topk_next(spark, sf_dir):
    return M.topk_next(model(spark, sf_dir)[1]["pairs"], M.TOP_K, M.TEMPERATURE)


@query("greedy_next", with_sql(*CTES, body="""
SELECT x, y AS next FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY n DESC, y ASC) AS rn FROM pairs)
WHERE rn = 1"""))
def q_greedy_next(spark, sf_dir):
    return M.greedy_next(model(spark, sf_dir)[1]["pairs"])


GENERATE_SQL = f"""
topk AS (
  SELECT x, y, round(w / sum(w) OVER (PARTITION BY x), 9) AS prob
  FROM (SELECT x, y, rank, pow(n / sum(n) OVER (PARTITION BY x), {1.0 / M.TEMPERATURE}) AS w
        FROM (SELECT x, y, n, rank() OVER (PARTITION BY x ORDER BY n DESC) AS rank
              FROM (SELECT x, y, n FROM pairs UNION ALL SELECT -1 AS x, y, sum(n) AS n FROM pairs GROUP BY y))
        WHERE rank <= {M.TOP_K})),
upto AS MATERIALIZED (
  SELECT x, list(struct_pack(y := y, upto := upto) ORDER BY y) AS cands
  FROM (SELECT x, y, sum(prob) OVER (PARTITION BY x ORDER BY y ROWS UNBOUNDED PRECEDING) AS upto FROM topk) GROUP BY x),
prompts AS (
  SELECT conv_id || ':' || turn AS prompt_id, coalesce(text, '') AS prompt,
         list_transform(string_split(coalesce(text, ''), ''), lambda c: CAST(unicode(c) + 4 AS INTEGER)) AS all_ids
  FROM conversations WHERE role = 'user'),
started AS (
  SELECT prompt_id, CASE WHEN prompt = '' THEN [1] ELSE all_ids[-64:] END AS ids FROM prompts),
gen AS (
  SELECT prompt_id, ids, 64 - len(ids) AS togo, 0 AS step FROM started
  UNION ALL
  SELECT prompt_id, list_append(ids, nxt), CASE WHEN nxt = 1 THEN 0 ELSE togo - 1 END, step + 1
  FROM (SELECT g.prompt_id, g.ids, g.togo, g.step,
               coalesce(list_filter(coalesce(k.cands, b.cands), lambda c: g.u < c.upto)[1].y,
                        coalesce(k.cands, b.cands)[-1].y, 1) AS nxt
        FROM (SELECT *, CAST('0x' || substr(md5(prompt_id || ':' || step || ':42'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
              FROM gen WHERE togo > 0) g
        LEFT JOIN upto k ON k.x = g.ids[-1] LEFT JOIN upto b ON b.x = -1)),
finished AS (SELECT prompt_id, ids FROM gen WHERE togo <= 0)"""


@query("generate_batch", recursive_sql(*CTES, GENERATE_SQL, body="""
SELECT prompt_id, array_to_string(list_transform(list_filter(ids, lambda i: i >= 4), lambda i: chr(i - 4)), '') AS output
FROM finished"""))
def q_generate_batch(spark, sf_dir):
    """Every user turn continued by the count model (seeded draws)."""
    pairs = model(spark, sf_dir)[1]["pairs"]
    conv = read_table(spark, sf_dir, "conversations")
    prompts = (conv.where(F.col("role") == "user")
               .select(F.concat_ws(":", "conv_id", "turn").alias("prompt_id"), F.col("text").alias("prompt")))
    return M.generate_batch(prompts, M.topk_next(pairs, M.TOP_K, M.TEMPERATURE), seed=42)
