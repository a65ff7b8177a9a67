"""Count language model over training blocks: counts, scores, metrics, sampling.

The neural model is replaced by counts: (previous token -> target) pairs and
target unigrams over train blocks, targets = -100 excluded. A target ``y``
after context ``x`` has probability

    p(y | x) = (c(x, y) + alpha * u(y)) / (c(x) + alpha),
    u(y)     = (c(y) + 1) / (N + V)

(Dirichlet smoothing towards an add-one unigram over a V-token vocabulary),
so every token has a probability and an unseen context falls back to u.
The best guess for ``x`` is the argmax of the numerator - among the seen
successors of ``x`` and the best unigram token; ties go to the lowest id.

All tables are aggregates with map-side partial combine; scoring is
equi-joins of validation tokens to them (AQE picks broadcast when they are
small and splits skewed partitions when a context is hot).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.tokens import BLOCK_LEN, BOS_ID, CHAR_ID_OFFSET, IGNORE_ID, char_ids
from winnow.operators.index import group_index, group_running
from winnow.session import materialize

# Ids of the character tokenizer: special ids and every code point. Callers
# with another tokenizer pass its size, so that p(. | x) sums to 1.
VOCAB_SIZE = CHAR_ID_OFFSET + 0x110000
# Sampling defaults (temperature, top-k), evaluation batch size.
ALPHA = 1.0
TEMPERATURE = 0.8
TOP_K = 40
EVAL_BATCH = 8


def block_tokens(blocks: DataFrame, key: str = "conv_id", keep=()) -> DataFrame:
    """(key, block_no, pos, x, y, *keep) for every target that counts (y != -100)."""
    keep = list(keep)
    z = blocks.select(key, "block_no", *keep, F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "t"))
    return (z.select(key, "block_no", F.col("pos").cast("int").alias("pos"),
                     F.col("t.xs").alias("x"), F.col("t.ys").alias("y"), *keep)
             .where(F.col("y") != IGNORE_ID))


def lm_counts(train_tokens: DataFrame) -> DataFrame:
    """(x, y, n): how often ``y`` followed ``x`` in training targets."""
    return train_tokens.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def fit_count_model(pairs: DataFrame, vocab_size: int = VOCAB_SIZE, alpha: float = ALPHA,
                    persist=None) -> dict:
    """The fitted model as tables: ``pairs`` (x, y, n), ``ctx`` (x, cx),
    ``uni`` (y, u), ``best`` (x, best) and ``consts`` (one row: N, y_star,
    u_star). ``persist(df, name)`` may write each table once (e.g.
    :func:`winnow.session.materialize`); all are aggregates of ``pairs``,
    whose size is bounded by the vocabulary squared."""
    keep = persist or (lambda df, name: df)
    pairs = keep(pairs, "lm_pairs")
    cy = pairs.groupBy("y").agg(F.sum("n").alias("cy"))
    total = cy.agg(F.coalesce(F.sum("cy"), F.lit(0)).alias("N"))
    n_total = total.select("N").scalar()  # one-row aggregates enter as scalar subqueries
    uni = keep(cy.select("y", ((F.col("cy") + 1) / (n_total + F.lit(vocab_size))).alias("u")), "lm_uni")
    ctx = keep(pairs.groupBy("x").agg(F.sum("n").alias("cx")), "lm_ctx")
    # Best unigram token (ties -> lowest id); the unseen-token prior is
    # 1/(N+V), below any seen token's, so the best is always a seen one.
    best_u = uni.agg(F.max(F.struct("u", (-F.col("y")).alias("neg"))).alias("b")).select(
        (-F.col("b.neg")).cast("int").alias("y_star"), F.col("b.u").alias("u_star"))
    consts = keep(best_u.withColumn("N", n_total).select("N", "y_star", "u_star"), "lm_consts")  # one row
    scored = pairs.join(uni, "y").withColumn("s", F.col("n") + F.lit(alpha) * F.col("u"))
    best_pair = scored.groupBy("x").agg(F.max(F.struct("s", (-F.col("y")).alias("neg"))).alias("b"))
    y_star, u_star = consts.select("y_star").scalar(), consts.select("u_star").scalar()
    best = keep(best_pair
                .select("x", F.greatest(F.col("b"), F.struct((F.lit(alpha) * u_star).alias("s"),
                                                             (-y_star).alias("neg"))).alias("b"))
                .select("x", (-F.col("b.neg")).cast("int").alias("best")), "lm_best")
    return {"pairs": pairs, "ctx": ctx, "uni": uni, "best": best, "consts": consts,
            "vocab_size": vocab_size, "alpha": alpha}


def lm_score(val_tokens: DataFrame, model, vocab_size: int = VOCAB_SIZE,
             alpha: float = ALPHA) -> DataFrame:
    """Per validation target: ``logp`` = ln p(y | x) and ``correct`` (best
    guess = y). ``model``: :func:`fit_count_model` output, or a pairs table
    (fitted on the fly)."""
    if isinstance(model, DataFrame):
        model = fit_count_model(model, vocab_size, alpha)
    vocab_size, alpha = model["vocab_size"], model["alpha"]
    t = (val_tokens.join(model["pairs"].select("x", "y", F.col("n").alias("cxy")), ["x", "y"], "left")
                   .join(model["ctx"], "x", "left")
                   .join(model["uni"], "y", "left")
                   .join(model["best"], "x", "left")
                   .withColumn("N", model["consts"].select("N").scalar())
                   .withColumn("y_star", model["consts"].select("y_star").scalar()))
    unseen_u = F.lit(1.0) / (F.col("N") + F.lit(vocab_size))
    uy = F.coalesce(F.col("u"), unseen_u)
    p = ((F.coalesce(F.col("cxy"), F.lit(0)) + F.lit(alpha) * uy)
         / (F.coalesce(F.col("cx"), F.lit(0)) + F.lit(alpha)))
    guess = F.coalesce(F.col("best"), F.col("y_star"))
    return t.select(*[c for c in val_tokens.columns], F.round(F.log(p), 9).alias("logp"),
                    guess.alias("guess"), (guess == F.col("y")).alias("correct"))


def lm_metrics(scored: DataFrame) -> DataFrame:
    """avg loss over target tokens, perplexity exp(loss), token accuracy;
    denominators max(1, n) so an empty set gives 0 and 0."""
    agg = scored.agg(F.count(F.lit(1)).alias("n_tokens"),
                     F.coalesce(F.sum(-F.col("logp")), F.lit(0.0)).alias("__nll"),
                     F.count_if(F.col("correct")).alias("n_correct"))
    n = F.greatest(F.lit(1), F.col("n_tokens"))
    loss = F.col("__nll") / n
    return agg.select("n_tokens", F.round(loss, 9).alias("loss"), F.round(F.exp(loss), 9).alias("perplexity"),
                      F.round(F.col("n_correct") / n, 9).alias("accuracy"))


def val_loss_by_sequence(blocks: DataFrame, scored: DataFrame, key: str = "conv_id",
                         batch: int = EVAL_BATCH) -> DataFrame:
    """In-training validation loss: blocks in (key, block_no) order form
    batches of ``batch``; each batch's mean token loss is weighted by its
    number of sequences. Batches without targets are left out (the source
    would produce NaN). Output: one row (n_batches, val_loss)."""
    per_batch = batch_losses(blocks, scored, key, batch)
    agg = per_batch.where(F.col("n_targets") > 0).agg(
        F.count(F.lit(1)).alias("n_batches"),
        (F.sum(F.col("batch_loss") * F.col("n_seq")) / F.greatest(F.lit(1), F.sum("n_seq"))).alias("val_loss"))
    return agg.select("n_batches", F.round(F.coalesce("val_loss", F.lit(0.0)), 9).alias("val_loss"))


def batch_losses(blocks: DataFrame, scored: DataFrame, key: str = "conv_id",
                 batch: int = EVAL_BATCH) -> DataFrame:
    """(batch_id, n_seq, n_targets, batch_loss) over blocks in (key, block_no)
    order; positions come from the distributed index (no single-task sort)."""
    order = group_index(blocks.select(key, "block_no"), [], [key, "block_no"], out="__seq")
    seq = order.select(key, "block_no", F.floor(F.col("__seq") / batch).cast("long").alias("batch_id"))
    tok = scored.groupBy(key, "block_no").agg(F.count(F.lit(1)).alias("nt"), F.sum(-F.col("logp")).alias("nll"))
    joined = seq.join(tok, [key, "block_no"], "left")
    return joined.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_seq"),
        F.coalesce(F.sum("nt"), F.lit(0)).alias("n_targets"),
        (F.sum("nll") / F.sum("nt")).alias("batch_loss"))


def best_checkpoint(metrics: DataFrame, step: str = "step", value: str = "val_loss") -> DataFrame:
    """Marks steps whose value is strictly below every earlier one (the steps
    where a best checkpoint is saved). The running minimum is the bucketed
    one of :mod:`winnow.operators.index`, so a long series never sits in one
    window partition."""
    run = group_running(metrics.select(step, value), [], [step], value, "best_before", agg="min")
    return run.select(step, value, "best_before",
                      (F.col("best_before").isNull() | (F.col(value) < F.col("best_before"))).alias("saved"))


def topk_next(pairs: DataFrame, k: int = TOP_K, temperature: float = TEMPERATURE,
              with_backoff: bool = True) -> DataFrame:
    """Per context: the successors whose count is >= the k-th largest (ties
    kept, ``rank`` not ``row_number``) with probabilities p^(1/T) renormalised.
    ``with_backoff`` adds context -1: the same over unigram counts, used for
    contexts never seen. One context's successors are bounded by the
    vocabulary, so the window partition per context is bounded."""
    src = pairs
    if with_backoff:
        src = src.unionByName(pairs.groupBy("y").agg(F.sum("n").alias("n")).withColumn("x", F.lit(-1)))
    w = Window.partitionBy("x").orderBy(F.col("n").desc())
    kept = src.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)
    tot = F.sum("n").over(Window.partitionBy("x"))
    wt = F.pow(F.col("n") / tot, F.lit(1.0 / temperature)) if temperature > 0 else F.col("n") / tot
    kept = kept.withColumn("__w", wt)
    return kept.select("x", "y", "n", "rank",
                       F.round(F.col("__w") / F.sum("__w").over(Window.partitionBy("x")), 9).alias("prob"))


def greedy_next(pairs: DataFrame) -> DataFrame:
    """Temperature <= 0: the most frequent successor (ties -> lowest id)."""
    return (pairs.groupBy("x").agg(F.max(F.struct("n", (-F.col("y")).alias("neg"))).alias("b"))
                 .select("x", (-F.col("b.neg")).cast("int").alias("next")))


# --------------------------------------------------------------------------
# Generation over a table of prompts
# --------------------------------------------------------------------------

# Steps planned as one job; then the state is written and finished prompts leave.
STEPS_PER_WRITE = 8


def _uniform(prompt_id: Column, step: int, seed: int) -> Column:
    """A draw from [0, 1): the first 48 bits of md5("id:step:seed")."""
    text = F.concat_ws(":", prompt_id.cast("string"), F.lit(str(step)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def char_decode(ids: Column) -> Column:
    """Text of character ids (special ids have none), through UTF-32; a byte order
    mark of our own goes first, so one in the text stays."""
    points = F.transform(F.filter(ids, lambda i: i >= CHAR_ID_OFFSET),
                         lambda i: F.lpad(F.hex(i - CHAR_ID_OFFSET), 8, "0"))
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(points, ""))), "UTF-32")


def sampling_contexts(table: DataFrame) -> DataFrame:
    """(x, cands): one row per context, its successors by id with the running sum of
    their probabilities. ``table`` is :func:`topk_next` or :func:`greedy_next`."""
    if "next" in table.columns:
        one = F.struct(F.col("next").cast("int").alias("y"), F.lit(1.0).alias("upto"))
        return table.select(F.col("x").cast("int").alias("x"), F.array(one).alias("cands"))
    rows = table.groupBy(F.col("x").cast("int").alias("x")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), "prob"))).alias("c"))
    none = F.array().cast("array<struct<y:int,upto:double>>")

    def add(acc, c):
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)["upto"]).otherwise(0.0)
        return F.concat(acc, F.array(F.struct(c["y"].alias("y"), (before + c["prob"]).alias("upto"))))

    return rows.select("x", F.aggregate("c", none, add).alias("cands"))


def _next_id(cands: Column, draw: Column) -> Column:
    """The first successor whose running sum passes the draw, else the last one;
    <bos> where there is none."""
    hit = F.get(F.filter(cands, lambda c: draw < c["upto"]), F.lit(0))["y"]
    return F.coalesce(hit, F.try_element_at(cands, F.lit(-1))["y"], F.lit(BOS_ID))


def generate_batch(prompts: DataFrame, table: DataFrame, id_col: str = "prompt_id", text_col: str = "prompt",
                   max_new_tokens: int = BLOCK_LEN, temperature: float = TEMPERATURE, seed: int = 0,
                   max_len: int = BLOCK_LEN, steps_per_write: int = STEPS_PER_WRITE) -> DataFrame:
    """Continue every prompt with the count model (character tokenizer).

    ``table``: :func:`topk_next` output (with back-off context -1), or
    :func:`greedy_next` for temperature <= 0. Rules as in the source: empty prompt
    -> [<bos>]; keep the last 64 ids; new tokens = min(max_new, 64 - len); none
    left -> the decoded prompt cut to its own length; stop after emitting <bos>;
    output = decoded ids.

    The state is a table (prompt, ids, ids left). A step is an equi-join of the last
    id to one row per context; Spark broadcasts contexts where their size allows and
    splits a hot last id otherwise. The state is written below the shared
    checkpoint folder every ``steps_per_write`` steps, and prompts that have ended
    take no further part. Nothing comes to the driver but whether some are left.
    """
    contexts = materialize(sampling_contexts(table), "lm_contexts")
    # One row, kept for contexts never seen.
    backoff = contexts.where("x = -1").select("cands").scalar()
    known = contexts.select(F.col("x").alias("__x"), F.col("cands").alias("__cands"))
    ids = char_ids(F.coalesce(F.col(text_col), F.lit("")))
    ids = F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(BOS_ID)))
    state = prompts.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
                           F.slice(ids, F.greatest(F.lit(1), F.size(ids) - (max_len - 1)), max_len).alias("__ids"))
    state = state.withColumn("__left", F.least(F.lit(max_new_tokens), F.lit(max_len) - F.size("__ids")))
    state = materialize(state, "generate")
    ended = [state.where("__left <= 0").select(id_col, F.substring(char_decode(F.col("__ids")), F.lit(1), F.length("__text"))
                                               .alias("output"))]
    state = state.where("__left > 0")
    for first in range(0, min(max_new_tokens, max_len), steps_per_write):
        if state.isEmpty():
            break
        for step in range(first, first + steps_per_write):
            last = F.element_at("__ids", -1)
            # An ended prompt waits for the next write without meeting a context.
            asked = state.withColumn("__last", F.when(F.col("__left") > 0, last))
            # Null-safe: an equality would let the optimizer infer a filter on ``known`` from
            # the expression behind ``__last``; an ended prompt meets no context either way.
            met = asked.join(known, F.col("__last").eqNullSafe(F.col("__x")), "left")
            go = F.col("__last").isNotNull()
            met = met.withColumn("__cands", F.when(go, F.coalesce("__cands", backoff)))
            met = met.withColumn("__next", F.when(go, _next_id(F.col("__cands"), _uniform(F.col(id_col), step, seed))))
            state = met.select(
                id_col, F.when(go, F.concat("__ids", F.array("__next"))).otherwise(F.col("__ids")).alias("__ids"),
                F.when(F.col("__next") == BOS_ID, 0).when(go, F.col("__left") - 1).otherwise(F.col("__left")).alias("__left"))
        state = materialize(state, "generate")
        ended.append(state.where("__left <= 0").select(id_col, char_decode(F.col("__ids")).alias("output")))
        state = state.where("__left > 0")
    return reduce(DataFrame.unionByName, ended)


__all__ = ["block_tokens", "lm_counts", "lm_score", "lm_metrics", "val_loss_by_sequence",
           "batch_losses", "best_checkpoint", "topk_next", "greedy_next", "generate_batch", "fit_count_model"]
