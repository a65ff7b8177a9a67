"""Chats -> masked token segments -> fixed-length shifted training blocks.

Rule of the blocks: an example's ids are cut every 64 positions; the inputs
are ids[s : s+64], the targets ids[s+1 : s+65], a block without any target is
skipped; inputs are padded with ``<pad>``, targets with -100, and a target
counts only where its mask is 1.

Scale: no step gathers a whole conversation. Each message becomes a segment
(ids + mask); its offset inside the example is a skew-safe running sum
(:func:`winnow.operators.index.group_prefix_sum`); each segment is sliced into
the pieces that fall into the 65-position window of every block it touches;
pieces meet in a group per (example, block) - at most 65 tokens - so even a
conversation holding a third of all messages spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.tokens import BLOCK_LEN, BOS_ID, EOS_ID, IGNORE_ID, PAD_ID, char_ids
from winnow.operators.index import group_prefix_sum
from winnow.session import materialize


def explode_messages(records: DataFrame, key: str = "example_id", sample: str = "sample") -> DataFrame:
    """One row per message with content: (key, pos, role, content).

    Reads ``messages`` from the sample JSON. Skipped like Python's ``if not
    content``: absent, null, '', false, 0, empty list/object. A record whose
    ``messages`` is null or not a list contributes nothing. ``role`` defaults
    to ''; non-text contents are kept as their text.
    """
    parsed = records.select(key, F.expr(f"try_variant_get(try_parse_json({sample}), '$.messages', "
                                        f"'array<variant>')").alias("__m"))
    exploded = parsed.select(key, F.posexplode("__m").alias("pos", "__msg"))
    cv = exploded.select(key, "pos", F.expr("try_variant_get(__msg, '$.content', 'variant')").alias("__c"),
                         F.expr("try_variant_get(__msg, '$.role', 'string')").alias("__r"))
    falsy = F.expr("__c IS NULL OR is_variant_null(__c) "
                   "OR (schema_of_variant(__c) = 'STRING' AND cast(__c AS STRING) = '') "
                   "OR (schema_of_variant(__c) = 'BOOLEAN' AND NOT variant_get(__c, '$', 'boolean')) "
                   "OR (schema_of_variant(__c) NOT IN ('STRING', 'BOOLEAN') "
                   "    AND try_variant_get(__c, '$', 'double') = 0) "
                   "OR to_json(__c) IN ('[]', '{}')")
    return cv.where(~falsy).select(key, F.col("pos").cast("int").alias("pos"),
                                   F.coalesce("__r", F.lit("")).alias("role"),
                                   F.expr("cast(__c AS STRING)").alias("content"))


def role_segment(role, ids) -> Column:
    """Struct(ids, mask) of one message: user -> <bos>+ids, all -100;
    assistant -> ids+<eos>, all 1; any other role -> ids, all -100."""
    r = F.col(role) if isinstance(role, str) else role
    t = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(t)
    user = F.struct(F.concat(F.array(F.lit(BOS_ID)), t).alias("ids"),
                    F.array_repeat(F.lit(IGNORE_ID), n + 1).alias("mask"))
    assistant = F.struct(F.concat(t, F.array(F.lit(EOS_ID))).alias("ids"),
                         F.array_repeat(F.lit(1), n + 1).alias("mask"))
    other = F.struct(t.alias("ids"), F.array_repeat(F.lit(IGNORE_ID), n).alias("mask"))
    return F.when(r == "user", user).when(r == "assistant", assistant).otherwise(other)


def role_mask(messages: DataFrame, key: str = "conv_id", pos: str = "turn", role: str = "role",
              text: str = "text", tokenize=char_ids, token_count=None) -> DataFrame:
    """Per message: ``seg_ids``, ``seg_mask``, ``seg_len`` and ``offset`` (the
    position of its first id inside the example's id list).

    ``messages`` holds one row per message; empty texts are skipped as in
    the source. ``tokenize(column) -> array<int> column``; ``token_count``
    (column -> int column) gives the id count without tokenizing - for the
    character tokenizer it is ``length``. With it, offsets are computed on
    the compact text rows and the text is tokenized once, after the shuffle;
    without it the ids are built first and stored.
    """
    if token_count is None and tokenize is char_ids:
        token_count = F.length
    msgs = messages.where(F.col(text).isNotNull() & (F.col(text) != ""))
    if token_count is None:
        # Written once: bounds, sums and rows all read the ids.
        msgs = materialize(msgs.select(key, pos, role, tokenize(F.col(text)).alias("__ids")), "message_ids")
        text, tokenize, token_count = "__ids", lambda ids: ids, F.size
    r = F.col(role)
    extra = F.when(r.isin("user", "assistant"), F.lit(1)).otherwise(F.lit(0))
    base = msgs.select(key, pos, role, text, (token_count(F.col(text)) + extra).alias("seg_len"))
    off = group_prefix_sum(base, [key], [pos], "seg_len", "offset")
    seg = off.select(key, pos, role, role_segment(r, tokenize(F.col(text))).alias("__s"), "seg_len", "offset")
    return seg.select(key, pos, role, F.col("__s.ids").alias("seg_ids"), F.col("__s.mask").alias("seg_mask"),
                      "seg_len", "offset")


def tokenized_examples(segments: DataFrame, key: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Whole ``ids``/``mask`` lists per example (for inspection and small
    exports; one example's ids meet in one row, as the record format needs)."""
    g = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, "seg_ids", "seg_mask"))).alias("s"))
    return g.select(key, F.flatten(F.col("s.seg_ids")).alias("ids"), F.flatten(F.col("s.seg_mask")).alias("mask"))


def make_blocks(segments: DataFrame, key: str = "conv_id", block_len: int = BLOCK_LEN) -> DataFrame:
    """(key, block_no, xs, ys) from segments with ``offset`` (see :func:`role_mask`).

    Block b reads positions [b*L, b*L + L] (L inputs plus the last target).
    A segment at [off, off+len) contributes the slice overlapping that window
    to every block whose window it touches.
    """
    L = block_len
    off, ln = F.col("offset"), F.col("seg_len")
    first_b = F.greatest(F.lit(0), F.ceil((off - L) / F.lit(L))).cast("long")
    last_b = F.floor((off + ln - 1) / F.lit(L)).cast("long")
    # Guard inside the expression: sequence(5, 3) would count down, so an
    # empty segment yields NULL (no rows) whatever order filters end up in.
    blocks_touched = F.when(ln > 0, F.sequence(first_b, last_b))
    pieces = (segments.where(ln > 0)
              .select(key, "seg_ids", "seg_mask", off.alias("off"),
                      F.explode(blocks_touched).alias("block_no")))
    lo = F.greatest(F.col("off"), F.col("block_no") * L)
    hi = F.least(F.col("off") + F.size("seg_ids") - 1, F.col("block_no") * L + L)
    start, length = (lo - F.col("off") + 1).cast("int"), (hi - lo + 1).cast("int")
    pieces = pieces.select(key, "block_no", lo.alias("lo"),
                           F.slice("seg_ids", start, length).alias("p_ids"),
                           F.slice("seg_mask", start, length).alias("p_mask"))
    win = (pieces.groupBy(key, "block_no")
                 .agg(F.sort_array(F.collect_list(F.struct("lo", "p_ids", "p_mask"))).alias("w")))
    win = win.select(key, "block_no", F.flatten(F.col("w.p_ids")).alias("w_ids"),
                     F.flatten(F.col("w.p_mask")).alias("w_mask"))
    n = F.size("w_ids")
    xs = F.concat(F.slice("w_ids", 1, L), F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(0), L - n)))
    ys = F.transform(F.sequence(F.lit(1), F.lit(L)),
                     lambda k: F.when((k < n) & (F.col("w_mask")[k] == 1), F.col("w_ids")[k])
                                .otherwise(F.lit(IGNORE_ID)))
    # A window with fewer than two ids has no target: no block.
    return win.where(n >= 2).select(key, "block_no", xs.alias("xs"), ys.alias("ys"))


def drop_untrainable(blocks: DataFrame) -> DataFrame:
    """Blocks whose targets are all -100 carry no loss; drop them."""
    return blocks.where(F.exists("ys", lambda y: y != IGNORE_ID))


def drop_empty_examples(examples: DataFrame, n_ids: str = "n_ids", keep_empty: bool = False) -> DataFrame:
    """Evaluation drops examples without ids; training keeps them."""
    return examples if keep_empty else examples.where(F.col(n_ids) > 0)


def example_lengths(examples: DataFrame, segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every example with its id count (0 when it has no non-empty message)."""
    lens = segment_lengths(segments, key)
    return (examples.select(key).distinct().join(lens, key, "left")
            .select(key, F.coalesce("n_ids", F.lit(0)).cast("long").alias("n_ids")))


def message_lengths(messages: DataFrame, key: str = "conv_id", role: str = "role", text: str = "text",
                    token_count=F.length) -> DataFrame:
    """(key, n_ids) of the examples with a text, from the messages alone: no offsets
    and no ids are needed. Partial sums: a hot example is reduced in each task."""
    extra = F.when(F.col(role).isin("user", "assistant"), F.lit(1)).otherwise(F.lit(0))
    msgs = messages.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return msgs.groupBy(key).agg(F.sum(token_count(F.col(text)) + extra).cast("long").alias("n_ids"))


def segment_lengths(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_ids) of the examples with a segment."""
    return segments.groupBy(key).agg(F.sum("seg_len").cast("long").alias("n_ids"))


def block_count(n_ids, block_len: int = BLOCK_LEN) -> Column:
    """How many blocks :func:`make_blocks` cuts from so many ids: each needs an id and the one after it."""
    n = F.col(n_ids) if isinstance(n_ids, str) else n_ids
    return F.when(n >= 2, F.floor((n - 2) / F.lit(block_len)).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def truncate_tokens(ids, limit: int) -> Column:
    """First ``limit`` tokens."""
    return F.slice(F.col(ids) if isinstance(ids, str) else ids, 1, limit)
