"""Seeded exact-size holdout, evaluation sample and per-split counts.

The shuffle is an order by ``md5(key ':' seed)``; the first
``max(1, int(N * ratio))`` examples are the validation split. Positions in
that order come from :func:`winnow.operators.index.group_index` over one
group: rows are range-partitioned on the hash (uniform by construction), so
even a 2 % holdout of billions of examples never passes through one task or
the driver, and its size is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.blocks import block_count
from winnow.operators.index import group_index

# The default seed, holdout ratio and evaluation sample size.
SEED = 42
VAL_RATIO = 0.02
EVAL_EXAMPLES = 200


def shuffle_hash(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def holdout_split(examples: DataFrame, key: str, seed: int = SEED, ratio: float = VAL_RATIO) -> DataFrame:
    """Adds ``shuffle_pos`` (0-based place in the seeded order) and ``split``
    ('val' for the first max(1, floor(N * ratio)), else 'train')."""
    hashed = examples.withColumn("__h", shuffle_hash(key, seed))
    ranked = group_index(hashed, [], ["__h", key], out="shuffle_pos")
    n_val = examples.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(float(ratio))))
                         .cast("long").alias("__n_val"))
    out = ranked.withColumn("__n_val", n_val.select("__n_val").scalar())  # scalar subquery
    return (out.withColumn("split", F.when(F.col("shuffle_pos") < F.col("__n_val"), F.lit("val"))
                           .otherwise(F.lit("train")))
               .drop("__h", "__n_val"))


def eval_sample(split_examples: DataFrame, n: int = EVAL_EXAMPLES, n_ids: str | None = None) -> DataFrame:
    """The first ``n`` validation examples in the seeded order; with ``n_ids``
    (a column) those without ids are left out before they are counted."""
    val = split_examples.where(F.col("split") == "val")
    if n_ids:
        val = val.where(F.col(n_ids) > 0)
    return val.orderBy("shuffle_pos").limit(n)


def with_split(blocks: DataFrame, split_examples: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Blocks with their ``split``. The validation examples, a small share of all, are
    spread into their block numbers first, so both sides meet on (key, block number) -
    as the blocks already lie - and no example meets in one task, however many blocks
    it has. ``lengths`` (key, n_ids): ids of each example; ``split_examples`` holds
    every example. A block without a key goes."""
    val = split_examples.where(F.col("split") == "val").select(key).join(lengths, key)
    numbers = F.when(block_count("n_ids") > 0, F.sequence(F.lit(0).cast("long"), block_count("n_ids") - 1))
    spread = val.select(key, F.explode(numbers).alias("block_no"), F.lit("val").alias("split"))
    joined = blocks.where(F.col(key).isNotNull()).join(spread, [key, "block_no"], "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("train")))


def split_counts(split_examples: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Examples and blocks per split, from the ids of each example (``lengths``: key,
    n_ids): one row per example is joined and no block is built."""
    return (split_examples.select(key, "split").join(lengths, key, "left").groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_examples"),
                 F.sum(block_count(F.coalesce("n_ids", F.lit(0)))).alias("n_blocks")))
