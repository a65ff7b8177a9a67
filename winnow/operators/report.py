"""Character and token report over job or record rows: one scan, one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import with_extracted_text

# Fixed value: characters per token of the estimate used without a tokenizer.
CHARS_PER_TOKEN = 4

REPORT_COLUMNS = ("rows", "total_chars", "avg_chars_per_row", "total_tokens", "avg_tokens_per_row",
                  "tokens_per_char", "raw_chars", "raw_token_estimate", "tokenizer")


def token_report(records: DataFrame, tokenizer: str = "chars4", sample: str = "sample",
                 token_total: DataFrame | None = None) -> DataFrame:
    """Rows, characters and tokens of the text inside ``sample``.

    ``tokenizer``: ``chars4`` - no tokenizer, tokens estimated as
    ``sum(chars) div 4`` on the total (not per row); ``char`` - one token per
    code point; ``bpe`` - ``token_total`` is a one-row frame with column
    ``total_tokens`` (see :func:`winnow.operators.bpe.bpe_token_total`); a
    callable - maps the text column to an id-array column (e.g.
    :func:`winnow.functions.tokens.char_ids`), tokens = sum of sizes; one with a
    ``total(texts, text)`` (e.g. :func:`winnow.operators.bpe.bpe_tokenizer`) gives the
    sum itself, as a one-row frame.
    A missing/NULL sample counts as empty text. Denominators are max(n, 1).
    """
    df = records.select(F.coalesce(F.col(sample), F.lit("")).alias("__sample"))
    df = with_extracted_text(df, "__sample", "__text")
    extra, total = [], getattr(tokenizer, "total", None)
    if callable(tokenizer) and total is None:
        extra = [F.coalesce(F.sum(F.size(tokenizer(F.col("__text")))), F.lit(0)).cast("long").alias("__tok")]
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 F.coalesce(F.sum(F.length("__text")), F.lit(0)).alias("total_chars"),
                 F.coalesce(F.sum(F.length("__sample")), F.lit(0)).alias("raw_chars"), *extra)
    if callable(tokenizer):
        if total is not None:
            agg = agg.withColumn("__tok", total(df, "__text").select("total_tokens").scalar())
        tokens = F.col("__tok")
        tokenizer = getattr(tokenizer, "__name__", "callable")
    elif tokenizer == "chars4":
        tokens = F.expr(f"total_chars div {CHARS_PER_TOKEN}")
    elif tokenizer == "char":
        tokens = F.col("total_chars")
    elif tokenizer == "bpe":
        if token_total is None:
            raise ValueError("tokenizer='bpe' needs token_total")
        # A one-row aggregate: attached as a scalar subquery, not a join.
        agg = agg.withColumn("__tok", token_total.select("total_tokens").scalar())
        tokens = F.col("__tok")
    else:
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    rows = F.greatest(F.col("rows"), F.lit(1))
    return agg.select(
        "rows", "total_chars",
        (F.col("total_chars") / rows).alias("avg_chars_per_row"),
        tokens.alias("total_tokens"),
        (tokens / rows).alias("avg_tokens_per_row"),
        (tokens / F.greatest(F.col("total_chars"), F.lit(1))).alias("tokens_per_char"),
        "raw_chars",
        F.expr(f"raw_chars div {CHARS_PER_TOKEN}").alias("raw_token_estimate"),
        F.lit(tokenizer).alias("tokenizer"),
    )


def token_estimate(records: DataFrame, sample: str = "sample") -> DataFrame:
    """``sum(chars) div 4`` for the extracted text and for the raw sample."""
    rep = token_report(records, "chars4", sample)
    return rep.select(F.col("total_tokens").alias("token_estimate"), "raw_token_estimate")
