"""Exact deduplication by content sort, in DataFrame operations only.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. Sampled
splitters cut the order (leading bytes, digest, whole normalised text,
longer original first, id) into buckets. Each bucket is sorted - Spark's sort spills -
so equal texts are neighbours, and each row is compared in full with the row
before it. Ids are part of the splitters, so a text that a third of all rows
share spans many buckets; the first and last text of neighbouring buckets are
compared in full as well, which joins the parts of such a run.

Defined results: a NULL text counts as empty; a NULL id sorts after every
other; of rows that repeat in full exactly one is kept; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import read, stored
from winnow.operators.index import bucketed
from winnow.session import checkpoint_dir, shuffle_width

BLANKS = " \t\n\x0b\x0c\r"
LEADING_BYTES = 12
_B = "__bucket"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                buckets: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_code_points), one row
    per input row."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.isnull(id_col).cast("int").alias("no_id"),
                       (-F.char_length(F.coalesce(text, F.lit("")))).alias("shortness"),
                       normalised(text).alias("norm"))
    keyed = rows.select("*", F.hex(F.substring(F.encode("norm", "utf-8"), 1, LEADING_BYTES)).alias("lead"),
                        F.sha2(F.encode("norm", "utf-8"), 256).alias("sha"))
    cut = bucketed(keyed, ["lead", "sha", "shortness", "no_id", "id"], buckets or 2 * shuffle_width(spark))

    # One sort of each bucket; every row against its neighbour, in full.
    order = Window.partitionBy(_B).orderBy("lead", "sha", "norm", "shortness", "no_id", "id")
    before = F.lag("norm").over(order)
    compared = cut.select("*", F.row_number().over(order).alias("place"),
                          F.lead(F.lit(1)).over(order).isNull().alias("last"),
                          (before.isNull() | (before != F.col("norm"))).cast("long").alias("new"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    edge = (F.col("place") == 1) | F.col("last")
    numbered = compared.select(_B, "id", "shortness", "sha", "place", F.sum("new").over(running).alias("run"),
                               F.when(edge, F.col("norm")).alias("edge"))
    in_run = Window.partitionBy(_B, "run")
    first = in_run.orderBy("place")
    marked = stored(numbered.select("*", F.count(F.lit(1)).over(in_run).alias("size"),
                                    F.first("id").over(first).alias("keep"),
                                    F.row_number().over(first).alias("nth")), "exact-dedup")

    joined = _joined_runs(marked)
    out = marked.join(F.broadcast(joined), [_B, "run"], "left")
    return out.select(F.col("id").alias("doc_id"),
                      F.when(F.col("chain_size").isNull(), F.col("keep")).otherwise(F.col("chain_keep")).alias("keep_id"),
                      F.coalesce("chain_size", "size").alias("group_size"),
                      ((F.col("nth") == 1) & F.coalesce("chain_first", F.lit(True))).alias("kept"),
                      F.col("sha").alias("text_sha256"), (-F.col("shortness")).alias("n_code_points"))


def _joined_runs(marked: DataFrame) -> DataFrame:
    """Runs that go on over a bucket's end, with the figures of the whole run:
    at most two rows per bucket, so one task orders them and they may be
    broadcast."""
    w = Window.orderBy(_B, "place")
    edges = marked.where(F.col("edge").isNotNull())
    same_run = (F.lag(_B).over(w) == F.col(_B)) & (F.lag("run").over(w) == F.col("run"))
    same_text = F.lag("edge").over(w) == F.col("edge")
    linked = edges.select(_B, "run", "place", "size", "keep",
                          F.coalesce(same_run | same_text, F.lit(False)).alias("linked"))
    chains = linked.select("*", F.sum((~F.col("linked")).cast("long"))
                           .over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"))
    parts = chains.groupBy("chain", _B, "run").agg(F.first("size").alias("size"), F.first("keep").alias("keep"))
    whole = Window.partitionBy("chain")
    head = whole.orderBy(_B)
    return (parts.select(_B, "run", F.count(F.lit(1)).over(whole).alias("n"),
                         F.sum("size").over(whole).alias("chain_size"),
                         F.first("keep").over(head).alias("chain_keep"),
                         (F.row_number().over(head) == 1).alias("chain_first"))
            .where("n > 1").drop("n"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_code_points")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS nth
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
