"""Resume and merge: completed keys, skip-done anti join, shard merge, counters.

Result records are JSON lines (one shard file per category and rank). All
steps read them as text + ``try_parse_json``: a line cut short by a killed
process parses to NULL and is skipped, never fatal.

Scale notes: the merge picks one record per key with ``min_by``. Its buffer holds
strings, so Spark sorts by key on both sides of the shuffle (a sort aggregate);
copies of one hot key are still reduced in each task before the shuffle (a
``row_number`` window would put all copies of a key in one task).
``completed_keys`` is a partial+final distinct; ``resume_anti`` is a
``left_anti`` join planned before the scorer so finished rows never reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.keys import KEY_FIELDS, KEY_SEPARATOR, NONE_TEXT
from winnow.functions.text import _py_str_sql
from winnow.operators.classify import (CATEGORY_FILES, ERROR_PREFIX, RECORD_COLUMNS, category_name,
                                       confidence_band)


def _field(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``__v`` (VARIANT) and keep only lines that parse to a JSON object."""
    v = F.expr(f"try_parse_json({value})")
    return (lines.withColumn("__v", v)
                 .where(F.expr("try_variant_get(__v, '$', 'map<string,variant>') IS NOT NULL")))


def record_key_sql(v: str = "__v") -> str:
    """Key of a parsed record from its four fields, as ``str()`` prints them."""
    parts = ", ".join(f"coalesce({_py_str_sql(_field(v, f))}, '{NONE_TEXT}')" for f in KEY_FIELDS)
    return f"concat_ws('{KEY_SEPARATOR}', {parts})"


def is_error_status(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(s, F.lit("")).startswith(ERROR_PREFIX)


def completed_filter(parsed: DataFrame, v: str = "__v") -> DataFrame:
    """Records that count as done: all four key fields present (JSON null
    counts as present) and a status not starting ``inference_error:``. A
    missing status and ``oom_fallback`` both count as done."""
    present = " AND ".join(f"{_field(v, f)} IS NOT NULL" for f in KEY_FIELDS)
    status = F.expr(f"coalesce({_py_str_sql(_field(v, 'parse_status'))}, '')")
    return parsed.where(F.expr(present) & ~is_error_status(status))


def completed_keys(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct keys of finished records over all files (one column ``example_id``)."""
    done = completed_filter(parse_records(lines, value))
    return done.select(F.expr(record_key_sql()).alias("example_id")).distinct()


def resume_anti(jobs: DataFrame, completed: DataFrame, key: str = "example_id") -> DataFrame:
    """Jobs whose key is not completed. Place before the scorer: Catalyst does
    not move joins across a Python scorer, so plan order is the saving."""
    return jobs.join(completed.select(key), key, "left_anti")


def merge_shards(shards: DataFrame, value: str = "value") -> DataFrame:
    """One record per ``example_id``: the first success in (category, rank,
    line) order, else the first failure; final category recomputed from the
    record. ``shards`` has ``category`` (file name), ``rank``, ``line``, ``value``.

    Lines that do not parse or lack ``example_id`` are skipped. Output: the
    record fields plus ``record`` (the winning line as it was written, with
    whatever other fields it has), ``rank``, ``line`` of the winner and ``category``;
    records whose label is not one of the two go out with category NULL (the
    caller routes them to a reject output).
    """
    # Files of no known category come after all others.
    cat_no = F.lit(len(CATEGORY_FILES))
    for i, (_, name) in reversed(list(enumerate(CATEGORY_FILES))):
        cat_no = F.when(F.col("category") == name, F.lit(i)).otherwise(cat_no)
    parsed = parse_records(shards, value)
    fields = {c: F.expr(_py_str_sql(_field("__v", c))) for c in RECORD_COLUMNS if c != "confidence"}
    fields["confidence"] = F.expr(f"try_variant_get(__v, '$.confidence', 'int')")
    fields["row_index"] = F.expr(f"try_variant_get(__v, '$.row_index', 'bigint')")
    rec = parsed.select(
        F.col("rank"), F.col("line"), cat_no.alias("__cat"), F.col(value).alias("record"),
        *[fields[c].alias(c) for c in ("example_id", "parse_status")],
        F.expr(f"{_field('__v', 'example_id')} IS NOT NULL").alias("__has_key"),
    ).where("__has_key")
    order = F.struct(is_error_status("parse_status").alias("e"), F.col("__cat").alias("c"),
                     F.col("rank").alias("r"), F.col("line").alias("l"))
    # Only the line itself travels; the winners' fields are read from it afterwards.
    won = (rec.groupBy("example_id")
              .agg(F.min_by(F.struct("record", "rank", "line"), order).alias("w"))
              .select("example_id", "w.*").withColumn("__v", F.expr("try_parse_json(record)")))
    out = won.select("example_id", *[fields[c].alias(c) for c in RECORD_COLUMNS if c != "example_id"],
                     "record", "rank", "line")
    band = confidence_band("confidence")
    return out.withColumn("band", band).withColumn("category", category_name("classification", band))


def run_counters(jobs: DataFrame, completed: DataFrame, results: DataFrame | None = None,
                 key: str = "example_id") -> DataFrame:
    """seen / skipped_existing / submitted / successful / errors in one pass.

    Jobs are flagged by a left join to the completed keys (distinct, so the
    join cannot multiply rows); ``results`` (records of this run) supplies
    successes and errors by status.
    """
    flagged = jobs.select(key).join(completed.select(key).withColumn("__done", F.lit(True)), key, "left")
    base = flagged.agg(F.count(F.lit(1)).alias("seen"),
                       F.count_if(F.col("__done").isNotNull()).alias("skipped_existing"))
    base = base.withColumn("submitted", F.col("seen") - F.col("skipped_existing"))
    if results is None:
        return base.withColumn("successful", F.lit(0).cast("long")).withColumn("errors", F.lit(0).cast("long"))
    res = results.agg(F.count_if(~is_error_status("parse_status")).alias("successful"),
                      F.count_if(is_error_status("parse_status")).alias("errors"))
    # One-row aggregates attached as scalar subqueries.
    return (base.withColumn("successful", res.select("successful").scalar())
                .withColumn("errors", res.select("errors").scalar()))


__all__ = ["parse_records", "record_key_sql", "completed_filter", "completed_keys", "resume_anti",
           "merge_shards", "run_counters", "is_error_status"]
