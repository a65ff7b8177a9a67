"""JSON-lines record files: scan, restore from a snapshot, shard layout.

Lines are read as text and parsed with ``try_parse_json``: blank lines and
lines that do not parse (a writer killed mid-line) are skipped and counted,
never fatal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.text import py_strip
from winnow.session import path_exists


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """(value, file_name) for every line of the given files/folders."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    paths = [p for p in paths if path_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "value string, file_name string, block_start long")
    return spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file_name"),
                                         F.col("_metadata.file_block_start").alias("block_start"))


def scan_records(spark: SparkSession, paths) -> DataFrame:
    """Lines that parse to a JSON object: (value, file_name, record VARIANT)."""
    lines = read_lines(spark, paths)
    stripped = lines.withColumn("value", py_strip("value")).where(F.col("value") != "")
    parsed = stripped.withColumn("record", F.expr("try_parse_json(value)"))
    return parsed.where(F.expr("try_variant_get(record, '$', 'map<string,variant>') IS NOT NULL"))


def record_line_stats(spark: SparkSession, paths) -> DataFrame:
    """One row: lines, blank lines, bad lines (unparsable or not an object), records."""
    lines = read_lines(spark, paths).withColumn("__s", py_strip("value"))
    is_blank = F.col("__s") == ""
    is_rec = F.expr("try_variant_get(try_parse_json(__s), '$', 'map<string,variant>') IS NOT NULL")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(is_blank).alias("blank_lines"),
                     F.count_if(~is_blank & ~is_rec).alias("bad_lines"),
                     F.count_if(~is_blank & is_rec).alias("records"))


def record_samples(records: DataFrame) -> DataFrame:
    """The ``sample`` field of parsed records as text; missing/null -> ''."""
    return records.select(F.coalesce(F.expr("try_variant_get(record, '$.sample', 'string')"),
                                      F.lit("")).alias("sample"))


def restore_checkpoint(spark: SparkSession, output_dir: str, snapshot_dir: str | None) -> DataFrame:
    """Lines of the output folder plus those of snapshot files whose name is
    not already in the output folder (a file already there wins)."""
    out = read_lines(spark, f"{output_dir.rstrip('/')}/*.jsonl")
    if not snapshot_dir or not path_exists(spark, snapshot_dir):
        return out
    snap = read_lines(spark, f"{snapshot_dir.rstrip('/')}/*.jsonl")
    kept = snap.join(out.select("file_name").distinct(), "file_name", "left_anti")
    return out.unionByName(kept)


def shard_lines_from_files(lines: DataFrame) -> DataFrame:
    """Shard layout from file names ``rank{r}_{category}``: (category, rank,
    line, value); ``line`` is the line position in its file.

    Position inside a file comes from the file's split offset and the row
    order of the scan (``_metadata.file_block_start`` + a per-task counter),
    numbered with the skew-safe group index.
    """
    from winnow.operators.index import group_index
    tagged = lines.select(
        "value", "file_name", "block_start",
        F.regexp_extract("file_name", r"^rank(\d+)_", 1).cast("int").alias("rank"),
        F.regexp_replace("file_name", r"^rank\d+_", "").alias("category"),
        F.monotonically_increasing_id().alias("__order"))
    return (group_index(tagged, ["file_name"], ["block_start", "__order"], out="line")
            .select("category", "rank", "line", "value"))
