"""Shard files under a versioned manifest, and the restore of a snapshot through it.

A shard is named ``rank{r}_{category}`` and kept as a folder ``name=...`` of JSON-line
files. A manifest is a table (version, name, path, bytes) of a folder's files; a
new one is written beside the old ones and the highest version counts, so files of a
stopped writer belong to no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import path_exists

_SCHEMA = "name string, path string, bytes long, version int"


def write_shards(lines: DataFrame, folder: str) -> DataFrame:
    """Write shard lines (category, rank, line, value) as files of their shards and
    the folder's next manifest; returns that manifest. A shard's lines may come from
    many tasks, each writing files of its own with its lines in order."""
    spark, folder = lines.sparkSession, folder.rstrip("/")
    version = latest_version(spark, folder) + 1
    named = lines.select(F.concat(F.lit("rank"), F.col("rank"), F.lit("_"), F.col("category")).alias("name"), "line", "value")
    target = f"{folder}/v{version}"
    # The line number leads each line, so that order survives a shard in many files.
    (named.withColumn("value", F.concat_ws("\t", "line", "value")).sortWithinPartitions("name", "line")
     .select("name", "value").write.partitionBy("name").text(target))
    files = (spark.read.text(target).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
             .distinct().select(_shard_name(F.col("path")).alias("name"), "path", "bytes", F.lit(version).alias("version")))
    files.write.parquet(f"{folder}/manifest/{version}")
    return manifest(spark, folder)


def _shard_name(path):
    """The shard of a file, from the folder it is in (a path is URL-encoded)."""
    return F.url_decode(F.replace(F.regexp_extract(path, "/name=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))


def latest_version(spark: SparkSession, folder: str) -> int:
    """The highest manifest version of a folder, 0 without one."""
    at = f"{folder.rstrip('/')}/manifest/*"
    if not path_exists(spark, at):
        return 0
    return spark.read.schema("version int").parquet(at).agg(F.max("version")).first()[0] or 0


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    version = latest_version(spark, folder)
    if not version:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(f"{folder.rstrip('/')}/manifest/{version}")


def restore_shards(spark: SparkSession, output_dir: str, snapshot_dir: str | None) -> DataFrame:
    """Shard lines (category, rank, line, value) of the output folder and of those
    shards of the snapshot whose name the output folder does not have. The two
    manifests decide; files they do not name are not read."""
    out = manifest(spark, output_dir)
    files = out.select("path")
    if snapshot_dir:
        files = files.unionByName(manifest(spark, snapshot_dir).join(out.select("name").distinct(), "name", "left_anti").select("path"))
    # As many paths as there are files to read, which a scan lists on the driver anyway.
    paths = [r.path for r in files.collect()]
    if not paths:
        return spark.createDataFrame([], "category string, rank int, line long, value string")
    name = _shard_name(F.col("_metadata.file_path"))
    return spark.read.text(paths).select(
        F.regexp_replace(name, r"^rank\d+_", "").alias("category"), F.regexp_extract(name, r"^rank(\d+)_", 1).cast("int").alias("rank"),
        F.substring_index("value", "\t", 1).cast("long").alias("line"),
        F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))


__all__ = ["write_shards", "latest_version", "manifest", "restore_shards"]
