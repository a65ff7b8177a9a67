"""Sinks of a labelling run: routed appends, final outputs, run metadata.

Spark's output committer replaces a plain writer's flush-per-line and
temp-file-rename: a task's file appears whole or not at all, so a killed run
leaves complete files plus, at most, files of uncommitted tasks that are
never visible.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.classify import RECORD_COLUMNS


REJECTS = "rejects"


def route_append(records: DataFrame, path: str, run_id: int) -> None:
    """Append records as JSON lines, one folder per category.

    ``rank`` (the run) and ``line`` (order inside the run) are written into
    each record so the merge order survives; ``category`` is the partition.
    """
    out = records.select(*RECORD_COLUMNS, "category",
                         F.lit(int(run_id)).alias("rank"),
                         F.monotonically_increasing_id().alias("line"))
    (out.write.mode("append").partitionBy("category")
        .option("ignoreNullFields", "false").json(path))


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    """Routed output back as shard lines: (category, rank, line, value); ``value``
    is the record without the rank and line that :func:`route_append` put last."""
    lines = spark.read.text(path)  # partition discovery adds ``category``
    return lines.select("category",
                        F.expr("try_variant_get(try_parse_json(value), '$.rank', 'int')").alias("rank"),
                        F.expr("try_variant_get(try_parse_json(value), '$.line', 'bigint')").alias("line"),
                        F.regexp_replace("value", r',"rank":-?\d+,"line":-?\d+\}$', "}").alias("value"))


def write_final(merged: DataFrame, path: str, source_paths=()) -> None:
    """Overwrite the final outputs with the merged set, one folder per category
    and one (``category=rejects``) for records without one, in a single write. A
    record is the winning line (``record``), fields beyond the usual ones included;
    refuses to write onto a folder it reads from."""
    norm = path.rstrip("/")
    for src in source_paths:
        s = src.rstrip("/")
        if norm == s or norm.startswith(s + "/") or s.startswith(norm + "/"):
            raise ValueError(f"final path {path} overlaps input {src}")
    # Line ends in JSON text stand between its parts only.
    record = F.regexp_replace("record", r"[\r\n]", " ")
    (merged.select(record.alias("value"), F.coalesce("category", F.lit(REJECTS)).alias("category"))
           .write.mode("overwrite").partitionBy("category").text(norm))


def run_manifest(spark: SparkSession, model: str, datasets, num_workers: int, max_new_tokens: int = 1,
                 started_at: float | None = None) -> DataFrame:
    """Run parameters as a one-row DataFrame."""
    row = (model, list(datasets), int(num_workers), True, True, int(max_new_tokens),
           float(started_at if started_at is not None else time.time()))
    return spark.createDataFrame([row], "model string, datasets array<string>, num_gpus int, "
                                        "one_model_call_per_example boolean, forced_single_token boolean, "
                                        "max_new_tokens int, started_at_unix double")


def write_one_row(df: DataFrame, path: str) -> None:
    """A one-row JSON object as the file ``path``: written under another name,
    then put in place by a rename that replaces, so a reader - or a run that was
    stopped - finds the old row or the new one."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target, fresh = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(fresh)
    try:
        out.write(bytearray((df.toJSON().first() + "\n").encode()))
    finally:
        out.close()
    files = hadoop.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(files.makeQualified(fresh), files.makeQualified(target), options)


PROGRESS_FIELDS = ("elapsed_seconds", "ready_workers", "seen_rows", "skipped_existing",
                   "submitted_for_inference", "completed_successfully", "inference_errors",
                   "updated_at_unix")


def progress_row(spark: SparkSession, started_at: float, ready: int, counters: dict) -> DataFrame:
    """Progress snapshot from counters (e.g. an ``Observation`` or a stream's
    ``lastProgress`` metrics) as a one-row DataFrame."""
    now = time.time()
    row = (int(now - started_at), int(ready), int(counters.get("seen", 0)),
           int(counters.get("skipped", 0)), int(counters.get("submitted", 0)),
           int(counters.get("successful", 0)), int(counters.get("errors", 0)), float(now))
    return spark.createDataFrame([row], ", ".join(
        f"{f} {'double' if f == 'updated_at_unix' else 'bigint'}" for f in PROGRESS_FIELDS))


def summary_json(counters_row) -> str:
    """The final counters as the summary JSON text."""
    d = counters_row.asDict() if hasattr(counters_row, "asDict") else dict(counters_row)
    return json.dumps({k: int(d[k]) for k in ("seen", "skipped_existing", "submitted", "successful", "errors")},
                      indent=2)
