"""Restartable labelling stream.

``readStream`` over a folder of job files (JSON lines) -> key -> per
micro-batch: skip keys already labelled successfully (``left_anti`` against
the records in the sink) -> classify -> append records, in one write. The
stream checkpoint remembers which input files were consumed, so a restart
does not re-read them. Done keys are read from the records themselves, so a
batch replayed after its write adds nothing, a batch stopped before it left
nothing behind, and failed rows (status ``inference_error``) are labelled again
later. The state is the sink, not a streaming state store: ``dropDuplicates``
would remember failed keys too and block their retry. Ranks (run numbers) go on
from the largest one in the sink, also under a new checkpoint.

Counters per batch (seen, skipped, submitted, successful, errors) come from
``observe`` and are written as the progress record.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from winnow.functions.keys import example_key
from winnow.operators.classify import build_label_tokens, classify, scorer_terms
from winnow.operators.merge import is_error_status
from winnow.session import path_exists
from winnow.sources.sinks import progress_row, route_append, write_one_row

JOB_SCHEMA = "source_dataset string, config string, split string, row_index bigint, sample string"


def written(spark: SparkSession, output_dir: str) -> DataFrame:
    """(example_id, parse_status, rank) of all records in the sink."""
    schema = "example_id string, parse_status string, rank int"
    if not path_exists(spark, f"{output_dir.rstrip('/')}/category=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{output_dir.rstrip('/')}/category=*")


def done_keys(sink: DataFrame) -> DataFrame:
    """Keys labelled successfully among the :func:`written` records."""
    done = sink.where(~is_error_status("parse_status") & F.col("example_id").isNotNull())
    return done.select("example_id").distinct()


def next_run(sink: DataFrame) -> int:
    """A run number above every one of the :func:`written` records."""
    last = sink.agg(F.max("rank")).first()[0]
    return 0 if last is None else last + 1


def label_batch(spark: SparkSession, jobs: DataFrame, output_dir: str, run_id: int, scorer=scorer_terms,
                tokens=None, model: str = "terms", started_at: float | None = None, model_fn=None) -> dict:
    """One micro-batch (also usable as a plain batch job).

    ``model_fn``: a per-row model (see
    :func:`winnow.operators.scoring.classify_with_model`) used instead of
    ``scorer``; the skip-done anti join is planned before it.
    """
    tokens = tokens or build_label_tokens()
    keyed = jobs.withColumn("example_id", example_key())
    seen_obs = Observation(f"intake_{run_id}")
    keyed = keyed.observe(seen_obs, F.count(F.lit(1)).alias("seen"))
    todo = keyed.join(done_keys(written(spark, output_dir)), "example_id", "left_anti")
    if model_fn is not None:
        from winnow.operators.scoring import classify_with_model
        recs = classify_with_model(todo, model_fn, tokens, model).persist()
    else:
        recs = classify(todo, scorer, tokens, model).persist()
    out_obs = Observation(f"results_{run_id}")
    recs = recs.observe(out_obs, F.count(F.lit(1)).alias("submitted"),
                        F.count_if(~is_error_status("parse_status")).alias("successful"),
                        F.count_if(is_error_status("parse_status")).alias("errors"))
    route_append(recs, output_dir, run_id=run_id)
    recs.unpersist()
    counters = {**seen_obs.get, **out_obs.get}
    counters["skipped"] = counters["seen"] - counters["submitted"]
    write_one_row(progress_row(spark, started_at or time.time(), 1, counters),
                  f"{output_dir.rstrip('/')}/_progress")
    return counters


def stream_classify(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str, scorer=scorer_terms,
                    tokens=None, model: str = "terms", max_files_per_trigger: int | None = None,
                    model_fn=None) -> list[dict]:
    """Label everything now in ``input_dir`` (trigger availableNow) and stop.

    Returns the per-batch counters. Run it again after a crash or with new
    files: finished keys are skipped, failed ones retried.
    """
    started = time.time()
    reader = spark.readStream.schema(JOB_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.json(input_dir)
    log: list[dict] = []

    def each(batch_df: DataFrame, batch_id: int) -> None:
        log.append(label_batch(spark, batch_df, output_dir, next_run(written(spark, output_dir)), scorer, tokens, model, started, model_fn))

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return log
