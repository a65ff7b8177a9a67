"""One labelling run with its summary from the write's own pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from winnow.operators.merge import is_error_status, resume_anti
from winnow.sources.sinks import route_append, write_one_row

#: The fields of a run's summary, in order.
SUMMARY_FIELDS = ("seen", "skipped_existing", "submitted", "successful", "errors")


def label_run(jobs: DataFrame, completed: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, run_id: int,
              key: str = "example_id") -> DataFrame:
    """Label the jobs that are not completed, append their records below ``path``
    and put the summary in place as ``path``.summary.json by an atomic rename;
    returns the summary read back.

    All counts are observed while the records are written: jobs as they come in,
    records as they go out. Nothing is scanned a second time. A summary is there
    only when all records of its run are.
    """
    spark = jobs.sparkSession
    intake, outcome = (Observation(f"{name}-{uuid.uuid4().hex}") for name in ("intake", "outcome"))
    todo = resume_anti(jobs.observe(intake, F.count(F.lit(1)).alias("seen")), completed, key)
    failed = is_error_status("parse_status")
    records = label(todo).observe(outcome, F.count(F.lit(1)).alias("submitted"), F.count_if(~failed).alias("successful"),
                                  F.count_if(failed).alias("errors"))
    route_append(records, path, run_id)
    counts = {**intake.get, **outcome.get}
    counts["skipped_existing"] = counts["seen"] - counts["submitted"]
    schema = ", ".join(f"{f} bigint" for f in SUMMARY_FIELDS)
    target = f"{path.rstrip('/')}.summary.json"
    write_one_row(spark.createDataFrame([tuple(counts[f] for f in SUMMARY_FIELDS)], schema), target)
    return spark.read.schema(schema).json(target)


__all__ = ["label_run", "SUMMARY_FIELDS"]
