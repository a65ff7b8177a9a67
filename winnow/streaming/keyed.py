"""Labelling stream whose memory of finished keys is keyed state.

``readStream`` over a folder of job files -> key -> ``transformWithState`` by bucket,
a hash of the key. The state of a bucket is the list of its labelled keys. A row whose
key is in it is passed over; any other row is scored, and only a labelled one is added,
so a failed row is tried again whenever it comes back - in a later batch, after a
restart, or within one batch. (``dropDuplicates`` would remember failures too.)

A group costs the worker several calls to the state store however few rows it has, so
a group of its own for each key costs far more than the scoring. There are ``BUCKETS``
groups at most; a batch reads and writes the lists of the buckets that it has rows of. The
number belongs to a checkpoint's state, as a key's bucket does: changing it needs a new one.

The lists live in Spark's state store (RocksDB, one per shuffle partition) and are
versioned with the stream's checkpoint. The sink is read once, when a stream starts
under a new checkpoint: the keys labelled by earlier streams are its initial state,
and the next run number follows the largest one there. No batch reads the sink.

A batch stopped between its write and its commit is done again from the state
before it, and writes the same keys under the same run number; the shard merge keeps
one record of each.

Progress: counts are observed in the batch's own pass and reach a query listener,
which keeps a log - one row when another ``every`` results have come in, one when the
query ends - and replaces the file ``_progress`` by rename.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from winnow.functions.keys import example_key
from winnow.operators.classify import LabelTokens
from winnow.operators.scoring import ANSWER_SCHEMA, TOKEN_LIMITS, answer, label_answers
from winnow.session import materialize, path_exists, ship_package
from winnow.sources.sinks import PROGRESS_FIELDS, progress_row, route_append, write_one_row
from winnow.streaming.labeller import JOB_SCHEMA, done_keys, next_run, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys in the state.
BUCKETS = 8192
#: Results between two rows of the progress log.
PROGRESS_EVERY = 100


class LabelOnce(StatefulProcessor):
    """Scores the rows of keys that are not labelled yet."""

    def __init__(self, model_fn, limits=TOKEN_LIMITS):
        self.model_fn, self.limits = model_fn, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("labelled", "keys array<string>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.done.update((list(initialState["keys"]),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.done.get()
        labelled = set(state[0]) if state else set()
        known, told = len(labelled), None
        for row in rows:
            told = told or Row(*row.__fields__, "token_id", "decoded", "limit_used", "error", "skipped")
            if row.example_id in labelled:
                yield told(*row, None, None, None, None, True)
                continue
            token, decoded, limit, error = answer(row.sample, self.model_fn, self.limits)
            # A row that never fitted counts as labelled (its status says so).
            if error is None or error == "oom":
                labelled.add(row.example_id)
            yield told(*row, token, decoded, limit, error, False)
        if len(labelled) > known:
            self.done.update((list(labelled),))

    def close(self) -> None:
        pass


class ProgressLog(StreamingQueryListener):
    """Counters of one run, from the metrics its batches observed."""

    def __init__(self, spark: SparkSession, output_dir: str, run: str, every: int = PROGRESS_EVERY):
        self.spark, self.path, self.run, self.every = spark, f"{output_dir.rstrip('/')}/_progress", run, every
        self.started, self.told, self.ended = time.time(), 0, threading.Event()
        self.counters = dict.fromkeys(("seen", "skipped", "submitted", "successful", "errors"), 0)
        self.rows: list[dict] = []

    def _tell(self) -> None:
        row = progress_row(self.spark, self.started, 1, self.counters)
        self.rows.append(row.first().asDict())
        write_one_row(row, self.path)
        self.told = self.counters["submitted"]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.run)
        if found is None:
            return
        for name, value in found.asDict().items():
            self.counters[name] += value
        if self.counters["submitted"] // self.every > self.told // self.every:
            self._tell()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def stream_label(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str, model_fn,
                 tokens: LabelTokens | None = None, model: str = "user", max_files_per_trigger: int | None = None,
                 every: int = PROGRESS_EVERY) -> DataFrame:
    """Label everything now in ``input_dir`` with a per-row model (trigger
    availableNow) and stop; returns the run's progress log. Run it again after a
    crash, with new files or under a new checkpoint: labelled keys are passed over,
    failed ones tried again."""
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    reader = spark.readStream.schema(JOB_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    bucket = F.pmod(F.xxhash64("example_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    keyed = reader.json(input_dir).withColumn("example_id", example_key()).select("*", bucket)
    # The sink's keys seed the first batch of a checkpoint only.
    known = path_exists(spark, f"{checkpoint.rstrip('/')}/commits")
    sink = written(spark, output_dir)
    if not known:
        sink = materialize(sink, "sink-keys")
    done = spark.createDataFrame([], "example_id string") if known else done_keys(sink)
    seed = done.groupBy(bucket).agg(F.collect_list("example_id").alias("keys"))
    run_id = next_run(sink)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields) + ANSWER_SCHEMA + ", skipped boolean"
    tried = keyed.groupBy("bucket").transformWithState(
        LabelOnce(model_fn), schema, "append", "none", initialState=seed.groupBy("bucket")).drop("bucket")
    name = f"labelling_{run_id}_{int(time.time() * 1000)}"
    failed = F.col("error").isNotNull() & (F.col("error") != "oom")
    counted = tried.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if("skipped").alias("skipped"),
                            F.count_if(~F.col("skipped")).alias("submitted"),
                            F.count_if(~F.col("skipped") & ~failed).alias("successful"),
                            F.count_if(~F.col("skipped") & failed).alias("errors"))
    log = ProgressLog(spark, output_dir, name, every)
    spark.streams.addListener(log)

    def each(batch: DataFrame, _: int) -> None:
        route_append(label_answers(batch.where(~F.col("skipped")).drop("skipped"), tokens, model), output_dir, run_id)

    try:
        query = (counted.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        # Events come in order: after the last one all counts are in.
        log.ended.wait(60)
    finally:
        spark.streams.removeListener(log)
    log._tell()
    return spark.createDataFrame([Row(**r) for r in log.rows], ", ".join(
        f"{f} {'double' if f == 'updated_at_unix' else 'bigint'}" for f in PROGRESS_FIELDS))


__all__ = ["stream_label", "LabelOnce", "ProgressLog"]
