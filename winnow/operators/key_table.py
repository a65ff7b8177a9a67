"""Completed keys as a table of its own: sorted buckets, delta tables, compaction.

Finding the completed keys in the records means reading every record again. Here a
run appends the keys it completed as a delta table, and a later run anti-joins its
jobs with the table:

- base and deltas are bucketed on the key into the same number of sorted files, so
  an anti join shuffles the jobs once and no table at all;
- they are partitioned by source, so a run over chosen sources reads the
  partitions of those sources alone;
- a delta holds new keys only, so tables are disjoint; when ``fan`` deltas are
  there, they and the base are merged into the next base;
- which tables are live is one small JSON file, replaced by rename: a reader finds
  the tables before an append or compaction or those after it. Files that are no
  longer live stay for readers still at work.

Keys and sources may be NULL: NULL keys are not kept (they never match), a NULL
source is a partition of its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import path_exists, scratch_path, shuffle_width
from winnow.sources.sinks import write_one_row

KEY, SOURCE = "example_id", "source_dataset"
FAN = 4


class KeyTable:
    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fan: int = FAN):
        """The table below ``folder`` (a new one if it holds none)."""
        self.spark, self.fan = spark, fan
        self.folder = (folder or scratch_path(spark, "keys")).rstrip("/")
        self._tag = uuid.uuid4().hex[:8]
        self.live: list[str] = []
        self.buckets = buckets or shuffle_width(spark)
        if path_exists(spark, f"{self.folder}/live.json"):
            state = json.loads(spark.read.text(f"{self.folder}/live.json").first()[0])
            self.buckets = state["buckets"]
            for name in state["live"]:
                spark.sql(f"CREATE TABLE {self._name(name)} ({KEY} STRING, {SOURCE} STRING) USING parquet "
                          f"PARTITIONED BY ({SOURCE}) CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS "
                          f"LOCATION '{self.folder}/{name}'")
                # Partitions are found by listing their folders.
                spark.sql(f"MSCK REPAIR TABLE {self._name(name)}")
                self.live.append(name)

    def _name(self, name: str) -> str:
        return f"completed_keys_{self._tag}_{name}"

    def _write(self, keys: DataFrame, kind: str) -> str:
        name = f"{kind}_{uuid.uuid4().hex[:8]}"
        (keys.select(KEY, SOURCE).repartition(self.buckets, KEY).write.format("parquet").partitionBy(SOURCE)
         .bucketBy(self.buckets, KEY).sortBy(KEY).option("path", f"{self.folder}/{name}").saveAsTable(self._name(name)))
        return name

    def _publish(self, live: list[str]) -> None:
        row = self.spark.createDataFrame([(live, self.buckets)], "live array<string>, buckets int")
        write_one_row(row, f"{self.folder}/live.json")
        self.live = live

    def tables(self, sources=None) -> list[DataFrame]:
        found = [self.spark.table(self._name(n)) for n in self.live]
        return [t.where(F.col(SOURCE).isin(list(sources))) if sources is not None else t for t in found]

    def keys(self) -> DataFrame:
        """All completed keys (``example_id``), each once."""
        none = self.spark.createDataFrame([], f"{KEY} string")
        for t in self.tables():
            none = none.unionByName(t.select(KEY))
        return none

    def todo(self, jobs: DataFrame, sources=None) -> DataFrame:
        """Jobs whose key is not completed; ``sources`` names those the jobs come from."""
        if sources is not None:
            jobs = jobs.where(F.col(SOURCE).isin(list(sources)))
        for t in self.tables(sources):
            jobs = jobs.join(t.select(KEY).hint("merge"), KEY, "left_anti")
        return jobs

    def append(self, completed: DataFrame) -> None:
        """Add keys (``example_id``, ``source_dataset``); repeated and known ones are
        added once. Below ``fan`` deltas one is written, else all becomes the base."""
        fresh = completed.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min(SOURCE).alias(SOURCE))
        # Written first: the anti joins then meet one row per key.
        delta = self._write(fresh, "delta")
        if self.live:
            delta = self._write(self.todo(self.spark.table(self._name(delta))), "delta")
        live = [*self.live, delta]
        if sum(n.startswith("delta") for n in live) > self.fan:
            whole = self.spark.table(self._name(live[0])).select(KEY, SOURCE)
            for name in live[1:]:
                whole = whole.unionByName(self.spark.table(self._name(name)).select(KEY, SOURCE))
            live = [self._write(whole, "base")]
        self._publish(live)


__all__ = ["KeyTable"]
