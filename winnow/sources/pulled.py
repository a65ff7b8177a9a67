"""A pulled source: all rows of a dataset's configs and splits, with their positions.

Layout: ``<path>/__config=<name>/__split=<name>/<file>.parquet``
(:func:`write_splits` writes it). The rows of a split are those of its files in the
order of the file names, numbers in names read as numbers; ``row_index`` is a row's
place in that order. It comes from the row counts in the files' footers, so positions
need no shuffle and a split of any size is read by many tasks.

* Batch (:func:`pull_source`): one partition for each row group.
* Stream (:func:`pull_stream`): the offset says for each split how many files and rows
  are taken and which file was the last. A restarted query goes on behind it, with
  positions that go on as well. New files must sort after those taken; a file that
  appears before them would shift positions and is refused.

Rows come as Arrow batches. Files are opened through ``pyarrow.fs``, on the executors.
Defined results: a missing config name is ``default``, a missing split NULL; an empty
folder has no rows; fields of a row stay in their own struct, so their names never clash.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from winnow.functions.keys import canonical_sample
from winnow.session import path_exists, ship_package
from winnow.sources.jobs import DEFAULT_CONFIG, JOB_COLUMNS, Source

FORMAT = "winnow_pulled"
CONFIG, SPLIT = "__config", "__split"
# How Spark names the folder of a NULL partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
BATCH_ROWS = 1_000
FOOTER_READERS = 32


def write_splits(source: Source, path: str) -> None:
    """A source's rows as files of its splits, in the source's order; a large split
    spans many files, cut by sampled ranges of the order."""
    order = [CONFIG, SPLIT, *source.order]
    config, split = source.tags()
    rows = source.frame.select("*", config.alias(CONFIG), split.alias(SPLIT))
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
         .write.partitionBy(CONFIG, SPLIT).parquet(path))


def _opened(path: str):
    """(file system, path inside it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def name_order(name: str) -> list:
    """Sort key of a file name: runs of digits count as numbers."""
    return [int(part) if i % 2 else part for i, part in enumerate(re.split(r"(\d+)", name))]


def split_files(path: str) -> dict[tuple, list[str]]:
    """(config, split) folder names -> file paths in reading order."""
    system, root = _opened(path)
    found: dict[tuple, list[str]] = {}
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        match = re.search(rf"/{CONFIG}=([^/]*)/{SPLIT}=([^/]*)/([^/._][^/]*\.parquet)$", info.path)
        if match and info.type == fs.FileType.File:
            found.setdefault(match.groups()[:2], []).append(info.path)
    return {key: sorted(files, key=lambda f: name_order(f.rsplit("/", 1)[1])) for key, files in sorted(found.items())}


@dataclass
class RowGroup(InputPartition):
    """One row group and the position of its first row in the split."""
    path: str
    group: int
    config: str
    split: str | None
    start: int

    def __post_init__(self):
        super().__init__(None)


def _group_rows(path: str, files: list[str]) -> list[list[int]]:
    """Rows of each row group of each file, from the footers."""
    system, _ = _opened(path)

    def footer(file: str) -> list[int]:
        with system.open_input_file(file) as f:
            meta = pq.read_metadata(f)
        return [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]

    with ThreadPoolExecutor(FOOTER_READERS) as pool:
        return list(pool.map(footer, files))


def _row_groups(path: str, key: tuple, files: list[str], start: int) -> list[RowGroup]:
    config, split = (None if v == NO_VALUE else unquote(v) for v in key)
    out = []
    for file, groups in zip(files, _group_rows(path, files)):
        for number, rows in enumerate(groups):
            out.append(RowGroup(file, number, config or DEFAULT_CONFIG, split, start))
            start += rows
    return out


class _Reading:
    """How a partition is read, by either reader."""

    def __init__(self, path: str, dataset: str):
        self.path, self.dataset = path, dataset

    def read(self, part: RowGroup | None):
        if part is None:  # a batch without any partition
            return
        system, _ = _opened(self.path)
        place = part.start
        with system.open_input_file(part.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH_ROWS, row_groups=[part.group]):
                n = batch.num_rows
                row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(v, pa.string()), n) for v in (self.dataset, part.config, part.split)]
                    + [pa.array(range(place, place + n), pa.int64()), row],
                    ["source_dataset", "config", "split", "row_index", "row"])
                place += n


class PulledBatch(_Reading, DataSourceReader):
    def partitions(self):
        return [group for key, files in split_files(self.path).items()
                for group in _row_groups(self.path, key, files, 0)]


class PulledStream(_Reading, DataSourceStreamReader):
    """Offset: ``{"<config folder>/<split folder>": {"files", "rows", "last"}}``."""

    def __init__(self, path: str, dataset: str):
        super().__init__(path, dataset)
        self.known: dict[str, int] = {}  # rows of the files met by this run

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for key, files in split_files(self.path).items():
            fresh = [f for f in files if f not in self.known]
            self.known.update((f, sum(groups)) for f, groups in zip(fresh, _group_rows(self.path, fresh)))
            out["/".join(key)] = {"files": len(files), "rows": sum(self.known[f] for f in files),
                                  "last": files[-1].rsplit("/", 1)[1]}
        return out

    def partitions(self, start: dict, end: dict):
        out = []
        listed = split_files(self.path)
        for name, upto in end.items():
            taken = start.get(name, {"files": 0, "rows": 0})
            key = tuple(name.split("/"))
            files = listed.get(key, [])
            for mark in (taken, upto):
                at = mark["files"]
                if at and (len(files) < at or files[at - 1].rsplit("/", 1)[1] != mark["last"]):
                    raise ValueError(f"files of split {name} changed up to {mark['last']}: positions would shift")
            out += _row_groups(self.path, key, files[taken["files"]:upto["files"]], taken["rows"])
        return out


class PulledSource(DataSource):
    """Options ``path`` and ``dataset``; the reader's schema is given by the caller."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> PulledBatch:
        return PulledBatch(self.options["path"], self.options["dataset"])

    def streamReader(self, schema: T.StructType) -> PulledStream:
        return PulledStream(self.options["path"], self.options["dataset"])


def pulled_schema(row: T.StructType) -> T.StructType:
    return (T.StructType().add("source_dataset", "string").add("config", "string").add("split", "string")
            .add("row_index", "long").add("row", row))


def row_schema(spark: SparkSession, path: str) -> T.StructType:
    """The fields of the files' rows (an empty folder: none)."""
    if not path_exists(spark, f"{path.rstrip('/')}/{CONFIG}=*"):
        return T.StructType()
    return spark.read.parquet(path).drop(CONFIG, SPLIT).schema


def _prepared(spark: SparkSession, reader, path: str, dataset: str, row: T.StructType) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(PulledSource)
    return reader.format(FORMAT).schema(pulled_schema(row)).options(path=path, dataset=dataset).load()


def pull_source(spark: SparkSession, path: str, dataset: str, row: T.StructType | None = None) -> DataFrame:
    """(source_dataset, config, split, row_index, row) of every row below ``path``."""
    return _prepared(spark, spark.read, path, dataset, row or row_schema(spark, path))


def pull_stream(spark: SparkSession, path: str, dataset: str, row: T.StructType | None = None) -> DataFrame:
    """The same rows as a stream; what arrives later needs a known ``row`` schema only
    if the folder is still empty."""
    return _prepared(spark, spark.readStream, path, dataset, row or row_schema(spark, path))


def pulled_jobs(pulled: DataFrame) -> DataFrame:
    """Pulled rows as job rows: the row as its canonical sample."""
    names = pulled.schema["row"].dataType.names
    tags = [F.col(c).alias(f"__tag_{c}") for c in JOB_COLUMNS[:-1]]
    flat = pulled.select(*tags, *[F.col("row").getField(n).alias(n) for n in names])
    return flat.select(*[F.col(f"__tag_{c}").alias(c) for c in JOB_COLUMNS[:-1]],
                       canonical_sample(flat, names).alias("sample"))
