"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import checkpoint_dir, scratch_path, ship_package

# Rows of one Arrow batch between the JVM and a Python worker. Texts may be
# long, so batches are counted in hundreds of rows, not in Spark's 10,000.
ARROW_ROWS = 400


def prepare(spark: SparkSession) -> None:
    """Session state every operator with Python workers relies on."""
    ship_package(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared checkpoint folder and read back: several
    consumers share one result and a lost executor re-reads the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(left: Column, right: Column) -> Column:
    """Equality that also matches NULL with NULL."""
    return left.eqNullSafe(right)


def blobs(column: pa.Array) -> list[bytes]:
    """Strings or binaries of an Arrow column as bytes (NULL: empty)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))


def keep_once(docs: DataFrame, judged: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows of ``docs`` whose keys ``judged`` says stay, one row for each key.

    ``judged`` has one row per row of ``docs``: its keys as ``k0, k1, ...`` (NULL
    matches NULL) and ``stays``. Rows that repeat under one key are reduced to
    one; only those are gathered for it.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    asked = [f"k{i}" for i in range(len(keys))]
    wanted = (judged.groupBy(*asked).agg(F.max("stays").alias("stays"), (F.count(F.lit(1)) > 1).alias("__often"))
              .where("stays").drop("stays"))
    tagged = docs.select("*", *[c.alias(n) for n, c in zip(names, keys)])
    stay = tagged.join(wanted, reduce(and_, [same(F.col(n), F.col(k)) for n, k in zip(names, asked)]))
    stay = stay.select(*[F.col(c) for c in tagged.columns], "__often")
    single, several = stay.where(~F.col("__often")), stay.where(F.col("__often")).dropDuplicates(names)
    return single.unionByName(several).select(*docs.columns)
