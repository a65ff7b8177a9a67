"""The pulled source: positions from files, streams that go on after a restart."""

import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.sources.jobs import Source, given_sources, scan_sources
from winnow.sources.pulled import name_order, pull_source, pull_stream, pulled_jobs, write_splits

SF = "/root/testdata/sf0.001"
ROW = T.StructType().add("config", "string").add("n", "long")


def put(path, config, split, name, numbers, group=3):
    folder = f"{path}/__config={config}/__split={split}"
    os.makedirs(folder, exist_ok=True)
    table = pa.table({"config": [f"c{n}" for n in numbers], "n": pa.array(numbers, pa.int64())})
    pq.write_table(table, f"{folder}/{name}", row_group_size=group)


def rows(df):
    return sorted((r.config, r.split or "", r.row_index, r.row.n) for r in df.collect())


def run(spark, path, out, state):
    query = (pull_stream(spark, path, "d", ROW).writeStream.format("parquet").option("checkpointLocation", state)
             .option("path", out).trigger(availableNow=True).start())
    query.awaitTermination()


def test_same_rows_as_the_scan(spark, tmp_dir):
    sources = given_sources(spark, SF)
    want = {tuple(r) for r in scan_sources(sources).collect()}
    got = []
    for source in sources:
        write_splits(source, f"{tmp_dir}/{source.name}")
        got += [tuple(r) for r in pulled_jobs(pull_source(spark, f"{tmp_dir}/{source.name}", source.name)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_positions_follow_names_as_numbers(spark, tmp_dir):
    assert sorted(["p-10.parquet", "p-9.parquet", "p-009b"], key=name_order) == ["p-9.parquet", "p-009b", "p-10.parquet"]
    put(tmp_dir, "a%20b", "s", "p-10.parquet", [20, 21])
    put(tmp_dir, "a%20b", "s", "p-9.parquet", list(range(7)))
    put(tmp_dir, "__HIVE_DEFAULT_PARTITION__", "__HIVE_DEFAULT_PARTITION__", "p-0.parquet", [5])
    put(tmp_dir, "a%20b", "s", "_hidden.parquet", [99])
    pulled = pull_source(spark, tmp_dir, "d")
    assert rows(pulled) == [("a b", "s", i, i) for i in range(7)] + [("a b", "s", 7, 20), ("a b", "s", 8, 21), ("default", "", 0, 5)]
    # A partition for each row group; the row's own config field does not clash.
    assert pulled.rdd.getNumPartitions() == 5
    assert {r.sample for r in pulled_jobs(pulled).where("split IS NULL").collect()} == {'{"config":"c5","n":5}'}


def test_a_hot_split_spans_many_files(spark, tmp_dir):
    frame = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("part"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_splits(Source("s", frame, ("id",), split="part", split_is_column=True), f"{tmp_dir}/s")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = f"{tmp_dir}/s/__config=default/__split=hot"
    assert len([f for f in os.listdir(hot) if f.endswith(".parquet")]) > 2
    got = pull_source(spark, f"{tmp_dir}/s", "s").where("split = 'hot'").orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(len(got)))
    assert [r.row.id for r in got] == [i for i in range(4000) if i % 3 > 0]


def test_stream_goes_on_behind_its_offset(spark, tmp_dir):
    path, out, state = (f"{tmp_dir}/{n}" for n in ("in", "out", "state"))
    put(path, "c", "s", "p-1.parquet", list(range(5)))
    run(spark, path, out, state)
    run(spark, path, out, state)  # nothing new
    put(path, "c", "s", "p-2.parquet", [50, 51])
    put(path, "c", "t", "p-1.parquet", [70])
    run(spark, path, out, state)
    want = [("c", "s", i, n) for i, n in enumerate([0, 1, 2, 3, 4, 50, 51])] + [("c", "t", 0, 70)]
    assert rows(spark.read.parquet(out)) == want == rows(pull_source(spark, path, "d"))
    put(path, "c", "s", "p-0.parquet", [9])
    with pytest.raises(Exception, match="positions would shift"):
        run(spark, path, out, state)
    assert rows(spark.read.parquet(out)) == want


def test_empty_folder(spark, tmp_dir):
    path = f"{tmp_dir}/{uuid.uuid4().hex}"
    assert pull_source(spark, path, "d", ROW).count() == 0
    assert pull_source(spark, path, "d").columns == ["source_dataset", "config", "split", "row_index", "row"]
