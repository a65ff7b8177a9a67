"""Run summary, completed-key table, shard manifests."""

import json
import os

import pytest
from pyspark.sql import functions as F

from winnow.operators import classify as C
from winnow.operators.key_table import KeyTable
from winnow.operators.runs import SUMMARY_FIELDS, label_run
from winnow.sources.jobs import given_sources, scan_sources, with_example_id
from winnow.sources.shards import latest_version, manifest, restore_shards, write_shards
from winnow.sources.sinks import read_routed

SF = "/root/testdata/sf0.001"
KEYS = "example_id string, source_dataset string"
LINES = "category string, rank int, line long, value string"


def keys(spark, pairs):
    return spark.createDataFrame(pairs, KEYS)


def test_summary_of_a_run(spark, tmp_dir):
    jobs = with_example_id(scan_sources(given_sources(spark, SF)))
    n = jobs.count()
    first = label_run(jobs, keys(spark, []).select("example_id"), lambda t: C.classify(t, C.scorer_terms), f"{tmp_dir}/run", 0)
    assert tuple(first.first()) == (n, 0, n, n, 0)
    done = jobs.where("row_index % 2 = 0").select("example_id")

    def failing(todo):
        return C.classify(todo, C.scorer_terms).withColumn("parse_status", F.lit("inference_error: X: y"))

    second = label_run(jobs, done, failing, f"{tmp_dir}/run", 1).first()
    skipped = done.count()
    assert tuple(second) == (n, skipped, n - skipped, 0, n - skipped)
    assert tuple(json.load(open(f"{tmp_dir}/run.summary.json"))) == SUMMARY_FIELDS
    assert read_routed(spark, f"{tmp_dir}/run").count() == 2 * n - skipped


def test_key_table_appends_compacts_and_opens_again(spark, tmp_dir):
    table = KeyTable(spark, f"{tmp_dir}/keys", fan=2)
    want = set()
    for i in range(6):
        new = [(f"k{j}", f"s{j % 3}") for j in range(i * 5, i * 5 + 10)]
        table.append(keys(spark, new + new + [(None, "s0"), (f"null{i}", None)]))
        want |= {k for k, _ in new} | {f"null{i}"}
    again = KeyTable(spark, f"{tmp_dir}/keys", fan=2)
    assert again.live == table.live and any(n.startswith("base") for n in again.live) and len(again.live) <= 3
    for t in (table, again):
        found = [r[0] for r in t.keys().collect()]
        assert sorted(found) == sorted(want)
    jobs = keys(spark, [("k3", "s0"), ("k3", "s0"), ("new", "s1"), ("new", "s1"), (None, "s1"), ("null2", None)])
    assert sorted(map(str, again.todo(jobs).collect())) == sorted(map(str, [r for r in jobs.collect() if r[0] in ("new", None)]))
    assert KeyTable(spark, f"{tmp_dir}/empty").todo(jobs).count() == 6


def test_key_table_is_neither_shuffled_nor_read_whole(spark, tmp_dir):
    table = KeyTable(spark, f"{tmp_dir}/keys")
    table.append(keys(spark, [(f"a{i}", f"s{i % 4}") for i in range(100)]))
    table.append(keys(spark, [(f"b{i}", f"s{i % 4}") for i in range(100)]))
    jobs = spark.range(50).selectExpr("concat('a', id) AS example_id", "concat('s', id % 4) AS source_dataset")
    plan = table.todo(jobs, sources=["s1", "s2"])._jdf.queryExecution().executedPlan().toString()
    # One exchange: that of the jobs.
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1, plan
    assert plan.count("PartitionFilters: [source_dataset") == 2 and plan.count("Bucketed: true") == 2, plan
    assert table.todo(jobs, sources=["s1", "s2"]).count() == 0


def test_restore_keeps_the_output_side(spark, tmp_dir):
    a, b = C.CATEGORY_FILES[0][1], C.CATEGORY_FILES[2][1]
    old = [(a, 0, i, f'{{"v": "old {i}\\t"}}') for i in range(5)] + [(b, 1, 0, '{"v": "kept"}')]
    write_shards(spark.createDataFrame([(a, 0, 99, "older version")], LINES), f"{tmp_dir}/snap")
    write_shards(spark.createDataFrame(old, LINES).repartition(3), f"{tmp_dir}/snap")
    assert latest_version(spark, f"{tmp_dir}/snap") == 2
    write_shards(spark.createDataFrame([(a, 0, 0, "new line")], LINES), f"{tmp_dir}/out")
    got = sorted(map(tuple, restore_shards(spark, f"{tmp_dir}/out", f"{tmp_dir}/snap").collect()))
    assert got == sorted([(a, 0, 0, "new line"), old[-1]])
    assert sorted(map(tuple, restore_shards(spark, f"{tmp_dir}/none", f"{tmp_dir}/snap").collect())) == sorted(old)


def test_files_without_a_manifest_are_not_read(spark, tmp_dir):
    name = C.CATEGORY_FILES[1][1]
    write_shards(spark.createDataFrame([(name, 0, 0, "line")], LINES), f"{tmp_dir}/out")
    os.makedirs(f"{tmp_dir}/out/v2/name=rank7_{name}")
    with open(f"{tmp_dir}/out/v2/name=rank7_{name}/part-0.txt", "w") as f:
        f.write("0\tof a writer that was stopped\n")
    assert [r.value for r in restore_shards(spark, f"{tmp_dir}/out", None).collect()] == ["line"]
    assert manifest(spark, f"{tmp_dir}/nothing").count() == 0
    assert restore_shards(spark, f"{tmp_dir}/nothing", None).collect() == []


@pytest.mark.parametrize("empty", ["out", "snap"])
def test_restore_of_empty_shards(spark, tmp_dir, empty):
    write_shards(spark.createDataFrame([], LINES), f"{tmp_dir}/{empty}")
    assert restore_shards(spark, f"{tmp_dir}/out", f"{tmp_dir}/snap").collect() == []
