import json

from pyspark.sql import functions as F

from winnow.operators.classify import CATEGORY_FILES
from winnow.operators.merge import completed_keys, merge_shards
from winnow.sources.sinks import write_final

U5, S5 = CATEGORY_FILES[0][1], CATEGORY_FILES[2][1]


def rec(key, cls, status, **extra):
    r = {"source_dataset": "d", "config": "c", "split": "s", "row_index": 0, "sample": "{}",
         "classification": cls, "reason": "r", "confidence": 5, "parse_status": status,
         "raw_model_output": "", "model": "m", "example_id": key}
    r.update(extra)
    return json.dumps(r)


ERR = "inference_error: RuntimeError: x"
SHARDS = [
    (U5, 0, 0, rec("A", "unsafe", ERR)), (S5, 0, 3, rec("A", "safe", "ok")),
    (S5, 0, 1, rec("B", "safe", "ok", raw_model_output="first")), (S5, 0, 7, rec("B", "safe", "ok")),
    (U5, 0, 2, rec("C", "unsafe", ERR, raw_model_output="first")), (U5, 0, 9, rec("C", "unsafe", ERR)),
    (S5, 0, 0, rec("D", "safe", "ok")), (U5, 0, 5, rec("D", "unsafe", "ok")),
    (S5, 0, 11, '{"example_id": "E", "classif'),
]
SCHEMA = "category string, rank int, line long, value string"


def winners(df):
    return {r.example_id: (r.category, r.line, r.classification) for r in df.collect()}


def test_merge_edge_rows(spark):
    w = winners(merge_shards(spark.createDataFrame(SHARDS, SCHEMA)))
    assert w["A"] == (S5, 3, "safe")
    assert w["B"][1] == 1
    assert w["C"][1] == 2
    assert w["D"] == (U5, 5, "unsafe")
    assert "E" not in w  # cut-off line skipped


def test_merge_independent_of_partitioning_and_idempotent(spark):
    df = spark.createDataFrame(SHARDS, SCHEMA)
    a = winners(merge_shards(df))
    b = winners(merge_shards(df.repartition(7, "line")))
    assert a == b
    again = merge_shards(df).select(F.col("category"), F.lit(0).alias("rank"), F.col("line"),
                                    F.to_json(F.struct("source_dataset", "config", "split", "row_index", "sample",
                                                       "classification", "reason", "confidence", "parse_status",
                                                       "raw_model_output", "model", "example_id")).alias("value"))
    assert winners(merge_shards(again)) == a


def test_final_records_keep_further_fields(spark, tmp_dir):
    won = rec("A", "safe", "ok", note={"by": "x", "n": [1, 2.50]}, older="é")
    odd = rec("F", "neither", "ok", tag=None)
    rows = [(U5, 0, 0, rec("A", "unsafe", ERR, lost=1)), (S5, 0, 3, won), (S5, 1, 0, rec("A", "safe", "ok", lost=2)),
            (U5, 0, 4, odd)]
    merged = merge_shards(spark.createDataFrame(rows, SCHEMA))
    assert {r.example_id: r.record for r in merged.collect()} == {"A": won, "F": odd}
    write_final(merged, f"{tmp_dir}/final")
    got = {(r.category, json.dumps(json.loads(r.value))) for r in spark.read.text(f"{tmp_dir}/final").collect()}
    assert got == {(S5, won), ("rejects", odd)}


def test_completed_filter_cases(spark):
    def drop(line, field):
        return json.dumps({k: v for k, v in json.loads(line).items() if k != field})
    lines = [
        rec("k0", "safe", "ok", row_index=0),
        drop(rec("k1", "safe", "ok", row_index=1), "parse_status"),
        rec("k2", "unsafe", "oom_fallback", row_index=2),
        rec("k3", "unsafe", "inference_error: X: y", row_index=3),
        drop(rec("k4", "safe", "ok", row_index=4), "split"),
        rec("k5", "safe", "ok", row_index=5)[:30],
        "",
    ]
    df = spark.createDataFrame([(l,) for l in lines], "value string")
    keys = {r.example_id for r in completed_keys(df).collect()}
    assert keys == {f"d\x1fc\x1fs\x1f{i}" for i in (0, 1, 2)}


def test_final_outputs_label_each_row_once(spark, monkeypatch):
    """The run appended again used to label all rows again."""
    from winnow.plans import q_flows
    done, plain = spark.sparkContext.accumulator(0), q_flows.classified
    told = F.udf(lambda s: done.add(1) or s, "string").asNondeterministic()
    monkeypatch.setattr(q_flows, "classified",
                        lambda *a: plain(*a).withColumn("parse_status", told("parse_status")))
    assert q_flows.q_write_final(spark, "/root/testdata/sf0.001").count() == done.value > 0
