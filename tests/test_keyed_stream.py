"""The labelling stream with keyed state: blocks labelled keys, lets failed ones through."""

import json
import os

from pyspark.sql import functions as F

from winnow.operators.merge import merge_shards
from winnow.plans.q_classify import TOKENS, memory_bound_model
from winnow.plans.q_flows import steady_model
from winnow.sources.jobs import given_sources, scan_sources
from winnow.sources.sinks import read_routed
from winnow.streaming import keyed
from winnow.streaming.keyed import stream_label

SF = "/root/testdata/sf0.001"


def counts(log):
    last = log.orderBy(F.desc("submitted_for_inference")).first()
    return (last.seen_rows, last.skipped_existing, last.submitted_for_inference, last.completed_successfully, last.inference_errors)


def records(spark, out):
    return {r.example_id: r.parse_status for r in merge_shards(read_routed(spark, out)).collect()}


def test_failures_come_back_under_one_checkpoint(spark, tmp_dir):
    inp, out, ckpt = (f"{tmp_dir}/{n}" for n in ("in", "out", "ckpt"))
    jobs = scan_sources(given_sources(spark, SF))
    n = jobs.count()
    jobs.repartition(3).write.json(inp)
    seen, skipped, submitted, ok, errors = counts(stream_label(spark, inp, out, ckpt, memory_bound_model, TOKENS, max_files_per_trigger=1))
    assert (seen, skipped, submitted) == (n, 0, n) and ok + errors == n and errors > 0
    # The same rows again as new files: the state lets only failed ones through.
    jobs.coalesce(1).write.mode("append").json(inp)
    assert counts(stream_label(spark, inp, out, ckpt, steady_model, TOKENS)) == (n, n - errors, errors, errors, 0)
    # Nothing new: nothing is read.
    assert counts(stream_label(spark, inp, out, ckpt, steady_model, TOKENS)) == (0, 0, 0, 0, 0)
    assert spark.read.text(out).count() == n + errors
    assert not any(s.startswith("inference_error") for s in records(spark, out).values())
    progress = json.load(open(f"{out}/_progress"))
    assert progress["seen_rows"] == 0 and os.path.exists(f"{ckpt}/state")


def test_a_new_checkpoint_starts_from_the_sink(spark, tmp_dir):
    inp, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    jobs = scan_sources(given_sources(spark, SF), chosen=["documents"])
    n = jobs.count()
    jobs.write.json(inp)
    errors = counts(stream_label(spark, inp, out, f"{tmp_dir}/a", memory_bound_model, TOKENS))[-1]
    assert counts(stream_label(spark, inp, out, f"{tmp_dir}/b", steady_model, TOKENS)) == (n, n - errors, errors, errors, 0)
    assert counts(stream_label(spark, inp, out, f"{tmp_dir}/c", steady_model, TOKENS)) == (n, n, 0, 0, 0)


def test_the_log_has_a_row_for_every_hundred_results(spark, tmp_dir):
    jobs = scan_sources(given_sources(spark, SF), chosen=["documents"])
    n = jobs.count()
    jobs.repartition(4).write.json(f"{tmp_dir}/in")
    log = stream_label(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/c", steady_model, TOKENS, max_files_per_trigger=1,
                       every=max(1, n // 3))
    told = [r.submitted_for_inference for r in log.orderBy("submitted_for_inference").collect()]
    assert 3 <= len(told) <= 5 and told[-1] == n


def test_rows_of_one_key_in_one_batch(spark, tmp_dir):
    rows = [("s", "default", "train", 1, "same")] * 3 + [("s", "default", "train", 2, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, "source_dataset string, config string, split string, row_index bigint, sample string").coalesce(
        1).write.option("ignoreNullFields", "false").json(f"{tmp_dir}/in")
    log = stream_label(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/c", lambda ids: (None, "safe"), TOKENS)
    assert counts(log) == (5, 2, 3, 3, 0)


def test_keys_share_the_groups_of_the_state(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 4, raising=False)
    inp, out, ckpt = (f"{tmp_dir}/{n}" for n in ("in", "out", "ckpt"))
    rows = [("s", "default", "train", i, "text" + "ab"[i % 3 == 0]) for i in range(60)] * 2
    jobs = spark.createDataFrame(rows, "source_dataset string, config string, split string, row_index bigint, sample string")
    jobs.coalesce(2).write.json(inp)

    def failing(ids):
        if ids[-1] == ord("b") + 4:
            raise ValueError("broken")
        return None, "safe"
    assert counts(stream_label(spark, inp, out, ckpt, failing, TOKENS)) == (120, 40, 80, 40, 40)
    state = spark.read.format("statestore").option("stateVarName", "labelled").load(ckpt)
    assert 0 < state.count() <= 4
    # What failed is tried again under this checkpoint and under a new one, which knows the other keys from the sink.
    jobs.coalesce(1).write.mode("append").json(inp)
    assert counts(stream_label(spark, inp, out, ckpt, failing, TOKENS)) == (120, 80, 40, 0, 40)
    assert counts(stream_label(spark, inp, out, f"{tmp_dir}/new", lambda ids: (None, "safe"), TOKENS)) == (240, 220, 20, 20, 0)
    assert not any(s.startswith("inference_error") for s in records(spark, out).values())
