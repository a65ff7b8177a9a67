import json

import pytest
from pyspark.sql import functions as F

from winnow.operators import bpe
from winnow.operators.report import token_report
from winnow.sources.jobs import given_sources, scan_sources, validate_choice
from winnow.sources.sinks import PROGRESS_FIELDS, progress_row, run_manifest, summary_json, write_one_row

SF = "/root/testdata/sf0.001"


def test_manifest_progress_summary(spark, tmp_dir):
    m = run_manifest(spark, "terms", ["a", "b"], 1, started_at=1.5).collect()[0]
    assert m.num_gpus == 1 and m.max_new_tokens == 1 and m.one_model_call_per_example and m.started_at_unix == 1.5
    p = progress_row(spark, 0.0, 1, {"seen": 5, "skipped": 2, "submitted": 3, "successful": 3, "errors": 0})
    assert tuple(p.columns) == PROGRESS_FIELDS
    write_one_row(p, tmp_dir + "/progress")
    back = spark.read.json(tmp_dir + "/progress").collect()[0]
    assert back.seen_rows == 5 and back.skipped_existing == 2
    s = json.loads(summary_json({"seen": 5, "skipped_existing": 2, "submitted": 3, "successful": 3, "errors": 0}))
    assert s == {"seen": 5, "skipped_existing": 2, "submitted": 3, "successful": 3, "errors": 0}


def test_source_choice(spark):
    assert validate_choice(None, ["a", "b"]) == ["a", "b"]
    assert validate_choice(["b"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        validate_choice(["zzz"], ["a", "b"])
    jobs = scan_sources(given_sources(spark, SF), chosen=["documents"])
    assert {r.source_dataset for r in jobs.select("source_dataset").distinct().collect()} == {"documents"}


def test_token_report_bpe_hook(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    vocab, merges = bpe.bpe_train(spark, bpe.word_counts(conv, "text"), num_merges=5)
    texts = conv.select(F.to_json(F.struct(F.col("text"))).alias("sample"))
    total = bpe.bpe_token_total(conv, vocab, merges)
    r = token_report(texts, "bpe", token_total=total).collect()[0]
    assert r.total_tokens == total.collect()[0].total_tokens and r.tokenizer == "bpe"
    assert r.rows == conv.count()
