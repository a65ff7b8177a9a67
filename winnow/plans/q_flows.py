"""Queries over whole flows with sinks: routed shards -> merge -> final
outputs, the token report over written record files, the restartable
stream, and scorer B. Intermediate files go to the shared checkpoint
folder; each query returns the result read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import classify as C
from winnow.operators.bpe import bpe_encode, load_vocab, save_vocab
from winnow.operators.merge import merge_shards
from winnow.operators.report import token_report
from winnow.operators.scoring import scorer_model, train_scorer_b
from winnow.plans.common import EXTRACT_SQL, JOBS_SQL, jobs, with_sql
from winnow.plans.q_bpe import MESSAGE_IDS_SQL, trained
from winnow.plans.q_classify import ROW_SCORER_SQL, TOKENS, VERDICT_SQL, classified, memory_bound_model
from winnow.plans.q_jobs import REPORT_SQL
from winnow.plans.registry import query
from winnow.session import materialize, scratch_path
from winnow.sources.jobs import given_sources, scan_sources
from winnow.sources.records import record_samples, scan_records
from winnow.sources.sinks import read_routed, route_append, write_final
from winnow.sources.tables import read_table
from winnow.streaming.keyed import stream_label
from winnow.streaming.labeller import stream_classify

_LABELS_SQL = with_sql(JOBS_SQL, EXTRACT_SQL, VERDICT_SQL, body="""
SELECT example_id, classification, parse_status FROM records""")


@query("write_final", _LABELS_SQL)
def q_write_final(spark, sf_dir):
    """Label once, append twice (a re-run), merge, overwrite the finals, read back."""
    out, final = scratch_path(spark, "routed"), scratch_path(spark, "final")
    recs = materialize(classified(spark, sf_dir), "labelled")
    route_append(recs, out, run_id=0)
    route_append(recs, out, run_id=1)
    write_final(merge_shards(read_routed(spark, out)), final, [out])
    return spark.read.json(final).select("example_id", "classification", "parse_status")


@query("scan_records", REPORT_SQL)
def q_scan_records(spark, sf_dir):
    """Token report over labelled records written as JSON lines and scanned back."""
    out = scratch_path(spark, "records")
    classified(spark, sf_dir).drop("band", "category").write.json(out)
    return token_report(record_samples(scan_records(spark, out)), tokenizer="chars4")


@query("stream_classify", _LABELS_SQL)
def q_stream_classify(spark, sf_dir):
    """Job files labelled by the restartable stream (availableNow), run twice;
    the merged sink equals batch labelling."""
    inp, out, ckpt = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ckpt"))
    scan_sources(given_sources(spark, sf_dir)).write.json(inp)
    stream_classify(spark, inp, out, ckpt, tokens=TOKENS)
    stream_classify(spark, inp, out, ckpt, tokens=TOKENS)
    return merge_shards(read_routed(spark, out)).select("example_id", "classification", "parse_status")


def steady_model(ids):
    """:func:`memory_bound_model` without its broken rows."""
    if len(ids) > 1500:
        raise RuntimeError("CUDA out of memory")
    label = "unsafe" if ids[-1] % 2 else "safe"
    return dict(TOKENS.answer_ids)[label], label[0]


@query("stream_resume", with_sql(JOBS_SQL, ROW_SCORER_SQL, body="""
SELECT example_id, CASE WHEN last % 2 = 1 THEN 'unsafe' ELSE 'safe' END AS classification,
       CASE WHEN again THEN 'ok; oom_retry_input_tokens=1024' ELSE 'ok' END AS parse_status,
       CAST(last % 5 = 0 AS INTEGER) AS run
FROM tried"""))
def q_stream_resume(spark, sf_dir):
    """A run in which some rows fail, then one under a new checkpoint that
    labels only those, then one that finds nothing to do."""
    inp, out = scratch_path(spark, "resume-in"), scratch_path(spark, "resume-out")
    scan_sources(given_sources(spark, sf_dir)).write.json(inp)
    for name, model in (("a", memory_bound_model), ("b", steady_model), ("c", steady_model)):
        stream_label(spark, inp, out, scratch_path(spark, f"resume-ckpt-{name}"), model, TOKENS)
    return merge_shards(read_routed(spark, out)).select("example_id", "classification", "parse_status",
                                                        F.col("rank").alias("run"))


@query("stream_progress", with_sql(JOBS_SQL, ROW_SCORER_SQL, body="""
SELECT 'first' AS run, count(*) AS seen_rows, 0 AS skipped_existing, count(*) AS submitted_for_inference,
       count(*) FILTER (WHERE last % 5 <> 0) AS completed_successfully, count(*) FILTER (WHERE last % 5 = 0) AS inference_errors
FROM tried
UNION ALL
SELECT 'second', count(*), count(*) FILTER (WHERE last % 5 <> 0), count(*) FILTER (WHERE last % 5 = 0),
       count(*) FILTER (WHERE last % 5 = 0), 0
FROM tried"""))
def q_stream_progress(spark, sf_dir):
    """The last row of the progress log of a run in which some rows fail, and of the
    run that tries them again: what the listener heard from the batches."""
    inp, out = scratch_path(spark, "progress-in"), scratch_path(spark, "progress-out")
    scan_sources(given_sources(spark, sf_dir)).write.json(inp)
    last = None
    for run, model in (("first", memory_bound_model), ("second", steady_model)):
        log = stream_label(spark, inp, out, scratch_path(spark, f"progress-ckpt-{run}"), model, TOKENS)
        row = log.orderBy(F.desc("submitted_for_inference")).limit(1).drop("elapsed_seconds", "ready_workers", "updated_at_unix")
        row = row.select(F.lit(run).alias("run"), "*")
        last = row if last is None else last.unionByName(row)
    return last


@query("vocab_store", MESSAGE_IDS_SQL)
def q_vocab_store(spark, sf_dir):
    """The trained vocabulary saved, loaded again and used to encode."""
    path = scratch_path(spark, "vocab")
    save_vocab(*trained(spark, sf_dir), path)
    conv = read_table(spark, sf_dir, "conversations").withColumn("msg_key", F.concat_ws(":", "conv_id", "turn"))
    return bpe_encode(conv, *load_vocab(spark, path), "msg_key", "text")


@query("classify_scorer_b")
def q_classify_scorer_b(spark, sf_dir):
    """Scorer B: logistic regression on hashed words of labelled documents
    (``toxic`` as unsafe), then every job row labelled with it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("unsafe"))
    fitted = train_scorer_b(docs.join(labels, "doc_id"), max_iter=10)
    return C.classify(jobs(spark, sf_dir), scorer_model(fitted), TOKENS, model="scorer-b").select(
        "example_id", "classification", "parse_status", "category")
