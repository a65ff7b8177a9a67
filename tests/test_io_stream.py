import json
import os

from pyspark.sql import functions as F

from winnow.operators import classify as C
from winnow.operators.merge import merge_shards
from winnow.operators.scoring import ResourceExhausted, classify_with_model, scorer_model, train_scorer_b, with_text
from winnow.sources.jobs import given_sources, scan_sources, with_example_id
from winnow.sources.records import record_line_stats, restore_checkpoint, scan_records, shard_lines_from_files
from winnow.sources.sinks import read_routed, route_append, write_final
from winnow.streaming.labeller import label_batch, stream_classify

SF = "/root/testdata/sf0.001"


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_scan_records_skips_blank_and_bad(spark, tmp_dir):
    write(f"{tmp_dir}/a.jsonl", ['{"sample": "{\\"text\\": \\"x\\"}"}', "", "   ", "{broken", "[1,2]", '{"a": 1}'])
    assert scan_records(spark, f"{tmp_dir}/a.jsonl").count() == 2
    s = record_line_stats(spark, f"{tmp_dir}/a.jsonl").collect()[0]
    assert (s.lines, s.blank_lines, s.bad_lines, s.records) == (6, 2, 2, 2)


def test_restore_checkpoint_output_wins(spark, tmp_dir):
    write(f"{tmp_dir}/out/x.jsonl", ['{"v": "out-x"}'])
    write(f"{tmp_dir}/snap/x.jsonl", ['{"v": "snap-x"}'])
    write(f"{tmp_dir}/snap/y.jsonl", ['{"v": "snap-y"}'])
    got = sorted(r.value for r in restore_checkpoint(spark, f"{tmp_dir}/out", f"{tmp_dir}/snap").collect())
    assert got == ['{"v": "out-x"}', '{"v": "snap-y"}']


def test_shard_files_line_order(spark, tmp_dir):
    name = C.CATEGORY_FILES[2][1]
    write(f"{tmp_dir}/rank0_{name}", [json.dumps({"example_id": "k", "n": i}) for i in range(50)])
    rows = shard_lines_from_files(scan_records(spark, f"{tmp_dir}/rank0_{name}")).collect()
    assert all(json.loads(r.value)["n"] == r.line for r in rows) and rows[0].category == name


def _jobs(spark):
    return with_example_id(scan_sources(given_sources(spark, SF)))


def test_route_append_merge_write_final(spark, tmp_dir):
    recs = C.classify(_jobs(spark), C.scorer_terms)
    route_append(recs, f"{tmp_dir}/out", run_id=0)
    route_append(recs, f"{tmp_dir}/out", run_id=1)  # a second copy of everything
    merged = merge_shards(read_routed(spark, f"{tmp_dir}/out"))
    assert merged.count() == recs.count()
    assert merged.where("rank = 0").count() == recs.count()  # first run wins among successes
    write_final(merged, f"{tmp_dir}/final", [f"{tmp_dir}/out"])
    assert spark.read.json(f"{tmp_dir}/final").count() == recs.count()


def test_model_scorer_ladder_and_failures(spark):
    jobs = _jobs(spark).where(F.length("sample") > 1200)  # prompts longer than every limit
    tokens = C.build_label_tokens()
    u = dict(tokens.answer_ids)["unsafe"]

    def fits_1024(ids):
        if len(ids) > 1024:
            raise ResourceExhausted("too long")
        return u, "u"

    def never_fits(ids):
        raise ResourceExhausted("too long")

    def broken(ids):
        raise ValueError("bad row")

    n = jobs.count()
    a = classify_with_model(jobs, fits_1024, tokens).collect()
    assert len(a) == n and {r.parse_status for r in a} == {"ok; oom_retry_input_tokens=1024"}
    assert {r.classification for r in a} == {"unsafe"}
    b = classify_with_model(jobs, never_fits, tokens).collect()
    assert {(r.classification, r.parse_status, r.raw_model_output) for r in b} == {("unsafe", "oom_fallback", "")}
    c = classify_with_model(jobs, broken, tokens).collect()
    assert {(r.classification, r.parse_status) for r in c} == {("unsafe", "inference_error: ValueError: bad row")}
    assert all(r.confidence == 5 and r.category == C.CATEGORY_FILES[0][1] for r in c)


def test_anti_join_planned_before_the_model(spark):
    from winnow.operators.merge import resume_anti
    jobs = _jobs(spark)
    done = jobs.select("example_id").limit(5)
    plan = classify_with_model(resume_anti(jobs, done), lambda ids: (None, "safe")) \
        ._jdf.queryExecution().executedPlan().toString()
    # The anti join sits below (is printed after) the Python node, and no
    # join brings the answers back to the jobs.
    at = plan.index("MapInPandas")
    assert "LeftAnti" in plan[at:]
    assert "Inner" not in plan


def test_scorer_b_trains_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("unsafe"))
    fitted = train_scorer_b(train, max_iter=5)
    recs = C.classify(_jobs(spark), scorer_model(fitted), model="scorer-b")
    assert recs.count() == _jobs(spark).count()
    assert {r.classification for r in recs.select("classification").distinct().collect()} <= {"safe", "unsafe"}


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_dir):
    jobs = scan_sources(given_sources(spark, SF))
    jobs.repartition(4).write.json(f"{tmp_dir}/in")
    log = stream_classify(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    streamed = spark.read.text(f"{tmp_dir}/out")
    assert streamed.count() == jobs.count()
    batch = {r.example_id: r.classification for r in C.classify(with_example_id(jobs), C.scorer_terms).collect()}
    got = {r.example_id: r.classification for r in merge_shards(read_routed(spark, f"{tmp_dir}/out")).collect()}
    assert got == batch
    assert sum(b["submitted"] for b in log) == jobs.count()
    # Restart over the same input: no new rows.
    stream_classify(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    assert spark.read.text(f"{tmp_dir}/out").count() == jobs.count()
    # The same files again under a new checkpoint (a replay): keys already done are skipped.
    again = stream_classify(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt2")
    assert sum(b["submitted"] for b in again) == 0 and sum(b["skipped"] for b in again) == jobs.count()


def test_failed_rows_are_retried(spark, tmp_dir):
    jobs = with_example_id(scan_sources(given_sources(spark, SF), chosen=["conversations"]))

    def failing(df, tokens):
        return df.withColumn("scores", F.lit(None).cast(C.SCORE_TYPE))

    # First pass: pretend the scorer failed on every row -> error records, no keys.
    recs = C.classify(jobs, failing).withColumn("parse_status", F.lit("inference_error: RuntimeError: down"))
    route_append(recs, f"{tmp_dir}/out", run_id=0)
    c = label_batch(spark, jobs.drop("example_id"), f"{tmp_dir}/out", 1)
    assert c["submitted"] == jobs.count() and c["skipped"] == 0
    c2 = label_batch(spark, jobs.drop("example_id"), f"{tmp_dir}/out", 2)
    assert c2["submitted"] == 0
    merged = merge_shards(read_routed(spark, f"{tmp_dir}/out"))
    assert merged.where(F.col("parse_status").startswith("inference_error")).count() == 0
