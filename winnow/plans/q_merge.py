"""Queries: completed keys, resume, shard merge, run counters.

The shard files of a labelling run are derived from the labelled job rows
(every row kept): rank = row_index mod 2, line = row_index; rows with
row_index mod 7 = 3 first failed (an ``inference_error`` record in the first
category file) and were retried; rows with row_index mod 5 = 0 were written
twice; row_index mod 11 = 4 lost its ``split`` field; row_index mod 13 = 6
was cut off mid-line by a killed writer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import classify as C
from winnow.operators.key_table import KeyTable
from winnow.operators.merge import completed_filter, completed_keys, merge_shards, parse_records, \
    record_key_sql, resume_anti, run_counters
from winnow.operators.runs import label_run
from winnow.plans.common import EXTRACT_SQL, JOBS_SQL, jobs, with_sql
from winnow.plans.q_classify import TOKENS, VERDICT_SQL, classified, sql_str
from winnow.plans.registry import query
from winnow.session import scratch_path
from winnow.sources.shards import restore_shards, write_shards

ERROR_STATUS = "inference_error: RuntimeError: scorer failed"
RETRY_LINE_OFFSET = 100_000
CUT_AT = 40


def _record_json(df, failed):
    rec = F.struct(
        "source_dataset", "config", "split", "row_index", "sample",
        F.when(failed, F.lit("unsafe")).otherwise(F.col("classification")).alias("classification"),
        F.when(failed, F.lit(C.REASON_ERROR)).otherwise(F.col("reason")).alias("reason"),
        "confidence",
        F.when(failed, F.lit(ERROR_STATUS)).otherwise(F.col("parse_status")).alias("parse_status"),
        F.when(failed, F.lit("")).otherwise(F.col("raw_model_output")).alias("raw_model_output"),
        "model", "example_id")
    j = F.to_json(rec, {"ignoreNullFields": "false"})
    n = F.col("row_index")
    return (F.when(n % 13 == 6, F.substring(j, 1, CUT_AT))
             .when(n % 11 == 4, F.regexp_replace(j, ',"split":"[^"]*"', ""))
             .otherwise(j))


def shard_lines(spark, sf_dir):
    """Shard lines of a labelling run, written once to the shared checkpoint
    folder and read back - as the labeller's sink and the merge would meet."""
    path = scratch_path(spark, "shards")
    _derive_shards(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _derive_shards(spark, sf_dir):
    recs = classified(spark, sf_dir)
    n = F.col("row_index")
    failed = n % 7 == 3
    # One pass: each record gives its first line and, where it was retried or
    # written again, a second one.
    first = F.struct(
        F.when(failed, F.lit(C.CATEGORY_FILES[0][1])).otherwise(F.col("category")).alias("category"),
        (n % 2).alias("rank"), n.alias("line"), _record_json(recs, failed).alias("value"))
    retry = F.struct(F.col("category"), (1 - n % 2).alias("rank"), (n + RETRY_LINE_OFFSET).alias("line"),
                     _record_json(recs, F.lit(False)).alias("value"))
    lines = F.array_compact(F.array(first, F.when(failed | (n % 5 == 0), retry)))
    return recs.select(F.explode(lines).alias("l")).select("l.*")


def _rec_sql(failed: str) -> str:
    return f"""to_json(struct_pack(source_dataset := source_dataset, config := config, split := split,
        row_index := row_index, sample := sample,
        classification := CASE WHEN {failed} THEN 'unsafe' ELSE classification END,
        reason := CASE WHEN {failed} THEN {sql_str(C.REASON_ERROR)} ELSE reason END,
        confidence := confidence,
        parse_status := CASE WHEN {failed} THEN {sql_str(ERROR_STATUS)} ELSE parse_status END,
        raw_model_output := CASE WHEN {failed} THEN '' ELSE raw_model_output END,
        model := model, example_id := example_id))::VARCHAR"""


def _line_sql(failed: str) -> str:
    j = _rec_sql(failed)
    return f"""CASE WHEN row_index % 13 = 6 THEN substr({j}, 1, {CUT_AT})
                    WHEN row_index % 11 = 4 THEN regexp_replace({j}, ',"split":"[^"]*"', '')
                    ELSE {j} END"""


_CAT_CASE = " ".join(f"WHEN classification = {sql_str(lab)} AND band = {sql_str(b)} THEN {sql_str(name)}"
                     for (lab, b), name in C.CATEGORY_FILES)
_CAT_NO = " ".join(f"WHEN {sql_str(name)} THEN {i}" for i, (_, name) in enumerate(C.CATEGORY_FILES))

SHARDS_SQL = f"""
cats AS (SELECT *, CASE {_CAT_CASE} END AS category FROM banded),
shards AS (
  SELECT CASE WHEN row_index % 7 = 3 THEN {sql_str(C.CATEGORY_FILES[0][1])} ELSE category END AS category,
         row_index % 2 AS rank, row_index AS line, {_line_sql('row_index % 7 = 3')} AS value
  FROM cats
  UNION ALL
  SELECT category, 1 - row_index % 2, row_index + {RETRY_LINE_OFFSET}, {_line_sql('false')}
  FROM cats WHERE row_index % 7 = 3 OR row_index % 5 = 0
),
parsed AS (
  SELECT * FROM (SELECT *, TRY_CAST(value AS JSON) AS v FROM shards) WHERE json_type(v) = 'OBJECT'
),
rec AS (
  SELECT category, rank, line, v ->> '$.example_id' AS example_id, v ->> '$.classification' AS classification,
         v ->> '$.parse_status' AS parse_status, CAST(v ->> '$.confidence' AS INTEGER) AS confidence,
         json_exists(v, '$.source_dataset') AND json_exists(v, '$.config') AND json_exists(v, '$.split')
           AND json_exists(v, '$.row_index') AS has_key_fields,
         concat_ws(chr(31), v ->> '$.source_dataset', v ->> '$.config', v ->> '$.split', v ->> '$.row_index')
           AS record_key,
         CASE category {_CAT_NO} END AS cat_no
  FROM parsed
),
done AS (
  SELECT * FROM rec WHERE has_key_fields AND NOT starts_with(coalesce(parse_status, ''), 'inference_error:')
)"""

ALL_SQL = (JOBS_SQL, EXTRACT_SQL, VERDICT_SQL, SHARDS_SQL)


@query("union_shards", with_sql(*ALL_SQL, body="SELECT category, rank, count(*) AS n_lines FROM shards GROUP BY ALL"))
def q_union_shards(spark, sf_dir):
    return shard_lines(spark, sf_dir).groupBy("category", "rank").agg(F.count(F.lit(1)).alias("n_lines"))


@query("completed_filter", with_sql(*ALL_SQL, body="SELECT record_key, rank, line, parse_status FROM done"))
def q_completed_filter(spark, sf_dir):
    done = completed_filter(parse_records(shard_lines(spark, sf_dir)))
    return done.select(F.expr(record_key_sql()).alias("record_key"), "rank", "line",
                       F.expr("try_variant_get(__v, '$.parse_status', 'string')").alias("parse_status"))


@query("completed_keys", with_sql(*ALL_SQL, body="SELECT DISTINCT record_key AS example_id FROM done"))
def q_completed_keys(spark, sf_dir):
    return completed_keys(shard_lines(spark, sf_dir))


@query("resume_anti", with_sql(*ALL_SQL, body="""
SELECT example_id, source_dataset, row_index FROM keyed
WHERE example_id NOT IN (SELECT record_key FROM done)"""))
def q_resume_anti(spark, sf_dir):
    todo = resume_anti(jobs(spark, sf_dir), completed_keys(shard_lines(spark, sf_dir)))
    return todo.select("example_id", "source_dataset", "row_index")


@query("key_table", with_sql(*ALL_SQL, body="""
SELECT example_id, source_dataset, row_index FROM keyed
WHERE example_id NOT IN (SELECT record_key FROM done)"""))
def q_key_table(spark, sf_dir):
    """The completed keys of each rank appended to a key table, opened anew, and the
    jobs that are left by it."""
    done = completed_filter(parse_records(shard_lines(spark, sf_dir))).select(
        "rank", F.expr(record_key_sql()).alias("example_id"), F.expr("try_variant_get(__v, '$.source_dataset', 'string')").alias("source_dataset"))
    table = KeyTable(spark)
    for rank in (0, 1):
        table.append(done.where(F.col("rank") == rank))
    todo = KeyTable(spark, table.folder).todo(jobs(spark, sf_dir))
    return todo.select("example_id", "source_dataset", "row_index")


@query("restore_checkpoint", with_sql(*ALL_SQL, body="""
SELECT category, CAST(rank AS INTEGER) AS rank, count(*) AS n_lines, CAST(sum(line) AS BIGINT) AS line_sum,
       CAST(sum(length(value)) AS BIGINT) AS chars, count(*) FILTER (WHERE line % 3 = 0) AS old_lines
FROM shards WHERE rank = 1 OR line % 3 <> 0 OR category NOT IN (SELECT category FROM shards WHERE rank = 0 AND line % 3 <> 0)
GROUP BY ALL"""))
def q_restore_checkpoint(spark, sf_dir):
    """A snapshot with all shard files; an output folder that has already written
    those of rank 0 anew, with two thirds of their lines."""
    lines = shard_lines(spark, sf_dir)
    snapshot, output = scratch_path(spark, "snapshot"), scratch_path(spark, "output")
    write_shards(lines.where("line % 2 = 0"), snapshot)  # an older version, replaced by the next
    write_shards(lines, snapshot)
    write_shards(lines.where("rank = 0 AND line % 3 <> 0"), output)
    return restore_shards(spark, output, snapshot).groupBy("category", "rank").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("line").alias("line_sum"), F.sum(F.length("value")).cast("long").alias("chars"),
        F.count_if(F.col("line") % 3 == 0).alias("old_lines"))


@query("run_summary", with_sql(*ALL_SQL, body="""
SELECT count(*) AS seen, count(*) FILTER (WHERE d.example_id IS NOT NULL) AS skipped_existing,
       count(*) FILTER (WHERE d.example_id IS NULL) AS submitted,
       count(*) FILTER (WHERE d.example_id IS NULL AND row_index % 3 <> 0) AS successful,
       count(*) FILTER (WHERE d.example_id IS NULL AND row_index % 3 = 0) AS errors
FROM keyed k LEFT JOIN (SELECT DISTINCT record_key AS example_id FROM done) d ON k.example_id = d.example_id"""))
def q_run_summary(spark, sf_dir):
    """A run over the jobs that the shards have not completed; every third row fails."""
    def label(todo):
        found = C.classify(todo, C.scorer_terms, TOKENS, model="terms")
        return found.withColumn("parse_status", F.when(F.col("row_index") % 3 == 0, F.lit(ERROR_STATUS)).otherwise(F.col("parse_status")))

    return label_run(jobs(spark, sf_dir), completed_keys(shard_lines(spark, sf_dir)), label, scratch_path(spark, "run"), 2)


@query("merge_shards", with_sql(*ALL_SQL, body=f"""
SELECT example_id, classification, parse_status, rank, line,
       CASE WHEN confidence >= 5 THEN '5_plus' ELSE '4_minus' END AS band,
       CASE {_CAT_CASE.replace('band =', "(CASE WHEN confidence >= 5 THEN '5_plus' ELSE '4_minus' END) =")} END
         AS category
FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY
        starts_with(coalesce(parse_status, ''), 'inference_error:'), cat_no, rank, line) AS rn
      FROM rec WHERE example_id IS NOT NULL)
WHERE rn = 1"""), bench=True)
def q_merge_shards(spark, sf_dir):
    return merge_shards(shard_lines(spark, sf_dir)).select(
        "example_id", "classification", "parse_status", "rank", "line", "band", "category")


@query("run_counters", with_sql(*ALL_SQL, body="""
SELECT count(*) AS seen, count(*) FILTER (WHERE d.example_id IS NOT NULL) AS skipped_existing,
       count(*) FILTER (WHERE d.example_id IS NULL) AS submitted,
       count(*) FILTER (WHERE d.example_id IS NULL AND row_index % 3 <> 0) AS successful,
       count(*) FILTER (WHERE d.example_id IS NULL AND row_index % 3 = 0) AS errors
FROM keyed k LEFT JOIN (SELECT DISTINCT record_key AS example_id FROM done) d ON k.example_id = d.example_id"""))
def q_run_counters(spark, sf_dir):
    j = jobs(spark, sf_dir)
    done = completed_keys(shard_lines(spark, sf_dir))
    todo = resume_anti(j, done)
    results = C.classify(todo, C.scorer_terms, TOKENS, model="terms")
    # Every third row of this run fails.
    results = results.withColumn("parse_status", F.when(F.col("row_index") % 3 == 0, F.lit(ERROR_STATUS))
                                 .otherwise(F.col("parse_status")))
    return run_counters(j, done, results)
