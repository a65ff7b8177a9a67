"""Queries: labelling of all job rows (scorer A), choice, lookup, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.text import PY_SPACE_CLASS, with_extracted_text
from winnow.operators import classify as C
from winnow.operators.scoring import classify_with_model, cross_validated, threshold_sweep
from winnow.plans.common import EXTRACT_SQL, JOBS_SQL, jobs, with_sql
from winnow.plans.registry import query
from winnow.sources.tables import read_table


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOKENS = C.build_label_tokens()
_ANS = dict(TOKENS.answer_ids)
_TERMS_SQL = "[" + ", ".join(sql_str(t) for t in sorted(C.DEFAULT_TERMS)) + "]"
_CAT_CASE = " ".join(f"WHEN classification = {sql_str(lab)} AND band = {sql_str(b)} THEN {sql_str(name)}"
                     for (lab, b), name in C.CATEGORY_FILES)

# DuckDB: scorer A's verdict per row (NULL = no output for blank text).
VERDICT_SQL = rf"""
verdict AS (
  SELECT e.*,
         CASE WHEN regexp_full_match(text, '{PY_SPACE_CLASS}*') THEN NULL
              WHEN len(list_intersect(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), {_TERMS_SQL})) > 0
              THEN 'unsafe' ELSE 'safe' END AS label
  FROM extracted e
),
records AS (
  SELECT source_dataset, config, split, row_index, sample,
         coalesce(label, 'unsafe') AS classification,
         CASE WHEN label IS NULL THEN {sql_str(C.REASON_FALLBACK)} ELSE {sql_str(C.REASON_FORCED)} END AS reason,
         5 AS confidence,
         CASE WHEN label IS NULL THEN 'empty_output' ELSE 'ok' END AS parse_status,
         CASE label WHEN 'unsafe' THEN chr({_ANS['unsafe']} - 4) WHEN 'safe' THEN chr({_ANS['safe']} - 4)
              ELSE '' END AS raw_model_output,
         'terms' AS model, example_id,
         CAST({_ANS['unsafe']} AS INTEGER) AS u_id, CAST({_ANS['safe']} AS INTEGER) AS s_id, label
  FROM verdict
),
banded AS (
  SELECT *, '5_plus' AS band FROM records
)"""


def classified(spark, sf_dir):
    return C.classify(jobs(spark, sf_dir), C.scorer_terms, TOKENS, model="terms")


@query("classify", with_sql(JOBS_SQL, EXTRACT_SQL, VERDICT_SQL, body=f"""
SELECT source_dataset, config, split, row_index, sample, classification, reason, confidence, parse_status,
       raw_model_output, model, example_id, band, CASE {_CAT_CASE} END AS category
FROM banded"""), bench=True)
def q_classify(spark, sf_dir):
    return classified(spark, sf_dir)


@query("classify_prompt", with_sql(JOBS_SQL, body=f"""
SELECT example_id, {sql_str(C.SYSTEM_PROMPT)} || {sql_str(C.SAMPLE_INTRO)} || sample AS prompt FROM keyed"""))
def q_classify_prompt(spark, sf_dir):
    return jobs(spark, sf_dir).select("example_id", C.classify_prompt("sample").alias("prompt"))


@query("forced_choice", with_sql(JOBS_SQL, EXTRACT_SQL, VERDICT_SQL, body="""
SELECT example_id, CASE label WHEN 'unsafe' THEN u_id WHEN 'safe' THEN s_id END AS token_id FROM records"""))
def q_forced_choice(spark, sf_dir):
    df = C.scorer_terms(with_extracted_text(jobs(spark, sf_dir), "sample", "text"), TOKENS)
    return df.select("example_id", C.forced_choice("scores", TOKENS).alias("token_id"))


@query("label_lookup", with_sql(JOBS_SQL, EXTRACT_SQL, VERDICT_SQL, body="""
SELECT example_id, CASE WHEN row_index % 6 = 5 THEN 3 WHEN label = 'unsafe' THEN u_id WHEN label = 'safe' THEN s_id END
         AS token_id, CASE WHEN row_index % 6 <> 5 THEN label END AS label
FROM records"""))
def q_label_lookup(spark, sf_dir):
    # Every sixth row answers with a token that stands for no label.
    df = C.scorer_terms(with_extracted_text(jobs(spark, sf_dir), "sample", "text"), TOKENS)
    tok = F.when(F.col("row_index") % 6 == 5, F.lit(3)).otherwise(C.forced_choice("scores", TOKENS))
    return df.select("example_id", tok.alias("token_id"), C.label_lookup(tok, TOKENS).alias("label"))


# Answers by rule from the row's position: known and unknown tokens (none at
# all every fifth row), texts that name a label, do not, or are blank.
_ANSWER_TEXTS = (" Unsafe.", "it is SAFE", "dunno", " ", "unsafe or safe", "Safe", "")


@query("normalize_prediction", with_sql(JOBS_SQL, body=f"""
SELECT example_id, coalesce(known, CASE WHEN low LIKE '%unsafe%' THEN 'unsafe' WHEN low LIKE '%safe%' THEN 'safe'
                                        ELSE 'unsafe' END) AS classification,
       CASE WHEN known IS NULL THEN {sql_str(C.REASON_FALLBACK)} ELSE {sql_str(C.REASON_FORCED)} END AS reason,
       5 AS confidence, CASE WHEN known IS NULL AND low = '' THEN 'empty_output' ELSE 'ok' END AS parse_status,
       decoded AS raw_model_output
FROM (SELECT example_id, decoded, lower(trim(decoded)) AS low,
             CASE row_index % 5 WHEN 0 THEN 'unsafe' WHEN 1 THEN 'safe' END AS known
      FROM (SELECT *, [{", ".join(sql_str(t) for t in _ANSWER_TEXTS)}][row_index % {len(_ANSWER_TEXTS)} + 1] AS decoded
            FROM keyed))"""))
def q_normalize_prediction(spark, sf_dir):
    n = F.col("row_index")
    token = F.when(n % 5 == 0, _ANS["unsafe"]).when(n % 5 == 1, _ANS["safe"]).when(n % 5 == 2, 3)
    texts = F.array(*[F.lit(t) for t in _ANSWER_TEXTS])
    answers = jobs(spark, sf_dir).select("example_id", token.cast("int").alias("token"),
                                         F.get(texts, (n % len(_ANSWER_TEXTS)).cast("int")).alias("decoded"))
    return answers.select("example_id", C.normalize_prediction("decoded", "token", TOKENS).alias("p")).select(
        "example_id", "p.*")


# Confidences by rule from the row's position: 0, 2, 4, 6, and none every ninth row.
GRADED_SQL = """
graded AS (
  SELECT example_id, classification, confidence,
         CASE WHEN confidence >= 5 THEN '5_plus' WHEN confidence < 5 THEN '4_minus' END AS band
  FROM (SELECT example_id, classification,
               CASE WHEN row_index % 9 = 8 THEN NULL ELSE CAST(row_index % 4 * 2 AS INTEGER) END AS confidence
        FROM records))"""


def graded(spark, sf_dir):
    n = F.col("row_index")
    return classified(spark, sf_dir).select(
        "example_id", "classification", F.when(n % 9 != 8, (n % 4 * 2).cast("int")).alias("confidence"))


@query("category_counts", with_sql(JOBS_SQL, EXTRACT_SQL, VERDICT_SQL, GRADED_SQL, body=f"""
SELECT c.category_no, c.category, c.classification, c.band, coalesce(n.n, 0) AS n_records
FROM (VALUES {", ".join(f"({i}, {sql_str(name)}, {sql_str(lab)}, {sql_str(b)})"
                        for i, ((lab, b), name) in enumerate(C.CATEGORY_FILES))})
     AS c(category_no, category, classification, band)
LEFT JOIN (SELECT classification, band, count(*) AS n FROM graded GROUP BY ALL) n
  ON c.classification = n.classification AND c.band = n.band"""))
def q_category_counts(spark, sf_dir):
    return C.category_counts(graded(spark, sf_dir))


@query("confidence_band", with_sql(JOBS_SQL, EXTRACT_SQL, VERDICT_SQL, GRADED_SQL, body=f"""
SELECT example_id, band, CASE {_CAT_CASE} END AS category FROM graded"""))
def q_confidence_band(spark, sf_dir):
    df = graded(spark, sf_dir).withColumn("band", C.confidence_band("confidence"))
    return df.select("example_id", "band", C.category_name("classification", "band").alias("category"))


def memory_bound_model(ids):
    """A model fixed by a rule: memory fails above 1,500 ids, some last ids
    break it, else the last id decides."""
    last = ids[-1]
    if len(ids) > 1500:
        raise RuntimeError("CUDA out of memory")
    if last % 5 == 0:
        raise ValueError(f"bad id {last}")
    return (_ANS["unsafe"], "u") if last % 2 else (_ANS["safe"], "s")


# DuckDB: the same rule. Rows above 1,500 ids succeed on the second rung.
ROW_SCORER_SQL = rf"""
prompts AS (
  SELECT k.*, {sql_str(C.SYSTEM_PROMPT)} || {sql_str(C.SAMPLE_INTRO)} || sample AS p FROM keyed k),
tried AS (
  SELECT *, least(length(p), 2048) > 1500 AS again,
         unicode(substr(p, CASE WHEN least(length(p), 2048) > 1500 THEN 1024 ELSE length(p) END, 1)) + 4 AS last
  FROM prompts),
answered AS (
  SELECT example_id, CASE WHEN last % 5 = 0 OR last % 2 = 1 THEN 'unsafe' ELSE 'safe' END AS classification,
         CASE WHEN last % 5 = 0 THEN 'inference_error: ValueError: bad id ' || last
              WHEN again THEN 'ok; oom_retry_input_tokens=1024' ELSE 'ok' END AS parse_status,
         CASE WHEN last % 5 = 0 THEN '' WHEN last % 2 = 1 THEN 'u' ELSE 's' END AS raw_model_output,
         CASE WHEN last % 5 = 0 THEN {sql_str(C.REASON_ERROR)} ELSE {sql_str(C.REASON_FORCED)} END AS reason
  FROM tried)"""


def _by_model(spark, sf_dir):
    return classify_with_model(jobs(spark, sf_dir), memory_bound_model, TOKENS).select(
        "example_id", "classification", "parse_status", "raw_model_output", "reason")


@query("row_scorer", with_sql(JOBS_SQL, ROW_SCORER_SQL, body="SELECT * FROM answered"))
def q_row_scorer(spark, sf_dir):
    return _by_model(spark, sf_dir)


@query("inference_failure", with_sql(JOBS_SQL, ROW_SCORER_SQL, body="""
SELECT * FROM answered WHERE parse_status LIKE 'inference_error:%'"""))
def q_inference_failure(spark, sf_dir):
    return _by_model(spark, sf_dir).where(F.col("parse_status").startswith(C.ERROR_PREFIX))


def labelled_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("unsafe")), "doc_id")


TERM_THRESHOLDS = (1, 2, 3)
B_THRESHOLDS = tuple(i / 10 for i in range(1, 10))


@query("scorer_a_quality", rf"""
SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE said AND bad) AS tp, count(*) FILTER (WHERE said AND NOT bad) AS fp,
       count(*) FILTER (WHERE NOT said AND bad) AS fn, count(*) FILTER (WHERE NOT said AND NOT bad) AS tn,
       coalesce(round(count(*) FILTER (WHERE said AND bad) / nullif(count(*) FILTER (WHERE said), 0), 9), 0) AS precision,
       coalesce(round(count(*) FILTER (WHERE said AND bad) / nullif(count(*) FILTER (WHERE bad), 0), 9), 0) AS recall
FROM (SELECT t, coalesce(len(list_intersect(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), {_TERMS_SQL})) >= t, false) AS said,
             CAST(toxic AS INTEGER) = 1 AS bad
      FROM documents JOIN labels USING (doc_id), (VALUES {", ".join(f"({t})" for t in TERM_THRESHOLDS)}) v(t)
      WHERE toxic IS NOT NULL) GROUP BY t""")
def q_scorer_a_quality(spark, sf_dir):
    """How scorer A's term count tells the labelled documents apart."""
    found = F.array_intersect(F.split(F.lower("text"), C.WORD_SPLIT), F.array(*[F.lit(t) for t in sorted(C.DEFAULT_TERMS)]))
    return threshold_sweep(labelled_documents(spark, sf_dir).withColumn("score", F.size(found)), TERM_THRESHOLDS)


@query("scorer_b_quality")
def q_scorer_b_quality(spark, sf_dir):
    """The same sweep over scorer B's cross-validated probabilities."""
    return threshold_sweep(cross_validated(labelled_documents(spark, sf_dir), "doc_id", max_iter=10), B_THRESHOLDS)


__all__ = ["classified", "TOKENS", "VERDICT_SQL", "sql_str"]
