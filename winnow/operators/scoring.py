"""Scorers: a user model called per row inside ``mapInPandas``, and scorer B
(a Spark ML pipeline trained on labelled rows).

The Python scorer keeps the per-row contract of the source: one model call
per row on a prompt cut to 2048 tokens; when the model reports exhausted
memory the same row is retried at 1024, then 512 tokens (status gets
``; oom_retry_input_tokens=N``); after the last failure the row is labelled
unsafe with status ``oom_fallback``; any other error still yields a record:
unsafe, status ``inference_error: Type: message``. Only the model call and
the ladder run in Python; labels, statuses and categories are SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import py_strip, with_extracted_text
from winnow.functions.tokens import CHAR_ID_OFFSET
from winnow.session import ship_package
from winnow.operators.classify import (CONFIDENCE, REASON_ERROR, REASON_OOM, SAMPLE_INTRO, STATUS_OOM,
                                       SYSTEM_PROMPT, WORD_SPLIT, LabelTokens, SCORE_TYPE, build_label_tokens,
                                       category_name, confidence_band, normalize_prediction)

# The input-token limits of the retry ladder.
TOKEN_LIMITS = (2048, 1024, 512)


class ResourceExhausted(RuntimeError):
    """Raised by a model when the input does not fit; triggers the ladder."""


def out_of_memory(exc: Exception) -> bool:
    """Memory errors by class or, as accelerators report them, by their text."""
    return isinstance(exc, (ResourceExhausted, MemoryError)) or (
        isinstance(exc, RuntimeError) and "out of memory" in str(exc).lower())


def _char_encode(text: str) -> list[int]:
    return [ord(c) + CHAR_ID_OFFSET for c in text]


ANSWER_SCHEMA = ", token_id int, decoded string, limit_used int, error string"
JOB_PASS = ("source_dataset", "config", "split", "row_index", "sample", "example_id")


def answer(sample: str | None, model_fn, limits=TOKEN_LIMITS, encode=_char_encode):
    """One row's (token_id, decoded, limit_used, error) from the retry ladder;
    ``error`` is ``oom`` after the last limit, ``Type: message`` for other failures."""
    prompt = SYSTEM_PROMPT + SAMPLE_INTRO + (sample or "")
    # One character is one id here: what no limit reaches is not turned into ids.
    ids = encode(prompt[:max(limits)] if encode is _char_encode and min(limits) >= 0 else prompt)
    for limit in limits:
        try:
            token, decoded = model_fn(ids[:limit])
            return token, decoded, limit, None
        except Exception as exc:  # the row still gets a record
            if not out_of_memory(exc):
                return None, "", limit, f"{type(exc).__name__}: {exc}"
    return None, "", limits[-1], "oom"


def run_model_rows(jobs: DataFrame, model_fn, limits=TOKEN_LIMITS, encode=_char_encode) -> DataFrame:
    """mapInPandas over job rows: the job columns plus (token_id, decoded,
    limit_used, error) - one pass, no join back.

    ``model_fn(ids: list[int]) -> (token_id | None, decoded str)`` is shipped
    once per task; see :func:`answer`.
    """
    ship_package(jobs.sparkSession)

    def run(batches):
        for b in batches:
            found = [answer(sample, model_fn, limits, encode) for sample in b["sample"]]
            tok, dec, used, err = zip(*found) if found else ((), (), (), ())
            out_df = b.copy()
            out_df["token_id"] = pd.array(tok, dtype="Int32")
            out_df["decoded"] = dec
            out_df["limit_used"] = used
            out_df["error"] = err
            yield out_df

    src = jobs.select(*JOB_PASS)
    schema = (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields) + ANSWER_SCHEMA)
    return src.mapInPandas(run, schema)


def classify_with_model(jobs: DataFrame, model_fn, tokens: LabelTokens | None = None, model: str = "user",
                        limits=TOKEN_LIMITS) -> DataFrame:
    """Label job rows with a per-row model; output as :func:`classify`."""
    return label_answers(run_model_rows(jobs, model_fn, limits), tokens, model, limits)


def label_answers(df: DataFrame, tokens: LabelTokens | None = None, model: str = "user", limits=TOKEN_LIMITS) -> DataFrame:
    """Records of answered job rows (see :func:`answer`); output as :func:`classify`."""
    tokens = tokens or build_label_tokens()
    norm = normalize_prediction(py_strip("decoded"), "token_id", tokens)
    retried = F.col("limit_used") != limits[0]
    status = F.when(retried, F.concat(norm["parse_status"], F.lit("; oom_retry_input_tokens="),
                                      F.col("limit_used").cast("string"))).otherwise(norm["parse_status"])
    oom, failed = F.col("error") == "oom", F.col("error").isNotNull()
    out = df.select(
        "source_dataset", "config", "split", "row_index", "sample",
        F.when(failed, F.lit("unsafe")).otherwise(norm["classification"]).alias("classification"),
        F.when(oom, F.lit(REASON_OOM)).when(failed, F.lit(REASON_ERROR)).otherwise(norm["reason"]).alias("reason"),
        F.lit(CONFIDENCE).alias("confidence"),
        F.when(oom, F.lit(STATUS_OOM)).when(failed, F.concat(F.lit("inference_error: "), F.col("error")))
         .otherwise(status).alias("parse_status"),
        F.when(failed, F.lit("")).otherwise(norm["raw_model_output"]).alias("raw_model_output"),
        F.lit(model).alias("model"), "example_id")
    band = confidence_band("confidence")
    return out.withColumn("band", band).withColumn("category", category_name("classification", band))


# --------------------------------------------------------------------------
# Scorer B: a learned labeller
# --------------------------------------------------------------------------

def train_scorer_b(labelled: DataFrame, text: str = "text", label: str = "unsafe", num_features: int = 1 << 18,
                   max_iter: int = 20):
    """RegexTokenizer -> HashingTF -> LogisticRegression on (text, label 0/1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=WORD_SPLIT, toLowercase=True),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=num_features),
        LogisticRegression(featuresCol="__tf", labelCol=label, maxIter=max_iter, regParam=0.01,
                           probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__pred"),
    ])
    return pipe.fit(labelled.select(text, F.col(label).cast("double").alias(label)))


def scorer_model(fitted):
    """A scorer (df, tokens) -> df + scores from a fitted scorer-B pipeline;
    blank text gives no output, as with scorer A."""
    from pyspark.ml.functions import vector_to_array

    def scorer(df: DataFrame, tokens: LabelTokens) -> DataFrame:
        ans = dict(tokens.answer_ids)
        scored = fitted.transform(df.withColumn("text", F.coalesce("text", F.lit(""))))
        p = vector_to_array("__prob")
        blank = py_strip("text") == ""
        scores = F.when(blank, F.array().cast(SCORE_TYPE)).otherwise(F.array(
            F.struct(F.lit(ans["unsafe"]).cast("int").alias("token_id"), p[1].alias("score")),
            F.struct(F.lit(ans["safe"]).cast("int").alias("token_id"), p[0].alias("score"))))
        return scored.withColumn("scores", scores).drop("__words", "__tf", "__raw", "__prob", "__pred")
    return scorer


def cross_validated(labelled: DataFrame, key: str, text: str = "text", label: str = "unsafe", folds: int = 3,
                    max_iter: int = 20) -> DataFrame:
    """(key, fold, label, score): each labelled row scored by a scorer B that has not
    seen it. A row's fold is the CRC-32 of its key modulo ``folds``, so repeated keys
    stay together; NULL keys are fold 0, rows without a label are left out, blank
    texts score as the model scores no words. A fold whose other folds hold but one
    label is scored with that label."""
    from pyspark.ml.functions import vector_to_array
    fold = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")
    rows = labelled.where(F.col(label).isNotNull()).select(
        key, F.coalesce(F.col(text), F.lit("")).alias(text), F.col(label).cast("int").alias(label), fold.alias("fold"))
    # One pass tells which labels each fold holds.
    held = {r.fold: set(r.labels) for r in rows.groupBy("fold").agg(F.collect_set(label).alias("labels")).collect()}
    out = None
    for k in sorted(held):
        seen = set().union(*[v for f, v in held.items() if f != k])
        part = rows.where(F.col("fold") == k)
        if len(seen) > 1:
            fitted = train_scorer_b(rows.where(F.col("fold") != k), text, label, max_iter=max_iter)
            part = fitted.transform(part).withColumn("score", vector_to_array("__prob")[1])
        else:
            part = part.withColumn("score", F.lit(float(next(iter(seen), 0))))
        part = part.select(key, "fold", label, "score")
        out = part if out is None else out.unionByName(part)
    return rows.select(key, "fold", label, F.lit(0.0).alias("score")) if out is None else out


def threshold_sweep(scored: DataFrame, thresholds, score: str = "score", label: str = "unsafe") -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall), one row per threshold: rows
    scored at or above it count as unsafe. One aggregate over the rows, whatever the
    number of thresholds; a share without rows is 0, NULL scores are below all."""
    said = [F.coalesce(F.col(score) >= F.lit(t), F.lit(False)) for t in thresholds]
    true = F.col(label).cast("int") == 1
    counts = scored.where(F.col(label).isNotNull()).agg(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.count_if(s & true).alias("tp"), F.count_if(s & ~true).alias("fp"),
                 F.count_if(~s & true).alias("fn"), F.count_if(~s & ~true).alias("tn")).alias(f"t{i}")
        for i, (t, s) in enumerate(zip(thresholds, said))])
    rows = counts.select(F.inline(F.array(*[F.col(c) for c in counts.columns])))

    def share(part, rest):
        total = F.col(part) + F.col(rest)
        return F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col(part) / total, 9))

    return rows.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def with_text(df: DataFrame) -> DataFrame:
    return with_extracted_text(df, "sample", "text")


__all__ = ["ResourceExhausted", "run_model_rows", "classify_with_model", "train_scorer_b", "scorer_model",
           "cross_validated", "threshold_sweep", "TOKEN_LIMITS", "with_text"]
