import math

from pyspark.sql import functions as F

from winnow.operators import split as S
from winnow.operators.index import group_index
from winnow.operators.report import token_estimate, token_report


def test_holdout_sizes(spark):
    for n, want in [(1, 1), (49, 1), (100, 2), (16021, 320)]:
        ex = spark.range(n).withColumnRenamed("id", "k")
        out = S.holdout_split(ex, "k")
        assert out.where("split = 'val'").count() == want
        assert out.count() == n
        assert out.select("shuffle_pos").distinct().count() == n


def test_holdout_is_seeded_and_disjoint(spark):
    ex = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in S.holdout_split(ex, "k", seed=42).collect()}
    b = {r.k: r.split for r in S.holdout_split(ex.repartition(5), "k", seed=42).collect()}
    c = {r.k: r.split for r in S.holdout_split(ex, "k", seed=7).collect()}
    assert a == b and a != c


def test_group_index_matches_row_number(spark):
    rows = [("hot", i) for i in range(2000)] + [(f"g{i % 37}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long")
    got = {(r.g, r.o): r.row_index for r in group_index(df, ["g"], ["o"], partitions=12).collect()}
    seen = {}
    for g, o in sorted(rows):
        assert got[(g, o)] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1


def test_token_estimate_uses_sum(spark):
    df = spark.createDataFrame([('{"text":"abc"}',), ('{"text":"def"}',)], "sample string")
    assert token_estimate(df).collect()[0].token_estimate == 1


def test_token_report_empty(spark):
    df = spark.createDataFrame([], "sample string")
    r = token_report(df).collect()[0]
    assert (r.rows, r.total_chars, r.avg_chars_per_row, r.total_tokens, r.avg_tokens_per_row) == (0, 0, 0.0, 0, 0.0)


def test_token_report_null_sample_counts_empty(spark):
    df = spark.createDataFrame([(None,), ('{"text":"abcd"}',)], "sample string")
    r = token_report(df, "char").collect()[0]
    assert (r.rows, r.total_chars, r.total_tokens, r.raw_chars) == (2, 4, 4, 15)
    assert math.isclose(r.avg_chars_per_row, 2.0)


def test_group_running_min_max_hot_group(spark):
    import random
    from winnow.operators.index import group_running
    rng = random.Random(5)
    rows = [("hot", i, rng.random()) for i in range(1500)] + [(f"g{i % 9}", i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v double")
    mins = {(r.g, r.o): r.m for r in group_running(df, ["g"], ["o"], "v", "m", "min", partitions=10).collect()}
    maxs = {(r.g, r.o): r.m for r in group_running(df, ["g"], ["o"], "v", "m", "max", partitions=10,
                                                   inclusive=True).collect()}
    lo, hi = {}, {}
    for g, o, v in sorted(rows):
        assert mins[(g, o)] == lo.get(g)
        hi[g] = max(hi.get(g, v), v)
        assert maxs[(g, o)] == hi[g]
        lo[g] = min(lo.get(g, v), v)


def test_token_report_callable_tokenizer(spark):
    from winnow.functions.tokens import char_ids
    df = spark.createDataFrame([('{"text":"héllo"}',), ('{"messages":[{"content":"ab"}]}',)], "sample string")
    r = token_report(df, char_ids).collect()[0]
    assert (r.total_tokens, r.total_chars, r.tokenizer) == (7, 7, "char_ids")
