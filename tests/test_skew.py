"""A third of all messages in one conversation: operators stay exact while
the hot conversation is spread over several buckets."""

from pyspark.sql import functions as F

from winnow.operators import blocks as B
from winnow.operators import chat as H
from winnow.operators import split as S
from winnow.operators.index import bucketed, group_index, group_prefix_sum, group_running

SF = "/root/testdata/sf0.01"


def hot_turns(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    hot = F.col("conv_id") < 34
    return conv.select(F.when(hot, F.lit(-1)).otherwise(F.col("conv_id")).alias("conv_id"),
                       F.when(hot, F.col("conv_id") * 1000 + F.col("turn")).otherwise(F.col("turn")).alias("turn"),
                       "role", "text")


def py_blocks(ids, mask, L=64):
    out = []
    for s in range(0, len(ids), L):
        x, y, m = ids[s:s + L], ids[s + 1:s + L + 1], mask[s + 1:s + L + 1]
        if not y:
            continue
        x = x + [0] * (L - len(x))
        y = [t if mm == 1 else -100 for t, mm in zip(y, m)] + [-100] * (L - len(y))
        out.append((s // L, x, y))
    return out


def test_hot_conversation_spans_buckets(spark):
    turns = hot_turns(spark)
    b = bucketed(turns, ["conv_id", "turn"], 8)
    assert b.where("conv_id = -1").select("__bucket").distinct().count() >= 2


def test_buckets_meet_their_offsets_null_safe(spark):
    """A plain equality with a bucket let the optimizer put the bucket's expression,
    over columns of the rows, into a filter on the offsets."""
    turns = spark.createDataFrame([(i % 50, i) for i in range(400)], "g long, p long")
    for out in (group_index(turns, ["g"], ["p"], partitions=8),
                group_prefix_sum(turns, ["g"], ["p"], None, "o", partitions=8),
                group_running(turns, [], ["p"], "g", "least", partitions=8)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
        assert joins and all("<=> __ob" in line and "= __ob" not in line.replace("<=>", "") for line in joins)
    got = {(r.g, r.p): r.o for r in group_prefix_sum(turns, ["g"], ["p"], None, "o", partitions=8).collect()}
    assert got == {(i % 50, i): i // 50 for i in range(400)}


def test_blocks_and_history_exact_under_skew(spark):
    turns = hot_turns(spark)
    rows = sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn))
    convs = {}
    for r in rows:
        convs.setdefault(r.conv_id, []).append(r)
    want_blocks = set()
    for c, rs in convs.items():
        ids, mask = [], []
        for r in rs:
            t = [ord(ch) + 4 for ch in r.text]
            if not t:
                continue
            if r.role == "user":
                ids += [1] + t
                mask += [-100] * (len(t) + 1)
            elif r.role == "assistant":
                ids += t + [2]
                mask += [1] * (len(t) + 1)
            else:
                ids += t
                mask += [-100] * len(t)
        for bno, x, y in py_blocks(ids, mask):
            want_blocks.add((c, bno, tuple(x), tuple(y)))
    got = {(r.conv_id, r.block_no, tuple(r.xs), tuple(r.ys)) for r in B.make_blocks(B.role_mask(turns)).collect()}
    assert got == want_blocks

    want_hist = {}
    for c, rs in convs.items():
        exchanges, k = [], 0
        for r in rs:
            if r.role == "user":
                k += 1
                exchanges.append([k, r.text, None])
            elif r.role == "assistant" and exchanges and exchanges[-1][2] is None:
                exchanges[-1][2] = r.text
        for i, (k, u, a) in enumerate(exchanges):
            prev = [e for e in exchanges[max(0, i - 2):i] if e[2] is not None]
            want_hist[(c, k)] = ([e[1] for e in prev], [e[2] for e in prev])
    got_hist = {(r.conv_id, r.exchange_no): (list(r.hist_user), list(r.hist_assistant))
                for r in H.history(H.exchanges(turns), 2).collect()}
    assert got_hist == want_hist


def test_split_of_blocks_under_skew(spark):
    turns = hot_turns(spark)
    examples = turns.select("conv_id").distinct()
    # Every example is validation in one half of the test, few in the other.
    for ratio in (1.0, 0.02):
        split = S.holdout_split(examples, "conv_id", ratio=ratio).select("conv_id", "split")
        seg = B.role_mask(turns)
        lengths = B.message_lengths(turns)
        assert {tuple(r) for r in lengths.collect()} == {tuple(r) for r in B.segment_lengths(seg).collect()}
        blocks = B.make_blocks(seg)
        tagged = S.with_split(blocks, split, lengths, "conv_id")
        by_id = {r.conv_id: r.split for r in split.collect()}
        want = {(r.conv_id, r.block_no, by_id[r.conv_id]) for r in blocks.collect()}
        got = tagged.select("conv_id", "block_no", "split").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        counts = {r.split: (r.n_examples, r.n_blocks) for r in S.split_counts(split, lengths, "conv_id").collect()}
        for name in set(by_id.values()):
            assert counts[name] == (sum(v == name for v in by_id.values()), sum(s == name for *_, s in want))


def test_hot_conversation_meets_in_no_task_of_the_split_join(spark):
    turns = hot_turns(spark)
    # Only blocks and spread validation examples are dealt: by (conv_id, block_no).
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = S.holdout_split(turns.select("conv_id").distinct(), "conv_id", ratio=1.0)
        tagged = S.with_split(B.make_blocks(B.role_mask(turns)), split, B.message_lengths(turns), "conv_id")
        per_task = (tagged.where("conv_id = -1").groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total = sum(r["count"] for r in per_task)
    assert len(per_task) >= 4 and max(r["count"] for r in per_task) < total / 2


def test_pooling_sizes_and_nulls(spark):
    from winnow.operators import vectors as V
    rows = [("a", [3.0, None]), ("a", [1.0]), ("b", [0.0, 0.0, 2.0]), ("c", []), ("d", None)]
    got = {r.g: r.pooled for r in V.mean_pool(spark.createDataFrame(rows, "g string, v array<double>"), "g", "v").collect()}
    assert set(got) == {"a", "b"} and got["b"] == [0.0, 0.0, 1.0] and len(got["a"]) == 2
