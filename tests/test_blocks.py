import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.operators import blocks as B
from winnow.operators.index import group_prefix_sum


def ids_tokenizer(col):
    # Test texts are blank-separated integers: "10 11" -> [10, 11].
    return F.transform(F.split(col, " "), lambda x: x.cast("int"))


def python_blocks(ids, mask, L=64):
    out = []
    for s in range(0, len(ids), L):
        x, y, m = ids[s:s + L], ids[s + 1:s + L + 1], mask[s + 1:s + L + 1]
        if not y:
            continue
        x = x + [0] * (L - len(x))
        y = y + [-100] * (L - len(y))
        m = m + [-100] * (L - len(m))
        out.append((s // L, x, [t if mm == 1 else -100 for t, mm in zip(y, m)]))
    return out


def test_role_mask_and_blocks_fixture(spark):
    turns = spark.createDataFrame([(1, 0, "user", "10 11"), (1, 1, "assistant", "12"), (1, 2, "system", "13")],
                                  "conv_id long, turn long, role string, text string")
    seg = B.role_mask(turns, tokenize=ids_tokenizer)
    ex = B.tokenized_examples(seg).collect()[0]
    assert list(ex.ids) == [1, 10, 11, 12, 2, 13]
    assert list(ex.mask) == [-100, -100, -100, 1, 1, -100]
    blk = B.make_blocks(seg).collect()
    assert len(blk) == 1
    assert list(blk[0].xs) == [1, 10, 11, 12, 2, 13] + [0] * 58
    assert list(blk[0].ys) == [-100, -100, 12, 2, -100, -100] + [-100] * 58


def _blocks_for(spark, segs_by_conv):
    rows = []
    for conv, segs in segs_by_conv.items():
        for turn, (role, ids) in enumerate(segs):
            rows.append((conv, turn, role, " ".join(str(i) for i in ids)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return B.make_blocks(B.role_mask(df, tokenize=ids_tokenizer))


def test_block_counts_by_length(spark):
    want = {0: 0, 1: 0, 2: 1, 64: 1, 65: 1, 66: 2, 128: 2, 129: 2, 130: 3}
    # one 'other' message of n ids (no specials added) per conversation
    segs = {n: [("system", list(range(100, 100 + n)))] for n in want if n > 0}
    got = {r.conv_id: r.n for r in _blocks_for(spark, segs).groupBy("conv_id").agg(F.count("*").alias("n"))
           .collect()}
    for n, k in want.items():
        assert got.get(n, 0) == k, (n, got.get(n))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]),
                          st.lists(st.integers(4, 60), min_size=1, max_size=90)), min_size=1, max_size=6))
def test_blocks_equal_python_rule(spark, segs):
    got = sorted((r.block_no, list(r.xs), list(r.ys)) for r in _blocks_for(spark, {7: segs}).collect())
    ids, mask = [], []
    for role, t in segs:
        if role == "user":
            ids += [1] + t
            mask += [-100] * (len(t) + 1)
        elif role == "assistant":
            ids += t + [2]
            mask += [1] * (len(t) + 1)
        else:
            ids += t
            mask += [-100] * len(t)
    assert got == python_blocks(ids, mask)


def test_prefix_sum_hot_group_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(0, i, rng.randint(0, 9)) for i in range(3000)]  # one hot group
    rows += [(g, i, rng.randint(0, 9)) for g in range(1, 200) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = {(r.g, r.o): r.off for r in group_prefix_sum(df, ["g"], ["o"], "v", "off", partitions=16).collect()}
    run = {}
    for g, o, v in sorted(rows):
        assert got[(g, o)] == run.get(g, 0)
        run[g] = run.get(g, 0) + v
