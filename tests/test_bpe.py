import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import bpe
from winnow.sources.tables import read_table

tokenizers = pytest.importorskip("tokenizers")

SF = "/root/testdata/sf0.001"


def reference_tokenizer(texts, vocab_size):
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel
    from tokenizers.trainers import BpeTrainer
    tok = Tokenizer(BPE(unk_token="<unk>"))
    tok.pre_tokenizer = ByteLevel(add_prefix_space=False)
    tok.train_from_iterator(texts, trainer=BpeTrainer(vocab_size=vocab_size,
                                                      special_tokens=["<pad>", "<bos>", "<eos>", "<unk>"],
                                                      show_progress=False))
    return tok


def test_bpe_train_and_encode_equal_tokenizers(spark):
    conv = read_table(spark, SF, "conversations")
    vocab, merges = bpe.bpe_train(spark, bpe.word_counts(conv, "text"), num_merges=25)
    v = {r.token: r.id for r in vocab.collect()}
    texts = [r.text for r in conv.select("text").collect() if r.text]
    ref = reference_tokenizer(texts, len(v))
    model = json.loads(ref.to_str())["model"]
    assert v == model["vocab"]
    mine = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    theirs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    assert mine == theirs
    keyed = conv.withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    got = {r.k: list(r.ids) for r in bpe.bpe_encode(keyed, vocab, merges, "k").collect()}
    for r in keyed.collect():
        assert got[r.k] == ref.encode(r.text).ids
    total = bpe.bpe_token_total(conv, vocab, merges).collect()[0].total_tokens
    assert total == sum(len(ref.encode(t).ids) for t in texts)


def test_vocab_store_round_trip(spark, tmp_dir):
    vocab = spark.createDataFrame([("<pad>", 0), ("a", 4)], "token string, id int")
    merges = spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string")
    bpe.save_vocab(vocab, merges, tmp_dir + "/v")
    v2, m2 = bpe.load_vocab(spark, tmp_dir + "/v")
    assert sorted(v2.collect()) == sorted(vocab.collect()) and m2.collect() == merges.collect()


def test_byte_symbol_rule_matches_package():
    from tokenizers.pre_tokenizers import ByteLevel
    alphabet = set(ByteLevel.alphabet())
    assert {chr(bpe.byte_symbol(b)) for b in range(256)} == alphabet


def test_long_training_equals_the_package(spark):
    size = 700  # the registered queries train all 2,048 entries
    conv = read_table(spark, "/root/testdata/sf0.01", "conversations")
    vocab, merges = bpe.bpe_train(spark, bpe.word_counts(conv, "text"), vocab_size=size)
    texts = [r.text for r in conv.select("text").collect() if r.text]
    ref = reference_tokenizer(texts, size)
    model = json.loads(ref.to_str())["model"]
    assert {r.token: r.id for r in vocab.collect()} == model["vocab"]
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == [tuple(m) for m in model["merges"]]
    docs = texts[:60] + ["a" * 3000, " the the", "zzzz zzzzz", "", "ünï 你好"]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, text string")
    got = {r.k: list(r.ids) for r in bpe.bpe_encode(df, vocab, merges, "k").collect()}
    assert got == {i: ref.encode(t).ids for i, t in enumerate(docs)}


def test_merges_visit_only_words_that_hold_a_pair(spark):
    """A job used to walk every word for every merge."""
    a, b, c = (chr(bpe.FIRST_SYMBOL + i) for i in range(3))
    packed = bpe._packed([a + b, c, c + a, b + a + b, a + c + b, b + b + a], [5, 4, 3, 2, 1, 7])
    (s, n), = bpe._unpacked([packed])
    assert n.tolist() == [5, 3, 2, 1, 7]  # a word of one symbol holds no pair
    # Neither the end of one word and the start of the next nor a pair's halves apart count.
    assert list(bpe._holding(s, [a + b])) == [(0, a + b), (2, b + a + b)]
    assert list(bpe._holding(s, [b + b, c + a])) == [(1, c + a), (4, b + b + a)]
    assert list(bpe._holding(s, [])) == list(bpe._holding(b"", [a + b])) == []


def test_best_pairs_follow_the_changes():
    """The best pair was looked for among all pairs once a merge."""
    import random
    rnd = random.Random(3)
    totals = {(a, b): rnd.randint(1, 9) for a in "abcdef" for b in "abcdef"}
    counts, plain = bpe.PairCounts(dict(totals)), dict(totals)
    for _ in range(400):
        change = {(rnd.choice("abcdef"), rnd.choice("abcdefg")): rnd.randint(-4, 4) for _ in range(3)}
        counts.add(change)
        for p, n in change.items():
            plain[p] = plain.get(p, 0) + n
        want = sorted((-n, *p) for p, n in plain.items() if n > 0)
        assert counts.best(5) == [w[1:] for w in want[:5]]
        assert len(counts.heap) <= 2 * len(counts.totals) + 1100


def test_encoder_looks_up_distinct_words_and_keeps_those_in_use(monkeypatch):
    """Every occurrence used to be looked up, and a full memory was thrown away whole."""
    import pyarrow as pa
    symbols = [chr(bpe.byte_symbol(b)) for b in b"abcd "]
    vocab = {t: i for i, t in enumerate(["<pad>", "<bos>", "<eos>", "<unk>", *symbols, "ab", "abc", "cd"])}
    merges = [("a", "b"), ("ab", "c"), ("c", "d")]
    enc, asked = bpe.WordEncoder(vocab, merges), []
    assert [enc.encode(w) for w in ("abcd", "ccdd", "abab", "xa", "")] == [[10, 7], [6, 11, 7], [9, 9], [3, 4], []]
    monkeypatch.setattr(enc, "encode", lambda w, plain=enc.encode: asked.append(w) or plain(w))
    rows = [["zz"], ["abcd", " a", "abcd"], [], None, ["abcd"], [" a", "cd"], ["b"]]
    words = pa.array(rows, pa.list_(pa.string()))
    want = [[i for w in row or [] for i in bpe.WordEncoder(vocab, merges).encode(w)] for row in rows]
    assert enc.lists(words).to_pylist() == want
    assert sorted(asked) == sorted(["zz", "abcd", " a", "cd", "b"])
    assert enc.lists(words.slice(1, 4)).to_pylist() == want[1:5]
    assert enc.lists(words.slice(2, 2)).to_pylist() == [[], []]
    assert len(asked) == 5
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 6)
    asked.clear()
    enc.known, enc.older = {}, {}
    for i in range(50):
        enc.lists(pa.array([["abcd", "a" * (i + 1)]]))
        assert len(enc.known) + len(enc.older) <= 6
    assert asked.count("abcd") == 1


def test_token_total_comes_from_distinct_words(spark):
    """A report used to make the ids of every text only to count them."""
    from winnow.operators.report import token_report
    texts = spark.createDataFrame([("the cat the cat",), (None,), ("",), ("the  dog",), ("the cat the cat",), ("ünï",)], "text string")
    vocab, merges = bpe.bpe_train(spark, bpe.word_counts(texts), num_merges=6)
    tokenize = bpe.bpe_tokenizer(vocab, merges)
    plain = texts.select(F.size(tokenize("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert tokenize.total(texts).first()[0] == plain > 0
    assert tokenize.total(texts.where("text = ''")).first()[0] == 0
    jobs = texts.select(F.to_json(F.struct("text")).alias("sample"))
    got = token_report(jobs, tokenize)
    assert (got.first().total_tokens, got.first().rows, got.first().tokenizer) == (plain, 6, "tokenize")
    assert not [p for p in got._jdf.queryExecution().optimizedPlan().toString().split("\n")
                if "ArrowEvalPython" in p and "regexp_extract_all" in p]


def test_merges_of_packed_words_equal_replacing(spark):
    """Each word that held a pair used to be walked in Python, once a merge."""
    import random
    from collections import Counter
    rnd = random.Random(5)
    a, b, c, d, e, f = (chr(bpe.FIRST_SYMBOL + i) for i in range(6))
    done, next_ = [(a + b, d)], [(a + a, e), (d + c, f), (e + e, a), (b + f, c), (c + c, c)]
    for _ in range(60):
        words = ["".join(rnd.choices([a, b, c], k=rnd.randint(1, 9))) for _ in range(rnd.randint(0, 40))]
        n = [rnd.randint(1, 9) for _ in words]
        (s, counts), = bpe._unpacked([bpe._packed(words, n)])
        ids, held = bpe._held(s, counts, [p for p, _ in done + next_])
        now = [w.replace(*done[0]) for w in words]
        ids, held = bpe._merge(ids, held, *done[0])
        for pair, new in next_:
            found, want = [(np.zeros(0, "i8"),) * 3], Counter()
            ids, held = bpe._merge(ids, held, pair, new, found)
            after = [w.replace(pair, new) for w in now]
            for sign, state in ((-1, now), (1, after)):
                for w, k in zip(state, n):
                    for p in zip(w, w[1:]):
                        want[p] += sign * k
            now = after
            left, right, total = bpe._sums(*map(np.concatenate, zip(*found)))
            got = {(chr(ord(bpe.END) + x), chr(ord(bpe.END) + y)): z for x, y, z in zip(left.tolist(), right.tolist(), total.tolist())}
            assert got == {p: k for p, k in want.items() if k}


def test_texts_are_counted_once(spark):
    """The alphabet and the words each used to count the words of all texts."""
    from winnow.operators.blocks import role_mask
    seen = spark.sparkContext.accumulator(0)

    def touched(text):
        seen.add(1)
        return text
    texts = spark.createDataFrame([(k, 0, "user", f"the cat {k}") for k in range(20)], "conv_id int, turn int, role string, text string")
    watched = texts.repartition(2).withColumn("text", F.udf(touched, "string").asNondeterministic()("text"))
    vocab, merges = bpe.bpe_train(spark, bpe.word_counts(watched), num_merges=4)
    assert seen.value == 20
    tokenize = bpe.bpe_tokenizer(vocab, merges)
    # Role masks on ids: bounds, sums and rows each used to tokenize the texts.
    seen.value = 0
    watched = F.udf(touched, "string").asNondeterministic()
    got = role_mask(texts, tokenize=lambda text: tokenize(watched(text)))
    want = {r.conv_id: [1, *r.ids] for r in texts.select("conv_id", tokenize("text").alias("ids")).collect()}
    assert {r.conv_id: list(r.seg_ids) for r in got.collect()} == want
    assert seen.value == 20
