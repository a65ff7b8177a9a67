"""Line deduplication, cross-tokenizer alignment and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.llm import alignment, line_dedup, periodic
from winnow.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Line deduplication

def line_key(line: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def brute_lines(rows):
    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            rank = (doc is None, doc or 0)
            owner[line_key(line)] = min(owner.get(line_key(line), rank), rank)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(line_key(x)) < 10 or owner[line_key(x)] == (doc is None, doc or 0)]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


LINES = [
    (5, "A line that repeats\nshort\nshort\nown line of five, long"), (3, "  a LINE that repeats\t\nshort"),
    (9, "a line that repeats\na line that repeats\n\nÄ LINE THAT REPEATS"), (7, "ä line that repeats\nÄ line that repeats"),
    (1, None), (2, ""), (None, "a line that repeats\nonly in rows without id"), (None, "only in rows without id"),
    (11, "ninechars\nten chars."), (12, "NINECHARS\nTEN CHARS. "), (13, "twice in one row\ntwice in one row"),
    (13, "twice in one row\nand elsewhere, really"), (14, "and elsewhere, really\n" * 300), (14, "and elsewhere, really\n" * 300),
    (15, "nbsp stays at the end \nnbsp stays at the end"), (16, "nbsp stays at the end"),
]


@pytest.mark.parametrize("batches,fan", [(1, 4), (5, 2), (9, 3)])
def test_lines_against_brute_force(spark, batches, fan):
    random.seed(batches)
    pool = [f"line number {i} of the pool" for i in range(30)]
    rows = LINES + [(i, "\n".join(random.choice(pool).title() for _ in range(random.randrange(8)))) for i in range(20, 90)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("th", F.lit(0))
    out = line_dedup.line_dedup(docs, batches=batches, fan=fan)
    assert sorted(map(tuple, out.collect()), key=str) == brute_lines(rows)


def test_lines_hot_line_and_empty_table(spark):
    rows = [(i, f"the line that everybody has\nline of document {i} alone") for i in range(400)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA), batches=3)
    assert sorted(map(tuple, out.collect()), key=str) == brute_lines(rows)
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_line_runs_are_levels_and_outlive_the_state(spark):
    state = line_dedup.LineRuns(spark, fan=2)
    rows = lambda pairs: line_dedup.key_rows(
        line_dedup.document_rows(spark.createDataFrame(pairs, SCHEMA), "doc_id", "text"), 10)
    gone = [state.add(rows([(i, f"line of batch {i}, long\nline of every batch")])).count() for i in range(7)]
    assert gone == [0] + [1] * 6
    # Seven batches, two runs a level: as the digits of 7.
    assert [level for level, _ in state.runs] == [2, 1, 0]
    state.save_manifest()
    again = line_dedup.LineRuns.open(spark, state.folder, fan=2)
    assert again.add(rows([(99, "line of batch 3, long\nline never seen before")])).count() == 1
    assert [level for level, _ in again.runs] == [3]


def test_line_runs_are_not_shuffled(spark):
    state = line_dedup.LineRuns(spark)
    for i in range(2):
        state.add(line_dedup.key_rows(line_dedup.document_rows(
            spark.createDataFrame([(i, "line of every batch")], SCHEMA), "doc_id", "text"), 10))
    plan = state.new_keys(state.runs[0][1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort [" not in plan, plan


# Cross-tokenizer alignment

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a_path, b_path = alignment.paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path), alignment.Aligner(a_path, b_path)


def brute_align(libraries, text):
    """Groups and links by the libraries' ids of the whole text and sets of ends."""
    a_lib, b_lib, own = libraries
    if not text:
        return 0, 0, "", []
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    parts = [[own.a.bytes_of[i] for i in a], [own.b.bytes_of[i] for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return 0, 0, "", []
    ends = []
    for part in parts:
        at, found = 0, []
        for x in part:
            at += len(x)
            found.append(at)
        ends.append(found)
    groups, links, last = [], [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        ga = [i for i, e in zip(a, ends[0]) if last < e <= end]
        gb = [i for i, e in zip(b, ends[1]) if last < e <= end]
        groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        links.append((ga[-1], gb[-1]))
        last = end
    return len(a), len(b), ";".join(groups), links


PARTS = ["a", "the", " ", "   ", "\n", "\t", "é", "ß", "漢字", "🙂", "<s>", "<|endoftext|>", "<0x0A>", "'s", "'", "▁", "\r\n",
         "0", "12", ".", ",", "}", "\x00", "word", "Straße", " ", "　", "é", "x²", "x" * 120, "&&&"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_windows_equal_brute_force(libraries, text):
    n_a, n_b, groups, links = libraries[2].align([text])[0]
    assert (n_a, n_b, groups, [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()]) == brute_align(libraries, text)


PLAIN = ["a", "the", " ", "  ", "\n", "é", "Straße", "'s", "'", "don't", "12", "7", ".", ",", "(", "}", "-", "_", "word", "ÿ", "\t"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PLAIN), max_size=20).map("".join), min_size=1, max_size=6))
def test_texts_of_one_call_share_units(libraries, texts):
    """Plain texts, whose units serve both sides, beside texts read by each side alone."""
    got = libraries[2].align([*texts, None, "漢字 and " + texts[0]])
    for text, (n_a, n_b, groups, links) in zip([*texts, None, "漢字 and " + texts[0]], got):
        assert (n_a, n_b, groups, [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()]) == brute_align(libraries, text)


def test_alignment_counts_against_brute_force(spark, libraries):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()[:60]]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, " "), (103, "▁x"), (None, "plain words"), (104, "plain words"),
                                     (104, "plain words"), (105, "long " * 30_000), (106, "y" * 20_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("pairs", F.lit(1)).withColumn("block", F.lit("x"))
    found = stored(alignment.alignments(docs, *alignment.paths(), block_bytes=5_000), "test-align")
    got = alignment.with_counts(found, "groups")
    brute = [(doc, *brute_align(libraries, text)) for doc, text in rows if doc not in (105, 106)]
    # Long texts: one group over and over; their links count too.
    for doc, text in rows:
        if doc in (105, 106):
            n_a, n_b, groups, links = libraries[2].align([text])[0]
            brute.append((doc, n_a, n_b, groups, [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()]))
    counts = Counter(link for row in brute for link in row[4])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = [(doc, n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
            for doc, n_a, n_b, groups, links in brute]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.with_counts(stored(alignment.alignments(docs, *alignment.paths()), "test-align")).collect() == []


# Periodic runs

def brute_runs(words, min_length=24, min_exponent=3):
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(q % d == 0 and all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(min_length, min_exponent * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out)


PERIODIC = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 6)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(PERIODIC, st.sampled_from([(24, 3), (5, 2), (2, 2), (30, 4)]))
def test_runs_equal_brute_force(parts, limits):
    words = [b"%d" % w for root, times in parts for w in root * times]
    assert periodic.text_runs(words, *limits) == brute_runs(words, *limits)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=40))
def test_extensions_are_common_prefixes(symbols):
    import numpy as np
    ext = periodic.SuffixTree(symbols).extensions()
    pairs = [(i, j) for i in range(len(symbols)) for j in range(i + 1, len(symbols) + 1)]
    common = ext.common(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    for (i, j), c in zip(pairs, common):
        k = 0
        while j + k < len(symbols) and symbols[i + k] == symbols[j + k]:
            k += 1
        assert k == c


def brute_op13(doc, text):
    words = [w for w in (text or "").translate({ord(c): " " for c in BLANKS}).split(" ") if w]
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (doc, len(runs), *(top or (None, None, None)), top and top[1] * 1000 // top[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query_against_brute_force(spark, tmp_path):
    random.seed(5)
    word = lambda k: f"w{random.randrange(k)}"
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a " * 24), (5, "a " * 23), (6, "x y z " * 9), (7, "a b " * 11 + "a"),
            (None, "again " * 40), (8, "s t u v " * 30 + "end"), (8, "s t u v " * 30 + "end"), (9, "p q " * 20 + "r s " * 20)]
    for i in range(10, 130):
        parts = [" ".join([word(9) for _ in range(random.randrange(1, 12))] * random.randrange(1, 9)) for _ in range(random.randrange(6))]
        rows.append((i, random.choice([" ", "\n", "\x0b"]).join(parts)))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit(0)).withColumn("id", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([brute_op13(*r) for r in rows], key=str)


def test_periodic_long_text_and_empty_table(spark):
    text = "one two three four five six seven " * 6_000 + "end " + " ".join(f"w{i}" for i in range(20_000))
    out = periodic.periodic_runs(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert [tuple(r) for r in out[0].runs] == [(0, 42_000, 7)] and out[0].n_words == 62_001
    assert out[0].collapsed.startswith("one two three four five six seven end w0 ")
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
