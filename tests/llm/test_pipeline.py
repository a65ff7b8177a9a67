"""The pipeline against brute force, stage by stage and whole."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from test_dedup import brute_components, brute_exact
from test_tokens import check_packing

import __spark_entry__ as entry
import corpus_pipeline
from winnow.llm import langid
from winnow.llm.suffix_dedup import LENGTH

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def brute_cut(rows, length=corpus_pipeline.PASSAGE_BYTES, words=corpus_pipeline.PASSAGE_WORDS):
    """Runs of bytes covered by repeated strings go if they have so many words or LENGTH bytes."""
    data = [(i, t.encode()) for i, t in rows]
    seen = Counter(d[s:s + length] for _, d in data for s in range(len(d) - length + 1))
    out = []
    for i, d in data:
        flag = np.zeros(len(d) + 2, bool)
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                flag[s + 1:s + length + 1] = True
        text, at = "", 0
        edges = np.flatnonzero(flag[1:] != flag[:-1]).tolist()
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= LENGTH or len(d[a:b].split()) >= words:
                text += d[at:a].decode("utf-8", "ignore")
                at = b
        out.append((i, text + d[at:].decode("utf-8", "ignore")))
    return out


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "suffix_dedup", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_whole_pipeline(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    model = langid.train(table.where(~langid.held_out("doc_id")).select(table.lang.alias("label"), "text"))
    names, _, close = model.decide([t.encode() for _, t, _ in rows])
    rows = [(i, t) for (i, t, _), n, c in zip(rows, names, close) if n != "und" and not c]
    assert len(rows) > 150
    kept = {r[0] for r in brute_exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    roots = {key: root for key, _, root in brute_components(rows)}
    rows = [r for r in rows if roots[r[0]] == r[0]]
    rows = brute_cut(rows)
    check_packing(corpus_pipeline.run(spark, SF).collect(), rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, SF).columns == COLUMNS


def test_clean_documents_stay_as_they_are(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    clean = [(i, " ".join(rng.choice(words, 80))) for i in range(40)]
    docs = documents(spark, clean + [(900, "12 34"), (901, None), (902, "")])
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == clean


def test_exact_stage_with_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (3, "x"), (None, "x"), (None, "y"), (4, None), (5, ""), (6, "a  b c"), (6, "q")]
    got = Counter((r.doc_id, r.text) for r in stage("exact_dedup")(spark, documents(spark, rows), SF).collect())
    assert got == {(1, "a b"): 1, (3, "x"): 1, (None, "y"): 1, (4, None): 1, (6, "a  b c"): 1, (6, "q"): 1}


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i % 97}{i % 89}" for i in range(600))
    rows = [(5, text), (3, text + " "), (9, text.upper()), (2, "another one entirely different"), (None, "third text here now")]
    got = sorted(((r.doc_id, r.text) for r in stage("simhash")(spark, documents(spark, rows), SF).collect()), key=repr)
    assert got == sorted([(3, text + " "), (2, rows[3][1]), (None, rows[4][1])], key=repr)


def test_near_stage_with_repeated_and_null_ids(spark):
    copied = " ".join(f"word{i % 97}{i % 89}" for i in range(600))
    clean = [" ".join(f"{w}{i * i % 83}" for i in range(300)) for w in ("left", "right", "upper", "lower")]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (3, copied), (7, copied.upper()), (7, clean[2]), (None, copied + " "),
            (8, clean[3]), (8, clean[3].upper())]
    got = Counter((r.doc_id, r.text) for r in stage("simhash")(spark, documents(spark, rows), SF).collect())
    low = min(rows[-2:], key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())
    assert got == Counter([rows[0], rows[1], rows[3], rows[5], low])


def test_passages_are_cut_and_characters_stay_whole(spark):
    passage = "é" * 250
    rows = [(1, "start " + passage + " end"), (2, "other " + passage + " tail"), (3, None), (4, "short")]
    out = stage("suffix_dedup")(spark, documents(spark, rows), SF).collect()
    got = {r.doc_id: (r.text, r.n_chars) for r in out}
    assert {i: t for i, (t, _) in got.items()} == dict(brute_cut([(i, t) for i, t in rows if t is not None])) | {3: None}
    assert got[1][0] != rows[0][1] and got[4][0] == "short"
    assert all(n == len(t or "") for t, n in got.values())


def test_passages_of_fifty_words_are_cut_below_400_bytes(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    fifty, forty = prose(51), prose(40)
    assert 160 < len(fifty) < 400 and 160 < len(forty) < 400
    rows = [(i, f"{prose(60)} {fifty} {prose(60)}") for i in range(3)] + [(10 + i, f"{prose(30)} {forty} {prose(30)}") for i in range(3)]
    got = {r.doc_id: r.text for r in stage("suffix_dedup")(spark, documents(spark, rows), SF).collect()}
    assert got == dict(brute_cut(rows))
    assert all(fifty not in got[i] and len(got[i].split()) >= 118 for i in range(3)) and all(got[i] == t for i, t in rows[3:])


def test_stages_with_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i * i % 9973}" for i in range(120_000))
    rows = [(1, long), (2, "one short text of its own"), (3, None)]
    docs = documents(spark, rows).selectExpr("*", "1 AS id", "'x' AS th", "2 AS __bucket", "'y' AS spans", "3 AS stays")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        assert {1, 2} <= {r.doc_id for r in out.collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name):
    assert stage(name)(spark, documents(spark, []), SF).collect() == []


def test_groups_of_copies_leave_one_document(spark):
    rows = [(i, f"text number {i // 10} with a few more words") for i in range(100)]
    got = stage("exact_dedup")(spark, documents(spark, rows), SF).collect()
    by = defaultdict(list)
    for r in got:
        by[r.text].append(r.doc_id)
    assert sorted(by.values()) == [[i] for i in range(0, 100, 10)]
