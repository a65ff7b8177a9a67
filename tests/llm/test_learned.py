"""Language ID, toxicity, nearest neighbours: brute force and held-out quality."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from winnow.llm import ann, langid, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, key string, label int, slot int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "k", 1, 2) for i, t, x in rows], SCHEMA)


# language

def test_code_words_are_apart():
    for n in range(2, 12):
        code = langid.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert code.shape[0] == n and min(apart) >= code.shape[1] / 4
    assert min((a != b).sum() for i, a in enumerate(langid.codewords(4)) for b in langid.codewords(4)[:i]) == 4


def test_language_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in langid.op7_langid(spark, SF).collect()}
    given = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert set(rows) == set(given)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    tested = [i for i in rows if rows[i].held_out]
    assert len(tested) > 250 and np.mean([rows[i].lang_pred == given[i] for i in tested]) > 0.98


def test_language_edges(spark):
    rows = [(i, "the house and the garden " * 3, "en") for i in range(30)]
    rows += [(100 + i, "das haus und der garten ist schön " * 3, "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !?", None), (None, "the garden", "en"), (203, "der garten " * 9000, None),
             (204, "你好", None), (205, "the house", "en"), (205, "the house", "en")]
    got = langid.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and by[200].score == 0.0
    assert by[203].lang_pred == "de" and by[205].lang_pred == "en" and by[None].held_out is False
    assert by[204].lang_pred in ("de", "en")
    kept = Counter(r.doc_id for r in langid.accepted(frame(spark, rows)).collect())
    assert kept[205] == 2 and not {200, 201, 202} & set(kept) and kept[203] == 1


def test_language_counts_equal_brute_force(spark):
    texts = [("a", "Abc abc"), ("b", "xyz!"), ("a", "ab")]
    df = spark.createDataFrame(texts, "label string, text string")
    got = {(r.label, r.slot): r.n for r in langid.gram_counts(df).collect()}
    want = Counter()
    for label, text in texts:
        data = b" " + text.lower().encode().translate(langid._BLANKED) + b"      "
        for i in range(len(text) + 4):
            want[(label, int(langid._slots(np.frombuffer(data[i:i + 3], np.uint8))[0]))] += 1
    assert got == want


def test_language_without_training_rows(spark):
    got = langid.identify(frame(spark, [(1, "abc", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.identify(frame(spark, [])).collect() == []


def test_one_language_only(spark):
    got = langid.identify(frame(spark, [(i, "abc def", "en") for i in range(9)])).collect()
    assert {r.lang_pred for r in got} == {"en"}


def test_unsure_text_is_flagged():
    model = langid.CodeModel({"x": np.eye(1, langid.GRAM_SLOTS, 5)[0] * 9, "y": np.eye(1, langid.GRAM_SLOTS, 9)[0] * 9})
    names, scores, close = model.decide([b"qq", b""])
    assert close == [True, False] and names[1] == "und" and scores[0] == pytest.approx(0.5, abs=0.1)


# toxicity

def test_toxicity_gradient_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        slots = np.unique(rng.integers(0, 6, 3))
        rows.append((slots, np.ones(len(slots))))
        margin = (slots == 1).sum() * 3 - (slots == 2).sum() * 2 + rng.logistic() * 0.5
        grades.append(int(margin > 0.5) + int(margin > 2.5))
    grades = np.array(grades)
    model = toxicity.fit(rows, grades)

    def loss(w, t):
        total = 0.0
        for (s, v), g in zip(rows, grades):
            edge = np.concatenate(([0.0], 1 / (1 + np.exp(-(t - w[s] @ v))), [1.0]))
            total -= np.log(edge[g + 1] - edge[g])
        return total / len(rows) + 0.5e-5 * (w * w).sum()
    best = loss(model.weights, model.thresholds)
    assert (np.diff(model.thresholds) > 0).all()
    for slot in range(6):
        for d in (-0.05, 0.05):
            w = model.weights.copy()
            w[slot] += d
            assert loss(w, model.thresholds) > best - 1e-4


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    test = [(r.doc_id, r.toxic) for r in labels.where("doc_id % 2 = 1").collect()]
    clean = [got[i].toxic for i, t in test if t == 0]
    toxic = [got[i].toxic for i, t in test if t == 1]
    # Some labels sit on copies without any toxic word; those with one are found.
    insult = re.compile("trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron")
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = [got[i].toxic for i, t in test if t == 1 and insult.search(texts[i].lower())]
    assert np.mean(clean) < 0.01 and np.mean(marked) > 0.9 and np.mean(toxic) > 0.5
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic for r in got.values())


def test_toxicity_counts_against_brute_force(spark):
    rows = [("a b a c", True), ("b", False), (None, True), ("", False), ("C c c", True), ("b a", False), ("\u00e9t\u00e9 " * 5000, False)]
    kinds, n = toxicity.document_counts(toxicity.word_rows(spark.createDataFrame(rows, "text string, hit boolean")))
    assert n.tolist() == [4, 3]
    want = np.zeros((2, toxicity.SLOTS))
    for text, hit in rows:
        for word in set((text or "").lower().split()):
            want[int(hit), toxicity.word_slots(word.encode())[0]] += 1
    assert (kinds == want).all()
    # z of the shares of documents, and the least number of toxic rows.
    clean, toxic = np.zeros((2, toxicity.SLOTS))
    clean[[1, 2]], toxic[[1, 2, 3]] = [10, 900], [90, 95, 2]
    assert np.flatnonzero(toxicity.marking_words(np.array([clean, toxic]), np.array([1000.0, 100.0]))).tolist() == [1]


def test_toxicity_shuffles_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        small = toxicity.train(docs, labels, max_rows=50)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (np.diff(small.thresholds) > 0).all()


def test_toxicity_edges(spark):
    docs = [(i, ("nasty " * (1 + i % 4) if i % 5 == 0 else "") + f"word{i} plain text", None) for i in range(300)]
    docs += [(500, None, None), (501, "", None), (None, "nasty nasty nasty", None), (502, "plain " * 20000 + "nasty nasty", None),
             (0, "nasty plain", None)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(9999, 1, 1), (1, 0, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, docs), labels)
    got = toxicity.severity(frame(spark, docs), model).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[None].toxic and by[502].toxic and not by[500].toxic and not by[501].toxic and not by[1].toxic
    assert toxicity.severity(frame(spark, []), model).collect() == []


def test_toxicity_of_words_weaker_than_the_strongest(spark):
    # One word in every toxic row, and one in a fifth of those and no clean one.
    docs = [(i, f"plain text {i % 7} " + ("foul " + ("crude " if i % 25 == 0 else "") if i % 5 == 0 else ""), None)
            for i in range(1000)] + [(5000, "plain crude text", None), (5001, "plain text", None)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1000)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, docs), labels)
    slot = {w: int(toxicity.word_slots(w.encode())[0]) for w in ("foul", "crude", "plain")}
    assert model.weights[slot["crude"]] > 0 and model.weights[slot["foul"]] > 0 and model.weights[slot["plain"]] == 0
    by = {r.doc_id: r.severity for r in toxicity.severity(frame(spark, docs), model).collect()}
    assert by[5000] > by[5001]


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, [(1, "a", None)]), labels)
    assert [r.severity < 1e-6 for r in toxicity.severity(frame(spark, [(1, "a", None)]), model).collect()] == [True]


# nearest neighbours

def brute_nearest(rows, queries, k):
    out = {}
    for q, x in queries:
        d = [(float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, v in rows if i != q]
        out[q] = sorted(d)[:k]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, id int, v string, leaf double")


def test_nearest_recall_and_scores(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = {}
    for r in ann.op9_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    assert set(got) == set(want)
    hits = 0
    by = dict(rows)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        assert [found[i] for i in range(1, 11)] == sorted(found.values())
        for score, i in found.values():
            assert score == pytest.approx(float(np.sqrt(((np.array(by[q]) - np.array(by[i])) ** 2).sum())), rel=1e-14)
        hits += len({i for _, i in found.values()} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_nearest_edges_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1, 70)] + [(100, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0])]
    rows += [(300 + i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    bad = [(400, None), (500, [0.0, 0.0, 0.0]), (600, [float("nan"), 0.0, 1.0]), (700, [None, 1.0, 1.0]),
           (800, [float("inf"), 0.0, 0.0]), (900, []), (1000, [1.0, 2.0])]
    got = ann.nearest(vectors(spark, rows + bad), ann.F.col("id") % 100 == 0, leaf_rows=8, shard_rows=10, target=1.0).collect()
    want = brute_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(found) == set(want)
    assert [i for _, i in found[100]] == list(range(1, 11))
    for q in want:
        assert [i for _, i in found[q]] == [i for _, i in want[q]]


@pytest.mark.parametrize("base, spread", [(1e8, 1.0), (0.0, 1e200), (0.0, 1e-160)])
def test_nearest_large_norms_and_tiles(spark, base, spread):
    rng = np.random.default_rng(4)
    x = base + rng.normal(size=(400, 6)) * spread
    x[7] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in ann.nearest(docs, ann.F.col("id") % 100 == 0, leaf_rows=4, shard_rows=50, target=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 100, 200, 300):
        d = np.sqrt((((x - x[q]) / spread) ** 2).sum(1)) * spread
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10].tolist()
        assert [i for _, i, _ in sorted(got[q])] == want
        assert np.allclose([s for *_, s in sorted(got[q])], d[want], rtol=1e-12, atol=0)


def test_nearest_few_rows_and_empty(spark):
    assert ann.nearest(vectors(spark, []), ann.F.col("id") % 100 == 0).collect() == []
    assert ann.nearest(vectors(spark, [(0, [1.0])]), ann.F.col("id") % 100 == 0).collect() == []
    got = ann.nearest(vectors(spark, [(0, [1.0]), (5, [3.0]), (0, [1.0])]), ann.F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 0, 0.0), (0, 2, 5, 2.0)]


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(3).normal(size=(900, 8))
    tree = ann.Tree(x, 20)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves))
    assert tree.visits(x[7], 1)[0] == tree.assign(x[7:8])[0]
