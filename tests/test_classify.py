from pyspark.sql import functions as F

from winnow.operators import classify as C


def test_label_tokens_last_label_wins():
    tokens = C.build_label_tokens()
    m = dict(tokens.token_to_label)
    # ' safe' and ' unsafe' share their first character: the later label wins.
    assert m[ord(" ") + 4] == "unsafe"
    assert m[ord("s") + 4] == "safe" and m[ord("S") + 4] == "safe"
    assert m[ord("u") + 4] == "unsafe" and m[ord("U") + 4] == "unsafe"


def test_normalize_prediction_table(spark):
    tokens = C.LabelTokens(((5, "safe"),), ((5, "s"),), (("safe", 5), ("unsafe", 6)))
    rows = [(5, "x"), (9, " Unsafe."), (9, "it is SAFE"), (9, "dunno"), (9, "   ")]
    df = spark.createDataFrame(rows, "tok int, dec string")
    out = df.select(C.normalize_prediction("dec", "tok", tokens).alias("p")).select("p.*").collect()
    assert [(r.classification, r.parse_status) for r in out] == [
        ("safe", "ok"), ("unsafe", "ok"), ("safe", "ok"), ("unsafe", "ok"), ("unsafe", "empty_output")]
    assert all(r.confidence == 5 for r in out)
    assert out[0].reason == C.REASON_FORCED and out[1].reason == C.REASON_FALLBACK


def test_forced_choice_masks_other_tokens(spark):
    tokens = C.build_label_tokens()
    s, u = dict(tokens.answer_ids)["safe"], dict(tokens.answer_ids)["unsafe"]
    df = spark.createDataFrame([([(999, 50.0), (s, 1.0), (u, 0.5)],), ([(999, 1.0)],), ([],)],
                               "scores array<struct<token_id:int,score:double>>")
    got = [r.t for r in df.select(C.forced_choice("scores", tokens).alias("t")).collect()]
    assert got == [s, None, None]


def test_category_counts_shows_all_four(spark):
    recs = spark.createDataFrame([("safe", 5), ("safe", 5), ("unsafe", 5)], "classification string, confidence int")
    got = {(r.classification, r.band): r.n_records for r in C.category_counts(recs).collect()}
    assert got == {("unsafe", "5_plus"): 1, ("unsafe", "4_minus"): 0, ("safe", "5_plus"): 2,
                   ("safe", "4_minus"): 0}


def test_scorer_terms_join_path_equals_inline(spark):
    tokens = C.build_label_tokens()
    df = spark.createDataFrame([("k1", "Licensed under Apache"), ("k2", "plain words"), ("k3", "  ")],
                               "example_id string, text string")
    inline = C.scorer_terms(df, tokens, ["apache"])
    table = C.scorer_terms(df, tokens, spark.createDataFrame([("Apache",)], "term string"))
    pick = lambda d: {r.example_id: r.t for r in d.select("example_id", C.forced_choice("scores", tokens)
                                                            .alias("t")).collect()}
    assert pick(inline) == pick(table)
    assert pick(inline)["k3"] is None


def test_label_tokens_follow_the_rule():
    ids = {" safe": [7, 1], " unsafe": [7, 2], "safe": [3], "Safe": [4], "unsafe": [5, 3], "Unsafe": [], " Safe": [6], " Unsafe": [6]}
    tokens = C.build_label_tokens(lambda s: ids[s], str)
    assert dict(tokens.token_to_label) == {3: "safe", 4: "safe", 5: "unsafe", 6: "unsafe", 7: "unsafe"}
    assert dict(tokens.answer_ids) == {"safe": 3, "unsafe": 5}


def test_null_confidence_has_no_band(spark):
    df = spark.createDataFrame([(5,), (4,), (None,)], "c int")
    assert [r.b for r in df.select(C.confidence_band("c").alias("b")).collect()] == ["5_plus", "4_minus", None]


def test_threshold_sweep_against_counting(spark):
    from winnow.operators.scoring import threshold_sweep
    rows = [(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1), (None, 1), (0.7, None), (1.0, 1)]
    got = threshold_sweep(spark.createDataFrame(rows, "score double, unsafe int"), (0.5, 0.9, 2.0)).collect()
    for r in got:
        pairs = [(s is not None and s >= r.threshold, y == 1) for s, y in rows if y is not None]
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(pairs.count(x) for x in ((True, True), (True, False), (False, True), (False, False)))
        assert r.precision == round(r.tp / max(1, r.tp + r.fp), 9) and r.recall == round(r.tp / max(1, r.tp + r.fn), 9)
    empty = threshold_sweep(spark.createDataFrame([], "score double, unsafe int"), (0.5,)).collect()
    assert [tuple(r) for r in empty] == [(0.5, 0, 0, 0, 0, 0.0, 0.0)]


def test_cross_validated_scores_every_labelled_row_once(spark):
    import zlib

    from winnow.operators.scoring import cross_validated, threshold_sweep
    rows = [(i, "vile words here" if i % 4 == 0 else f"kind words {i}", int(i % 4 == 0)) for i in range(80)]
    rows += [(80, None, 0), (81, "", 0), (None, "kind words", 0), (7, "kind words 7", 0), (99, "no label", None)]
    found = cross_validated(spark.createDataFrame(rows, "doc_id long, text string, unsafe int"), "doc_id").cache()
    got = found.collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _, y in rows if y is not None)
    assert all(r.fold == (0 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3) for r in got)
    half = threshold_sweep(found, (0.5,)).collect()[0]
    assert (half.tp, half.fp, half.fn) == (20, 0, 0)
    one = cross_validated(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, unsafe int"), "doc_id")
    assert all(r.score in (0.0, 1.0) for r in one.collect())
    assert not cross_validated(spark.createDataFrame([], "doc_id long, text string, unsafe int"), "doc_id").collect()


def test_scorer_makes_no_ids_beyond_the_limits(monkeypatch):
    """Every character of a sample used to become an id before the first limit cut them."""
    from winnow.operators import scoring
    lengths, seen = [], []
    plain = scoring._char_encode
    monkeypatch.setattr(scoring, "_char_encode", lambda text: lengths.append(len(text)) or plain(text))

    def model(ids):
        seen.append(ids)
        raise RuntimeError("out of memory")

    sample = "ä1" * 5000
    whole = plain(scoring.SYSTEM_PROMPT + scoring.SAMPLE_INTRO + sample)
    assert scoring.answer(sample, model, encode=scoring._char_encode) == (None, "", 512, "oom")
    assert lengths == [2048] and seen == [whole[:n] for n in scoring.TOKEN_LIMITS]
    # Another encoder is given the whole prompt.
    assert scoring.answer(sample, lambda ids: (len(ids), "s"), (3,), lambda t: [len(t)])[0] == 1
    assert scoring.answer(None, lambda ids: (ids[0], "s"), (3,), lambda t: [len(t)])[0] == len(whole) - len(sample)
