"""Randomised checks against plain-Python statements of the rules."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from winnow.functions.text import TEXT_FIELDS, with_extracted_text
from winnow.operators.classify import CATEGORY_FILES
from winnow.operators.merge import merge_shards

CATS = [name for _, name in CATEGORY_FILES]
ERR = "inference_error: RuntimeError: x"

record = st.tuples(st.sampled_from("ABCDE"), st.integers(0, 3), st.integers(0, 1), st.integers(0, 30),
                   st.booleans(), st.sampled_from(["safe", "unsafe"]))


def python_merge(records):
    """First success in (category, rank, line) order, else the first failure."""
    best = {}
    for key, cat, rank, line, failed, label in sorted(records, key=lambda r: (r[1], r[2], r[3])):
        cur = best.get(key)
        if cur is None or (cur[3] and not failed):
            best[key] = (cat, rank, line, failed)
    return best


@settings(max_examples=10, deadline=None)
@given(st.lists(record, min_size=1, max_size=30, unique_by=lambda r: (r[1], r[2], r[3])))
def test_merge_matches_python_rule(spark, records):
    rows = []
    for key, cat, rank, line, failed, label in records:
        value = json.dumps({"example_id": key, "classification": label, "confidence": 5,
                            "parse_status": ERR if failed else "ok"})
        rows.append((CATS[cat], rank, line, value))
    df = spark.createDataFrame(rows, "category string, rank int, line long, value string")
    got = {r.example_id: (r.rank, r.line) for r in merge_shards(df).collect()}
    want = {k: (v[1], v[2]) for k, v in python_merge(records).items()}
    assert got == want


scalar = st.one_of(st.text(max_size=8), st.integers(-1000, 1000), st.booleans(), st.none())
message = st.dictionaries(st.sampled_from(["content", "role", "x"]), scalar, max_size=3)
sample_obj = st.fixed_dictionaries({}, optional={
    "messages": st.lists(st.one_of(message, st.integers(0, 3)), max_size=3),
    **{k: scalar for k in TEXT_FIELDS}, "other": scalar})
sample_list = st.lists(st.one_of(st.text(max_size=6), st.dictionaries(st.text(max_size=3), st.one_of(
    st.text(max_size=4), st.integers(0, 9)), max_size=3)), max_size=4)


def py_str(v):
    if v is None:
        return "None"
    if isinstance(v, bool):
        return "True" if v else "False"
    return str(v)


def python_extract(obj):
    parts = []
    if isinstance(obj, dict):
        for m in obj.get("messages", []) if "messages" in obj else []:
            if isinstance(m, dict) and "content" in m:
                parts.append(py_str(m["content"]))
        parts += [py_str(obj[k]) for k in TEXT_FIELDS if k in obj]
    elif isinstance(obj, list):
        for item in obj:
            if isinstance(item, str):
                parts.append(item)
            elif isinstance(item, dict):
                parts += [v for _, v in sorted(item.items()) if isinstance(v, str)]
    else:
        parts.append(py_str(obj))
    return "\n".join(parts)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(sample_obj, sample_list, scalar), min_size=1, max_size=12))
def test_extract_text_matches_python_rules(spark, objs):
    samples = [json.dumps(o, sort_keys=True, ensure_ascii=False) for o in objs]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, sample string")
    got = {r.i: r.text for r in with_extracted_text(df, "sample", "text").collect()}
    for i, o in enumerate(objs):
        assert got[i] == python_extract(o), (samples[i], got[i])
