from pyspark.sql import functions as F

from winnow.functions.keys import example_key
from winnow.functions.text import clean_response, py_strip, with_extracted_text

EXTRACT_CASES = [
    ('{"messages":[{"content":"hi","role":"user"},{"content":5,"role":"assistant"},{"role":"x"},7]}', "hi\n5"),
    ('{"answer":null,"input":3,"text":"a"}', "a\nNone\n3"),
    ('{"messages":[{"content":"m"}],"text":"t"}', "m\nt"),
    ('["a",{"k":"v","z":1}]', "a\nv"),
    ('"str"', "str"),
    ("7", "7"),
    ("true", "True"),
    ("null", "None"),
    ("not json", "not json"),
    ("{}", ""),
    ('{"messages":null}', ""),
    (None, ""),
]


def test_extract_text_rules(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(EXTRACT_CASES)], "i int, sample string")
    got = {r.i: r.text for r in with_extracted_text(df, "sample", "text").collect()}
    for i, (_, want) in enumerate(EXTRACT_CASES):
        assert got[i] == want, (EXTRACT_CASES[i], got[i])


def test_example_key(spark):
    df = spark.createDataFrame([("d", "default", "train", 0), ("d", None, "train", 5)],
                               "source_dataset string, config string, split string, row_index long")
    got = [r.k for r in df.select(example_key().alias("k")).collect()]
    assert got == ["d\x1fdefault\x1ftrain\x1f0", "d\x1fNone\x1ftrain\x1f5"]


def test_py_strip_matches_python(spark):
    samples = ["  a b \n", "\x1c\x1dx\x1e\x1f", "　y ", "\tz\u0085", "", "   "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.t for r in df.select(py_strip("s").alias("t")).collect()]
    assert got == [s.strip() for s in samples]


def test_clean_response(spark):
    df = spark.createDataFrame([("Berlin.\n\nFrage: x",), ("ja",), ("",)], "t string")
    rows = df.select(clean_response("t", "fewshot").alias("f"), clean_response("t", "chat").alias("c")).collect()
    assert [r.f for r in rows] == ["Berlin.", "...", "..."]
    assert [r.c for r in rows] == ["Berlin.\n\nFrage: x", "ja", "..."]
