"""Exact, suffix-array and SimHash deduplication against brute force."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from winnow.llm import common, suffix_dedup
from winnow.llm.exact_dedup import BLANKS, SQL, exact_dedup, op10_exact_dedup
from winnow.llm.simhash import components, fingerprint, fingerprint_links, near_duplicates, op3_simhash
from winnow.llm.suffix_dedup import LENGTH, op1_suffix_dedup, remove_repeats, repeated_spans, sort_suffixes
from winnow.plans.oracle import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, fp int, bytes string, keep string, run int, core int"


def frame(spark, pairs):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 3, 4) for i, t in pairs], SCHEMA)


def edge_rows():
    body = "".join(chr(97 + (i * i) % 23) for i in range(500))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, body), (8, "x" + body + "y"),
            (9, "é" * 700), (9, "é" * 700), (None, "ab"), (None, "lonely"), (10, "word " * 3000), (11, "q" * 1000)]


# exact

def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in (t or "") if c not in BLANKS)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_exact_edges(spark, buckets):
    rows = edge_rows() + [(100 + i, "same text" + " " * (i % 3)) for i in range(60)]
    got = exact_dedup(frame(spark, rows), buckets=buckets).drop("n_code_points").collect()
    assert Counter(map(tuple, got)) == Counter(brute_exact(rows))


def test_exact_empty(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_exact_oracle(spark):
    assert compare(op10_exact_dedup(spark, SF), duckdb_connection(SF), SQL)[:2] == (True, True)


def test_exact_is_native(spark):
    plan = op10_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# suffix

def brute_suffix(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s:s + length] for _, d in data for s in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, int)
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                gone[s] += 1
                gone[min(len(d), s + length)] -= 1
        flag = np.cumsum(gone)[:-1] > 0
        spans = int(flag[:1].sum() + ((~flag[:-1]) & flag[1:]).sum())
        kept = bytes(b for b, f in zip(d, flag) if not f)
        out.append((i, len(d), int(flag.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(rows):
    return Counter((r.doc_id, r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans),
                    hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


@pytest.mark.parametrize("hot", [4096, 0])
def test_suffix_edges(spark, hot):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh ij"), 600))
    noise = lambda: "".join(rng.choice(list("klmnopq rs"), 300))
    rows = edge_rows() + [(200 + i, noise() + passage[i % 7:] + noise()) for i in range(30)]
    got = remove_repeats(frame(spark, rows), hot=hot).collect()
    assert digest(got) == Counter(brute_suffix(rows, LENGTH))


@pytest.mark.parametrize("hot", [4096, 0])
def test_suffix_of_rows_repeated_often(spark, hot):
    rng = np.random.default_rng(7)
    passage, tail = ("".join(rng.choice(list("abcdefgh ij"), 450)) for _ in range(2))
    rows = [(1, passage + tail)] * 50 + [(None, passage + "x")] * 50 + [(2, "y" + passage), (3, tail)]
    docs = frame(spark, rows).repartition(8)
    assert digest(remove_repeats(docs, hot=hot).collect()) == Counter(brute_suffix(rows, LENGTH))
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(keyed, LENGTH, hot).collect()
    assert len(spans) == 4
    for r in spans:
        assert max(Counter((s.a, s.b) for s in r.spans).values()) == 1


def test_suffix_short_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "".join(rng.choice(list("ab"), 90))) for i in range(12)]
    assert digest(remove_repeats(frame(spark, rows), length=35).collect()) == Counter(brute_suffix(rows, 35))


def test_suffix_empty(spark):
    assert remove_repeats(frame(spark, [])).collect() == []


def test_suffix_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(map(tuple, op1_suffix_dedup(spark, SF).collect()))
    assert got == Counter(brute_suffix(rows, LENGTH)) and any(r[2] for r in got)


def test_sort_suffixes_matches_counting():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    starts = np.arange(3000 - 13)
    weight = (rng.random(len(starts)) < 0.01) + 1
    seen = Counter()
    for s, w in zip(starts, weight):
        seen[data[s:s + 13].tobytes()] += int(w)
    want = [seen[data[s:s + 13].tobytes()] > 1 for s in starts]
    assert sort_suffixes(data, starts, weight, 13).tolist() == want


# simhash

def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        t = t.replace(b, " ")
    words = [w for w in t.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_bits=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= max_bits:
            label[root(a)] = root(b)
    low = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        low[root(i)].append(key)
    name = {r: min((k for k in keys if k is not None), default=None) for r, keys in low.items()}
    return Counter((key, f"{fps[i]:016x}", name[root(i)]) for i, (key, _) in enumerate(rows))


def test_simhash_edges(spark):
    rows = edge_rows() + [(20, "A b C d"), (21, "a B c D"), (22, "one"), (23, "ONE"), (24, "İstanbul x y z")]
    assert Counter(map(tuple, near_duplicates(frame(spark, rows)).collect())) == brute_components(rows)


def test_simhash_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, op3_simhash(spark, SF).collect())) == brute_components(rows)


def test_simhash_empty(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i % 4001}" for i in range(40_000))
    assert fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_all_links_are_found(spark, bits):
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    fps = {int(c) for c in centre} | {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for c in centre:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(int(c) ^ sum(1 << int(f) for f in flips))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast(spark, tmp_dir):
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_dir}/nodes")
    links = fingerprint_links(spark.read.parquet(f"{tmp_dir}/nodes"))
    assert "Broadcast" not in plan_of(links)
    links.collect()
    assert "Broadcast" not in plan_of(links)


def test_repeated_cores_are_not_broadcast(spark, monkeypatch):
    plans = {}

    def stored(df, name):
        plans[name] = plan_of(df)
        return common.stored(df, name)
    monkeypatch.setattr(suffix_dedup, "stored", stored)
    body = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(400))
    got = {r.doc_id: len(r.spans) for r in remove_repeats(frame(spark, [(1, body), (2, "x" + body), (3, "y")])).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
    assert "SortMergeJoin" in plans["suffix-found"] and "Broadcast" not in plans["suffix-found"]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (103, 105)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 103: 100, 105: 100}
