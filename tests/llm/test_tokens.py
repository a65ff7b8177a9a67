"""Packing, id files and SentencePiece against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from winnow.llm import packing, pieces, range_coder, token_ids
from winnow.llm.token_ids import IdEncoder, WordIds

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, ids string, block int, start int, length int, number int"
BYTE, WORD = packing.byte_bpe_path(), range_coder.word_bpe_path()


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in pairs], SCHEMA)


def edge_rows():
    return [(1, None), (2, ""), (3, " "), (4, "it's  a\n\n test\t!!"), (5, "word " * 5000), (6, "x" * 9000),
            (7, "Ünïcödé 你好 \U0001F600 ﬁ İı é"), (8, "<|endoftext|> a <|startoftext|>"), (9, "a"), (9, "a"),
            (None, "null id"), (10, "don'T 'S we'll 12345 ½ x²"), (11, "\x00\x1c\x85\xa0 b")]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ids

@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(spark, path):
    enc, library = IdEncoder(path), Tokenizer.from_file(path)
    texts = [t or "" for _, t in edge_rows() + documents(spark)]
    rng = random.Random(3)
    alphabet = "ab Cé'sß.,!?12\n\t  \r-_žĐ\x7f%$\"’"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_ids_of_many_texts_equal_the_library(spark, monkeypatch):
    """Words used to be looked up one by one; now each distinct one of many texts goes to the library once."""
    library, rng = Tokenizer.from_file(WORD), random.Random(5)
    texts = [t or "" for _, t in edge_rows() + documents(spark)]
    alphabet = "ab Cé'sß.,!?12\n\t  \r-_žĐ%$\"’''strevmldSTREVMLD"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += ["x" * 64 + "y", "x" * 64 + "z", "x" * 64 + "y a", "'", "'s", "'r", "'l", "a'll'd", "\0", "a\0b", "ſ × ÷ ŉ"]
    rng.shuffle(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    enc, asked = WordIds(WORD), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (asked.extend(words), learn(words)))

    def check(some, wanted):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in enc.many(some)] == wanted
    check(texts, want)
    assert len(asked) == len(set(asked)) > 1000
    for i in range(0, len(texts), 97):
        check(texts[i:i + 97], want[i:i + 97])
    assert len(asked) == len(set(asked))
    check([], [])
    # A full memory starts anew; different words with one hash are found out.
    monkeypatch.setattr(token_ids, "_MET", 10)
    check(texts[:300], want[:300])
    monkeypatch.setattr(token_ids, "_MIX", np.uint64(0))
    check(texts, want)


# packing

def check_packing(rows, docs, tokens=1024):
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for key, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % tokens + 1
        at = [0, *range(first, len(ids), tokens), len(ids)]
        for i, (a, b) in enumerate(zip(at, at[1:])):
            want[(key, i, a, b - a, crc(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= tokens
    return len(sequences)


def test_packing_edges(spark):
    docs = edge_rows()
    check_packing(packing.pack(frame(spark, docs), BYTE).collect(), docs)


def test_packing_whole_table(spark):
    docs = documents(spark)
    rows = packing.op4_packing(spark, SF).collect()
    n = check_packing(rows, docs)
    assert n <= np.ceil(sum(r.length for r in rows) / 1024) * 1.01 + 1


def test_packing_small_sequences(spark):
    docs = documents(spark)[:60]
    check_packing(packing.pack(frame(spark, docs), BYTE, tokens=64).collect(), docs, 64)


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), BYTE).collect() == []


def unfold(plan):
    """Sequences -> lengths from a plan's ranges."""
    out = defaultdict(list)
    for length, r0, r1, s0, offset in plan:
        for i in range(r1 - r0):
            out[s0 + i].append((offset, length))
    return out


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    rng = random.Random(4)
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 101), 60)}
    plan = packing.best_fit(counts, 100, 4, 6000 + 4000, (1.0, 0.5, 0.3), rule)
    placed = Counter()
    for parts in unfold(plan).values():
        lengths = [n for _, n in parts]
        assert sum(lengths) <= 100 and len(lengths) <= 4 and sum(n * n for n in lengths) <= 10_000
        placed.update(lengths)
    assert placed == counts


def test_best_fit_equals_piece_by_piece():
    rng = random.Random(9)
    lengths = sorted((rng.randrange(1, 65) for _ in range(500)), reverse=True)
    bins = []
    for n in lengths:
        fits = [b for b in bins if b >= n]
        if fits:
            bins[bins.index(min(fits))] -= n
        else:
            bins.append(64 - n)
    plan = packing.best_fit(Counter(lengths), 64, 64, 64 * 64)
    assert len(unfold(plan)) == len(bins)


# id files

def test_coder_round_trip():
    rng = np.random.default_rng(1)
    cases = [np.zeros(0), np.array([5]), rng.integers(0, range_coder.MAX_ID + 1, 3000), np.full(5000, 7),
             rng.integers(0, 5, 9000), np.arange(4097), np.zeros(2048), rng.zipf(1.3, 6000) % 50000]
    for ids in cases:
        ids = ids.astype(np.uint32)
        docs, back = range_coder.read_file(range_coder.write_file([(3, len(ids)), (None, 0)], ids, block=1000))
        assert docs == [(3, len(ids)), (None, 0)] and np.array_equal(back, ids)


def test_repetitive_ids_shrink():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    assert len(range_coder.write_file([(1, len(ids))], ids)) < len(ids) / 4


def test_blocks_are_independent_and_checked():
    ids = np.arange(5000, dtype=np.uint32) % 977
    data = range_coder.write_file([(1, 5000)], ids, block=1000)
    _, lengths, _, payloads = range_coder.parse_file(data)
    assert np.array_equal(range_coder.decode_blocks([payloads[3]], lengths[3:4]), ids[3000:4000])
    broken = bytearray(data)
    broken[-20] ^= 255
    with pytest.raises(ValueError):
        range_coder.read_file(bytes(broken))


def test_shares_of_all_blocks_at_once():
    """Shares used to be looked up row by row; the files' bytes are as they were."""
    rng = np.random.default_rng(7)
    model = range_coder._Model(5)
    model.weight += rng.integers(0, 5000, model.weight.shape).astype(np.int32)
    model._refresh(5)
    model.predict(4)
    wanted = [3, 0, range_coder._RANGES - 1, 17]
    start, share = model.share(np.array(wanted))
    for i, k in enumerate(wanted):
        below, unit, begin = model.below[:, i].astype(int).tolist(), int(model.unit[i]), int(model.begin[i])
        assert 0 <= below[k] < below[k + 1] <= 1 << 14 and below[-1] == 1 << 14
        assert int(start[i]) == begin + unit * below[k]
        assert int(share[i]) == unit * (below[k + 1] - below[k]) >> int(range_coder._BITS[k])
    ids = np.concatenate([np.arange(700) % 90, rng.integers(0, 49000, 900), np.full(500, 7)]).astype(np.uint32)
    data = range_coder.write_file([(1, len(ids))], ids, block=900)
    assert hashlib.sha256(data).hexdigest() == "c9227f5e1128bc0798dcb80df810699063fe41ce25063ff4a3144199c1fb545b"
    assert np.array_equal(range_coder.read_file(data)[1], ids)


def brute_ids(docs):
    library = Tokenizer.from_file(WORD)
    out, at = [], 0
    for key, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_id_files_whole_table(spark):
    got = sorted(map(tuple, range_coder.op5_token_files(spark, SF).collect()))
    assert got == brute_ids(sorted(documents(spark)))


def test_id_files_edges(spark, tmp_path):
    docs = sorted((d for d in edge_rows() if d[0] is not None), key=lambda d: d[0])
    range_coder.write_ids(frame(spark, random.Random(1).sample(docs, len(docs))), str(tmp_path / "ids"), WORD,
                          file_ids=500, shard_bytes=9000)
    got = sorted(map(tuple, range_coder.read_ids(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    assert got == brute_ids(docs)


def test_id_files_do_not_depend_on_what_is_encoded_together(spark, tmp_path):
    docs = [(i, t) for i, (_, t) in enumerate(edge_rows() + documents(spark)[:40])]
    files = []
    for n in (1, 3000, 1 << 20):
        range_coder.write_ids(frame(spark, docs), str(tmp_path / f"{n}"), WORD, file_ids=500, shard_bytes=9000, together=n)
        got = sorted(map(tuple, range_coder.read_ids(spark, str(tmp_path / f"{n}")).collect()), key=lambda r: r[1])
        assert got == brute_ids(docs)
        files.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{n}/manifest")).drop("temp").collect())))
    assert files[0] == files[1] == files[2]


def test_id_files_null_ids_come_first(spark, tmp_path):
    range_coder.write_ids(frame(spark, [(1, "b"), (None, "a")]), str(tmp_path / "ids"), WORD)
    assert [r.doc_id for r in range_coder.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()] == [None, 1]


def test_id_files_empty(spark, tmp_path):
    range_coder.write_ids(frame(spark, []), str(tmp_path / "ids"), WORD)
    assert range_coder.read_ids(spark, str(tmp_path / "ids")).collect() == []


# sentencepiece

@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.piece_path())


@pytest.fixture(scope="module")
def unigram():
    """The library on the same pieces and scores, told to find the best path."""
    raw = open(pieces.piece_path(), "rb").read()
    return sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x12\x02\x18\x01")


def brute_score(model, library, text):
    """Best total score by trying every piece at every position."""
    table = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size())
             if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))}
    longest = max(map(len, table))
    best = [0.0]
    for end in range(1, len(text) + 1):
        best.append(max([best[end - 1] + model.unknown] + [best[a] + table[text[a:end]] for a in range(max(0, end - longest), end)
                                                           if text[a:end] in table]))
    return best[-1], table


def test_pieces_have_the_best_score(spark, model, unigram):
    texts = [t[:300] for _, t in documents(spark)[:25]] + [t for _, t in edge_rows() if t and len(t) < 100]
    for t in texts:
        form = (" " + t).replace(" ", "▁")
        best, table = brute_score(model, unigram, form)
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        got, run = 0.0, 0
        for i in ids:
            if unigram.is_byte(i):
                run += 1
            else:
                got += table[unigram.id_to_piece(i)]
        data = bytes(int(unigram.id_to_piece(i)[3:5], 16) for i in ids if unigram.is_byte(i))
        assert len(data) == run
        got += model.unknown * len(data.decode())
        assert got == pytest.approx(best)


def test_short_texts_equal_the_library(model, unigram):
    rng = random.Random(2)
    for _ in range(500):
        t = "".join(rng.choice("abcdet hosn,.\n12é") for _ in range(rng.randrange(1, 12)))
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        want = unigram.encode(t)
        assert sum(map(unigram.get_score, ids)) == pytest.approx(sum(map(unigram.get_score, want)), rel=1e-6)
        assert unigram.decode(ids) == model.decode(model.encode(t))


def test_pieces_round_trip(spark):
    rows = [(i, t) for i, t in edge_rows()]
    out = pieces.decode(pieces.encode(frame(spark, rows), pieces.piece_path()), pieces.piece_path()).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t or "") for i, t in rows)


def test_pieces_whole_table(spark, model):
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in pieces.op2_sentencepiece(spark, SF).collect()}
    assert got == {i: (len(model.encode(t)) // 4, zlib.crc32(model.encode(t))) for i, t in documents(spark)}


def test_pieces_empty(spark):
    assert pieces.encode(frame(spark, []), pieces.piece_path()).collect() == []


def test_tokenizer_files_are_parameters():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE
