"""WARC writer and reader: round trip, determinism, recovery, damage."""

import gzip
import hashlib
import os
import random
from collections import Counter

import pytest

from winnow.llm import warc
from winnow.plans.oracle import compare, duckdb_connection

SCHEMA = "page_id long, url string, html string, id int, sha1 string, shard string, last int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "y", 2) for i, u, h in rows], SCHEMA)


def edge_rows():
    big = "<p>" + "é" * 700
    return [(1, "http://a/", big), (2, None, big), (5, "http://b/", big), (3, "http://c/", "small"), (4, "", "small"),
            (6, "http://d/\r\nX: y", None), (7, "http://e/", ""), (8, "http://f/", "x" * 300_000), (9, "u", "y" * 1000),
            (10, "u", "y" * 1000), (11, "u", "y" * 999), (12, "u", "y" * 999), (None, "n", big)]


def test_pages_oracle(spark):
    assert compare(warc.op6_warc(spark, "/root/testdata/sf0.001"), duckdb_connection("/root/testdata/sf0.001"), warc.SQL)[:2] == (True, True)


@pytest.mark.parametrize("shards", [1, 5])
def test_edges(spark, tmp_path, shards):
    rows = edge_rows()
    warc.write_archive(frame(spark, rows), str(tmp_path / "w"), roll_bytes=600, shards=shards)
    got = {r.page_id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest()
        last = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None))
        revisit = len(data) >= 1000 and i != last
        assert (got[i].record_type, got[i].refers_to) == (("revisit", last) if revisit else ("response", None))


def test_same_bytes_whatever_the_layout(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}" + "z" * (i * 37 % 3000)) for i in range(400)]
    digests = []
    for n, order in (("a", rows), ("b", rows[::-1])):
        folder = str(tmp_path / n)
        m = warc.write_archive(frame(spark, order).repartition(1 + len(digests) * 6), folder, roll_bytes=20_000, shards=4)
        listed = {r.file: r.sha256 for r in m.collect()}
        assert {f: hashlib.sha256((tmp_path / n / f).read_bytes()).hexdigest() for f in listed} == listed
        digests.append(listed)
    assert digests[0] == digests[1] and len(digests[0]) > 4


def test_files_are_rolled_and_readable_by_gzip(spark, tmp_path):
    rows = [(i, "u", os.urandom(1500).hex()) for i in range(60)]
    m = warc.write_archive(frame(spark, rows), str(tmp_path / "w"), roll_bytes=10_000, shards=2).collect()
    assert sum(r.records for r in m) == 60 and all(r.bytes < 10_000 + 3000 for r in m)
    text = gzip.decompress((tmp_path / "w" / m[0].file).read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_leftovers_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = tmp_path / "w"
    warc.write_archive(frame(spark, edge_rows()), str(folder), shards=2)
    (folder / "temporary").mkdir(exist_ok=True)
    (folder / "temporary" / "00000-00000-lost").write_bytes(b"half a file")
    (folder / "pages-99999-00000.warc.gz").write_bytes(b"not listed")
    assert warc.read_archive(spark, str(folder)).count() == len(edge_rows())


def test_damage_is_found(spark, tmp_path):
    folder = tmp_path / "w"
    name = warc.write_archive(frame(spark, edge_rows()), str(folder), shards=1).collect()[0].file
    data = bytearray((folder / name).read_bytes())
    data[len(data) // 2] ^= 1
    (folder / name).write_bytes(bytes(data))
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_archive(spark, str(folder)).collect()


def test_repeated_rows(spark, tmp_path):
    rows = [(7, "u", "q" * 2000)] * 3 + [(6, "u", "q" * 2000)]
    warc.write_archive(frame(spark, rows), str(tmp_path / "w"))
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "w")).collect())
    assert got == {(7, "response", None): 1, (7, "revisit", 7): 2, (6, "revisit", 7): 1}


def test_empty(spark, tmp_path):
    warc.write_archive(frame(spark, []), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).collect() == []


def test_reading_a_file_is_linear_in_its_size():
    import time
    one = warc.member(warc.build_record(1, 0, "u", b"x" * 200, b"0" * 20, None, False))

    def seconds(n):
        data, best = one * n, 9.0
        for _ in range(3):
            t = time.process_time()
            assert sum(1 for _ in warc.members(data)) == n
            best = min(best, time.process_time() - t)
        return best
    assert seconds(16_000) < 16 * seconds(2_000)


def test_members_over_slices():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 40_000, 16_384, 5)]
    assert list(warc.members(b"".join(map(warc.member, parts)))) == parts
    with pytest.raises(ValueError, match="truncated"):
        list(warc.members(warc.member(b"abc" * 50)[:-3]))
