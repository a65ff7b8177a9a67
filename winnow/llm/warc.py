"""WARC archives: deterministic sharded writer and reader.

Writer. Pages are range-partitioned by id with splitters that depend on the ids
alone, as many as the payloads' bytes ask for (``SHARD_BYTES`` each), and sorted
inside each range; every range is written by one task as files
of gzip members (one record each), rolled when the compressed size passes
``roll_bytes``. Headers, record ids and digests are regenerated from the rows, so
the same table gives the same bytes whatever its layout. A task writes to names
with its own attempt in them; its rows of the manifest come back only when it
ends, so files of lost or repeated attempts are in no manifest. The manifest is
written by Spark's committer; a second step renames the files it names to their
final names (safe to repeat), and the final manifest is the commit: readers open
only what it lists.

Deduplication. Of records with equal payloads of at least ``min_bytes`` bytes the
one with the largest id is a response, the others revisit it. Equality is that of
SHA-1, SHA-256 and size together; only these are shuffled, and the largest id of a
payload is found by a partially combined aggregate, so one payload may be a third
of all pages.

Reader. Files named by the manifest are dealt to tasks, which check each file's
size and digest, then each record's block and payload digest.

Files are opened through ``pyarrow.fs`` from the folder's URI.

Defined results: NULL html is an empty payload; NULL url an empty target; a NULL
id sorts first and is never referred to while another id has the payload;
repeated rows are separate records (of rows repeating the largest id all but one
revisit it); an empty table gives an archive without files; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.common import prepare, read
from winnow.operators.index import bucketed
from winnow.session import scratch_path

ROLL_BYTES = 8 << 20
MIN_BYTES = 1000
#: Payload bytes of a shard, written by one task.
SHARD_BYTES = 32 << 20
SLICE = 16 << 10
#: The date of every record: archives of one table are equal byte for byte.
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "temp string, shard int, part int, bytes long, records long, sha256 string"


def _filesystem(folder: str):
    from pyarrow import fs
    if "://" not in folder:
        folder = folder.removeprefix("file:")
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{copy}')}>"


def build_record(page_id, copy: int, url: str, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit has no payload; its size is a header."""
    digest = "sha1:" + base64.b32encode(sha1).decode()
    block = _HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}",
            "WARC-Target-URI: " + "".join(c for c in url if c >= " "),
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}",
            f"WARC-Block-Digest: {_b32(block)}", f"Page-Id: {'' if page_id is None else page_id}",
            f"Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}",
                 f"Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes):
    """The content of each gzip member. Members are read in slices, so what is left
    of the file behind a member is not copied with it."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at:at + SLICE]
            if not piece:
                raise ValueError("truncated member")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parse_records(data: bytes):
    """(headers, block) of each record; damage raises ValueError."""
    for raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = rest[:int(fields["Content-Length"])]
        if _b32(block) != fields["WARC-Block-Digest"] or rest[len(block):] != b"\r\n\r\n":
            raise ValueError("block digest differs: " + fields["WARC-Record-ID"])
        yield fields, block


def payload_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    data = F.encode(html, "utf-8")
    return pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        html.alias("html"), F.octet_length(html).alias("size"), F.sha1(data).alias("sha1"),
                        F.sha2(data, 256).alias("sha2"))


def with_last(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``rows`` and ``last``, the largest id of those with an equal payload; NULL
    where the payload is small or occurs once. Only digests are grouped, summed
    up in every task first."""
    key = ["size", "sha1", "sha2"]
    groups = (rows.where(F.col("size") >= min_bytes).groupBy(*key)
              .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where("n > 1").drop("n"))
    return rows.join(groups, key, "left")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = MIN_BYTES, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write ``pages`` below ``folder`` (shared by all executors); returns the
    manifest (file, bytes, records, sha256), also stored as ``folder``/manifest."""
    spark = pages.sparkSession
    prepare(spark)
    payloads = payload_rows(pages, id_col, url_col, html_col)
    if shards is None:
        total = payloads.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
        shards = 1 + total // SHARD_BYTES
    cut = bucketed(payloads, ["id", "sha1"], shards)
    rows = cut.withColumnRenamed("__bucket", "shard")
    # Payloads are shuffled once, by shard. What the digests have decided - one
    # narrow row for each page whose payload occurs twice - travels beside them.
    key = ["shard", "id", "sha1", "sha2", "size"]
    decided = with_last(rows.select(*key), min_bytes).where(F.col("last").isNotNull())
    both = rows.select(*key, "url", "html", F.lit(None).cast("long").alias("last"), F.lit(True).alias("page")).unionByName(
        decided.select(*key, "last", F.lit(False).alias("page")), allowMissingColumns=True)
    # Rows that repeat one id and payload are neighbours: a number tells them apart.
    copies = Window.partitionBy(*key).orderBy(F.col("page").desc(), "url")
    whole = copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Shard n is partition n: a hash of few numbers would put several into one task.
    numbered = (both.repartitionById(shards, "shard")
                .select(*key, (F.row_number().over(copies) - 1).alias("copy"), "url", "html",
                        F.max("last").over(whole).alias("last"), "page").where("page"))
    kept = F.col("last").isNull() | (F.col("last").eqNullSafe(F.col("id")) & (F.col("copy") == 0))
    ordered = numbered.select("shard", "id", "copy", "url", "html", "sha1", "last", (~kept).alias("revisit"))

    def write(batches):
        from pyspark import TaskContext
        # Rows come sorted by shard, id and payload: the window left them so.
        filesystem, root = _filesystem(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        filesystem.create_dir(f"{root}/temporary", recursive=True)
        done, out, now, part = [], None, None, 0
        size = count = 0
        digest = hashlib.sha256()

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"temporary/{now:05d}-{part:05d}-{attempt}", now, part, size, count, digest.hexdigest()))
                out = None
        for batch in batches:
            for shard, key, copy, url, html, sha1, last, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                if out is not None and (shard != now or size >= roll_bytes):
                    close()
                    part = part + 1 if shard == now else 0
                if out is None:
                    now, size, count, digest = shard, 0, 0, hashlib.sha256()
                    out = filesystem.open_output_stream(f"{root}/temporary/{now:05d}-{part:05d}-{attempt}", compression=None)
                data = member(build_record(key, copy, url, html.encode(), bytes.fromhex(sha1), last, revisit))
                out.write(data)
                digest.update(data)
                size, count = size + len(data), count + 1
        close()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*done)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["temp", "shard", "part", "bytes", "records", "sha256"])

    written = f"{folder}/manifest-temporary"
    ordered.mapInArrow(write, _FILES).write.parquet(written)

    def rename(batches):
        from pyarrow import fs
        filesystem, root = _filesystem(folder)
        for batch in batches:
            names = []
            for temp, shard, part in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                name = f"pages-{shard:05d}-{part:05d}.warc.gz"
                # A repeated attempt finds the file where the first one put it.
                if filesystem.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:
                    filesystem.move(f"{root}/{temp}", f"{root}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns[3:]],
                                             ["file", "bytes", "records", "sha256"])

    named = spark.read.schema(_FILES).parquet(written).repartition(shards, "temp")
    named.mapInArrow(rename, "file string, bytes long, records long, sha256 string").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), one
    row per record of the files the manifest lists."""
    prepare(spark)
    files = spark.read.schema("file string, bytes long, records long, sha256 string").parquet(f"{folder}/manifest")

    def load(batches):
        filesystem, root = _filesystem(folder)
        for batch in batches:
            for name, size, records, digest in zip(*[c.to_pylist() for c in batch.columns]):
                with filesystem.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                if len(data) != size or hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError("file differs from the manifest: " + name)
                rows = [_row(*x) for x in parse_records(data)]
                if len(rows) != records:
                    raise ValueError("records missing: " + name)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.repartition(max(1, files.count()), "file").mapInArrow(
        load, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _row(fields: dict, block: bytes):
    kind, number = fields["WARC-Type"], lambda x: int(x) if x else None
    size = int(fields["Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or _b32(payload) != fields["WARC-Payload-Digest"]:
            raise ValueError("payload digest differs: " + fields["WARC-Record-ID"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    refers = number(fields["Refers-To-Page-Id"]) if kind == "revisit" else None
    return number(fields["Page-Id"]), fields["WARC-Target-URI"], size, digest, kind, refers


def op6_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).drop("url")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
r AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""
