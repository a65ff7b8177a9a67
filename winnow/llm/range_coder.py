"""Token-id files: an adaptive context-mixing range coder.

Model. An id is predicted from three orders at once. Order 2 (the two ids
before) and order 1 (the id before) each remember, by hashed context, the id
that followed and how often it was right lately. Order 0 is an adaptive
distribution over 64 ranges of ids (by bit length and the next two bits), even
inside a range. The weights of the mixture adapt: the chance that order 2 is
right, given its confidence and whether order 1 agrees, then that order 1 is
right, given its own; order 0 has the rest. One id is one step of the range
coder (64-bit state, 16-bit words, no carries).

Blocks. Ids are coded in blocks of ``BLOCK`` ids. Every block starts from the same
fresh model and has its own length and CRC-32, so blocks are decoded, checked
and lost independently - and all blocks of a file are coded side by side: step t
codes the t-th id of every block with array operations.

Files. Documents are range-partitioned by id (splitters from the ids and text
hashes), sorted, encoded by the public tokenizer and written as files of up to
``FILE_IDS`` ids:

    magic | u32 index length | u32 blocks | index (zlib) | per block: u32 ids,
    u32 bytes, u32 crc32 of the ids | payloads

The index holds document ids and lengths. Files are written under attempt names
and renamed after the manifest of the finished tasks is stored; readers open only
what the manifest lists.

Defined results: NULL text counts as empty (the end id alone); NULL document ids
sort first and are kept; repeated rows are separate documents, in order of
their text's hash; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import prepare, read
from winnow.llm.token_ids import word_encoder
from winnow.llm.warc import _filesystem
from winnow.operators.index import bucketed, group_prefix_sum
from winnow.session import scratch_path, shuffle_width

MAGIC = b"IDCM0001"
BLOCK = 2048
FILE_IDS = 8 << 20
#: Text bytes that go to one shard.
SHARD_BYTES = 16 << 20
CONTEXT_BITS = 11
REFRESH = 32
#: Characters of text that are encoded together.
TOGETHER = 8 << 20
END_ID = 2
MAX_ID = (1 << 20) - 1
_TOTAL_BITS = 40
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 44)
_U = np.uint64


def _ranges() -> tuple[np.ndarray, np.ndarray]:
    """First id and width (bits) of each order-0 range, ascending."""
    first, bits, at = [], [], 0
    while at <= MAX_ID:
        width = max(0, at.bit_length() - 3)
        first.append(at)
        bits.append(width)
        at += 1 << width
    return np.array(first, np.uint64), np.array(bits, np.uint64)


_FIRST, _BITS = _ranges()
_RANGES = len(_FIRST)
#: The last id of each range, counted from its first.
_LAST = (np.uint64(1) << _BITS) - np.uint64(1)
#: The range of small ids, looked up.
_RANGE_OF = np.searchsorted(_FIRST, np.arange(1 << 16, dtype=np.uint64), side="right") - 1


#: Weights of order 0 are scaled to this sum.
_SCALE_BITS = 14
_K = tuple(np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


_THREE, _ALL = np.uint32(3), np.uint64(1 << _TOTAL_BITS)
#: Change of an entry by its confidence, wrong then right (modulo 2**32).
_MOVES = np.array([-((k + 1) >> 1) for k in range(8)] + [k < 7 for k in range(8)], np.int64).astype(np.uint32)


class _Model:
    """The models of many blocks. Tables are flat, one stretch a block."""

    def __init__(self, rows: int):
        # Entry: id * 8 + confidence.
        self.after = np.zeros(2 * rows << CONTEXT_BITS, np.uint32)
        # Chances: a block's 16 of order 2 (8 more where order 1 agrees), then all of order 1.
        self.right = np.full(rows * 24, 1 << 14, np.int64)
        self.right[rows * 16:] = 1 << 13
        block = np.arange(rows, dtype=np.int64)
        # Order 2, then order 1.
        self.base = np.stack((block, block + rows)) << CONTEXT_BITS
        self.chance = np.stack((block * 16, block * 8 + rows * 16))
        self.block = block
        # Weights of the ranges, and below[j], the share before range j: the
        # latter follows every REFRESH steps.
        self.weight = np.full((_RANGES, rows), 2, np.int32)
        self.below = np.zeros((_RANGES + 1, rows), np.int16)
        self.weights, self.belows = self.weight.reshape(-1), self.below.reshape(-1)
        self._refresh(rows)
        self.step = 0
        self.last = np.zeros((2, rows), np.uint32)

    def _refresh(self, n: int):
        total = np.cumsum(self.weight[:, :n], axis=0, dtype=np.int32)
        scale = np.float32((1 << _SCALE_BITS) - _RANGES) / total[-1].astype(np.float32)
        # One for each range, so that none is empty.
        self.below[1:, :n] = (total * scale).astype(np.int16) + np.arange(1, _RANGES + 1, dtype=np.int16)[:, None]
        self.below[-1, :n] = 1 << _SCALE_BITS
        full = np.flatnonzero(total[-1] > (1 << 14))
        if len(full):
            self.weight[:, full] -= self.weight[:, full] >> 1

    def _places(self, one: np.ndarray, two: np.ndarray, out: np.ndarray):
        """Where both orders keep what followed ``one``, and ``two`` before it."""
        shift = np.uint32(32 - CONTEXT_BITS)
        context = one * _K[1]
        context += two * _K[2]
        context >>= shift
        np.add(context, self.base[0, :one.shape[-1]], out=out[..., 0, :])
        np.multiply(one, _K[0], out=context)
        context >>= shift
        np.add(context, self.base[1, :one.shape[-1]], out=out[..., 1, :])
        return out

    def predict(self, n: int, at: np.ndarray | None = None):
        """Predictions and interval bounds of the first n blocks' next id."""
        if at is None:
            at = self._places(self.last[0, :n], self.last[1, :n], np.empty((2, n), np.int64))
        self.at = at
        self.entry = self.after.take(at)
        self.known = self.entry >> _THREE
        self.id2, self.id1 = self.known
        self.sure = self.entry.astype(np.uint8)
        self.sure &= np.uint8(7)
        self.c = self.chance[:, :n] + self.sure
        self.c[0] += (self.id1 == self.id2).view(np.uint8) << np.uint8(3)
        self.p = self.right.take(self.c)
        p2, p1 = self.p.view(np.uint64)
        # Shares of 2**40: order 2, then order 1 of what is left, then order 0.
        self.end2 = p2 << _U(_TOTAL_BITS - 16)
        self.mid = _ALL - self.end2
        self.mid >>= _U(16)
        self.mid *= p1
        # Where order 0 begins and what one share of it is worth.
        self.begin = self.end2 + self.mid
        self.unit = _ALL - self.begin
        self.unit >>= _U(_SCALE_BITS)

    def shares(self, range0: np.ndarray):
        """Place of each range's weight, shares before it and its own. Blocks run along the last axis."""
        rows = len(self.block)
        at0 = range0 * rows
        at0 += self.block[:range0.shape[-1]]
        a = self.belows.take(at0)
        at0 += rows
        size = self.belows.take(at0)
        size -= a
        at0 -= rows
        return at0, a.astype(np.uint64), size.astype(np.uint64)

    def share(self, range0: np.ndarray):
        """Where order 0's range begins, and the share of one id of it."""
        self.at0, a, size = self.shares(range0)
        a *= self.unit
        a += self.begin
        size *= self.unit
        size >>= _BITS.take(range0)
        return a, size

    def update(self, ids: np.ndarray, hit2: np.ndarray, right: np.ndarray):
        """``right``: which of both orders' ids came. Weights follow with ``missed``."""
        # Chances move a sixteenth of the way to 65000 or 256, never outside; order 1's only where order 2 missed.
        move = right * np.int64(64744)
        move -= self.p
        move += np.int64(256)
        move >>= np.int64(4)
        move[1] *= ~hit2
        move += self.p
        self.right[self.c] = move
        # Right: surer. Wrong: half as sure; where that was little, the new id takes the place.
        case = right.view(np.uint8) << np.uint8(3)
        case |= self.sure
        self.after[self.at] = np.where(case <= np.uint8(1), ids << _THREE, self.entry + _MOVES.take(case))

    def missed(self, at0: np.ndarray, steps: int, n: int):
        """Steps end: order 0's ids had their weights at ``at0``. Shares follow every REFRESH steps."""
        self.weights += np.bincount(at0, minlength=len(self.weights)).astype(np.int32) * np.int32(24)
        self.step += steps
        if self.step % REFRESH == 0 or self.step <= 4:
            self._refresh(n)


def _spans(size: np.ndarray):
    """(first step, end, blocks) of stretches without a refresh or a block's end inside."""
    longest = int(size.max(initial=0))
    edges = np.unique(np.concatenate((size, np.arange(min(5, longest)), np.arange(0, longest, REFRESH))))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield a, b, int(np.searchsorted(-size, -a, side="left"))


def _due(low, span):
    """Which states shift a word out; states too narrow to go on are cut."""
    due = (low ^ (low + span)) < _TOP
    narrow = span < _BOT
    if narrow.any():
        narrow &= ~due
        span[narrow] = (_U(0) - low[narrow]) & (_BOT - _U(1))
        due |= narrow
    return due


def _shift(low, span, start, width, move):
    """Narrow the states to the interval and shift out what is settled, in
    place; ``move(which, due, bits)`` moves words: of all states (None) or some."""
    step = span >> _U(_TOTAL_BITS)
    start *= step
    low += start
    np.multiply(width, step, out=span)
    due = low + span
    due ^= low
    due = due < _TOP
    shift = due.astype(np.uint64)
    shift <<= _U(4)
    move(None, due, shift)
    low <<= shift
    span <<= shift
    # Only these may be due again, or be too narrow.
    which = np.flatnonzero(span < _TOP)
    if not len(which):
        return
    l, s = low.take(which), span.take(which)
    due = _due(l, s)
    while due.any():
        keep = np.flatnonzero(due)
        which, l, s = which.take(keep), l.take(keep), s.take(keep)
        low[which] = l
        move(which, None, _U(16))
        l <<= _U(16)
        s <<= _U(16)
        low[which], span[which] = l, s
        due = _due(l, s)


def encode_blocks(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Payload of each block; ``ids`` holds the blocks one after the other."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    rows = len(size)
    model = _Model(rows)
    lows, spans = np.zeros(rows, np.uint64), np.full(rows, (1 << 64) - 1, np.uint64)
    out = np.zeros((rows, 3 * int(size.max(initial=0)) + 8), np.uint16)
    words, begins = out.reshape(-1), np.arange(rows, dtype=np.int64) * out.shape[1]
    # Where each block's next word goes.
    at = begins.copy()

    def move(which, due, bits):
        if which is None:
            # Written for all; the place moves on where a word is due.
            words[at[:len(due)]] = low >> _U(48)
            at[:len(due)] += due
        else:
            words[at.take(which)] = low.take(which) >> _U(48)
            at[which] += 1

    small = not len(ids) or int(ids.max()) < len(_RANGE_OF)
    for a, b, n in _spans(size):
        # What needs no state is made for all steps up to the next refresh at once.
        syms = ids.take(first[:n] + np.arange(a, b)[:, None])
        told = np.concatenate((model.last[::-1, :n], syms))
        places = model._places(told[1:-1], told[:-2], np.empty((b - a, 2, n), np.int64))
        model.last[:, :n] = told[:-3:-1]
        ranges = _RANGE_OF.take(syms) if small else np.searchsorted(_FIRST, syms, side="right") - 1
        at0, before, share = model.shares(ranges)
        bits, inside = _BITS.take(ranges), syms - _FIRST.take(ranges)
        known = np.empty((b - a, n), bool)
        low, span = lows[:n], spans[:n]
        for t, sym in enumerate(syms):
            model.predict(n, places[t])
            right = model.known == sym
            hit2, hit1 = right[0], right[1] > right[0]
            np.logical_or(hit2, hit1, out=known[t])
            width = model.unit * share[t]
            width >>= bits[t]
            start = inside[t]
            start *= width
            model.unit *= before[t]
            start += model.unit
            start += model.begin
            start = np.where(hit1, model.end2, start)
            start *= ~hit2
            width = np.where(hit2, model.end2, np.where(hit1, model.mid, width))
            _shift(low, span, start, width, move)
            model.update(sym, hit2, right)
        model.missed(at0[~known], b - a, n)
    for shift in (48, 32, 16, 0):
        words[at] = ((lows >> _U(shift)) & _U(0xFFFF)).astype(np.uint16)
        at += 1
    payload = [b""] * rows
    used = at - begins
    for i, k in enumerate(order.tolist()):
        payload[k] = out[i, :used[i]].tobytes()
    return payload


def decode_blocks(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids of all blocks, one block after the other."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    rows = len(size)
    table = np.zeros((rows, max((len(p) for p in payloads), default=0) // 2 + 4), np.uint16)
    for i, at in enumerate(order.tolist()):
        table[i, :len(payloads[at]) // 2] = np.frombuffer(payloads[at], np.uint16)
    words, begins = table.reshape(-1), np.arange(rows, dtype=np.int64) * table.shape[1]
    model = _Model(rows)
    lows, spans = np.zeros(rows, np.uint64), np.full(rows, (1 << 64) - 1, np.uint64)
    codes = np.zeros(rows, np.uint64)
    for i in range(4):
        codes = codes << _U(16) | table[:, i]
    # Where each block's next word comes from; a damaged block may read on.
    at = begins + 4

    def move(which, due, bits):
        if which is None:
            n = len(due)
            code = codes[:n]
            code <<= bits
            code |= words.take(at[:n], mode="clip") * due
            at[:n] += due
        else:
            codes[which] = codes.take(which) << bits | words.take(at.take(which), mode="clip")
            at[which] += 1

    ids = np.zeros(int(lengths.sum()), np.uint32)
    for a, b, n in _spans(size):
        low, span, code = lows[:n], spans[:n], codes[:n]
        syms, places = np.empty((b - a, n), np.uint32), np.empty((b - a, n), np.int64)
        known = np.empty((b - a, n), bool)
        for t in range(b - a):
            model.predict(n)
            place = code - low
            place //= span >> _U(_TOTAL_BITS)
            hit2 = place < model.end2
            hit = np.less(place, model.begin, out=known[t])
            hit1 = hit > hit2
            # What order 0 says counts where the others missed.
            place -= model.begin
            place *= ~hit
            part = np.minimum(place // model.unit, _U((1 << _SCALE_BITS) - 1)).astype(np.int16)
            range0 = np.add.reduce((model.below[1:, :n] <= part).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
            start, width = model.share(range0)
            places[t] = model.at0
            inside = place - (start - model.begin)
            inside //= np.maximum(width, _U(1))
            np.minimum(inside, _LAST.take(range0), out=inside)
            sym = (_FIRST.take(range0) + inside).astype(np.uint32)
            sym = syms[t] = np.where(hit2, model.id2, np.where(hit1, model.id1, sym))
            inside *= width
            start += inside
            start = np.where(hit1, model.end2, start)
            start *= ~hit2
            width = np.where(hit2, model.end2, np.where(hit1, model.mid, width))
            _shift(low, span, start, width, move)
            model.update(sym, hit2, model.known == sym)
            model.last[1, :n] = model.last[0, :n]
            model.last[0, :n] = sym
        model.missed(places[~known], b - a, n)
        ids[first[:n] + np.arange(a, b)[:, None]] = syms
    return ids


def write_file(docs: list[tuple[int | None, int]], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file's bytes: ``docs`` are (id, number of ids) in order."""
    if len(ids) and int(ids.max()) > MAX_ID:
        raise ValueError("id beyond the format's range")
    lengths = np.full(-(-len(ids) // block), block, np.int64)
    if len(ids) % block:
        lengths[-1] = len(ids) % block
    ids = np.ascontiguousarray(ids, "<u4")
    payloads = encode_blocks(ids, lengths)
    keys = np.array([0 if k is None else k for k, _ in docs], "<i8").tobytes()
    index = zlib.compress(keys + np.array([n for _, n in docs], "<u8").tobytes() + bytes(k is None for k, _ in docs))
    parts = [MAGIC, struct.pack("<III", len(index), len(lengths), len(docs)), index]
    at = 0
    for n, p in zip(lengths.tolist(), payloads):
        parts.append(struct.pack("<III", n, len(p), zlib.crc32(ids[at:at + n])))
        at += n
    return b"".join(parts + payloads)


def parse_file(data: bytes):
    """(docs, block lengths, checksums, payloads) of a file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not an id file")
    index_size, blocks, n = struct.unpack_from("<III", data, 8)
    index = zlib.decompress(data[20:20 + index_size])
    keys, sizes = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, 8 * n)
    null = np.frombuffer(index, np.uint8, n, 16 * n)
    docs = [(None if z else k, s) for k, s, z in zip(keys.tolist(), sizes.tolist(), null.tolist())]
    head = np.frombuffer(data, "<u4", 3 * blocks, 20 + index_size).reshape(-1, 3)
    at, payloads = 20 + index_size + 12 * blocks, []
    for size in head[:, 1].tolist():
        payloads.append(data[at:at + size])
        at += size
    return docs, head[:, 0].astype(np.int64), head[:, 2], payloads


def read_file(data: bytes):
    """(docs, ids) of a file; a damaged block raises ValueError."""
    docs, lengths, sums, payloads = parse_file(data)
    ids = decode_blocks(payloads, lengths).astype("<u4")
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
        if zlib.crc32(ids[a:b]) != int(sums[i]):
            raise ValueError(f"block {i} is damaged")
    return docs, ids


_FILES = "temp string, shard int, part int, bytes long, ids long, sha256 string"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, file_ids: int = FILE_IDS, shard_bytes: int = SHARD_BYTES,
              together: int = TOGETHER) -> DataFrame:
    """Write the ids of all documents below ``folder``; returns the manifest."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-volume // shard_bytes))
    cut = bucketed(rows, ["id", "hash"], shards).withColumnRenamed("__bucket", "shard")
    ordered = (cut.repartition(shards, "shard")
               .sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "hash").select("shard", "id", "text"))
    end = int(end_id).to_bytes(4, "little")

    def write(batches):
        from pyspark import TaskContext
        filesystem, root = _filesystem(folder)
        enc = word_encoder(tokenizer)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        filesystem.create_dir(f"{root}/temporary", recursive=True)
        done, held, index, total, now, part = [], [], [], 0, None, 0
        keys, texts, size = [], [], 0

        def close():
            nonlocal held
            ids, held = np.frombuffer(b"".join(held), "<u4"), []
            data = write_file(index, ids)
            temp = f"temporary/{now:05d}-{part:05d}-{attempt}"
            with filesystem.open_output_stream(f"{root}/{temp}", compression=None) as f:
                f.write(data)
            done.append((temp, now, part, len(data), total, hashlib.sha256(data).hexdigest()))

        def encode():
            nonlocal keys, texts, size, index, total, part
            for key, ids in zip(keys, enc.many(texts)):
                if held and total >= file_ids:
                    close()
                    part, index, total = part + 1, [], 0
                held.append(ids + end)
                index.append((key, len(held[-1]) // 4))
                total += index[-1][1]
            keys, texts, size = [], [], 0
        for batch in batches:
            for shard, key, body in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != now or size >= together:
                    encode()
                if shard != now:
                    if held:
                        close()
                    now, part, index, total = shard, 0, [], 0
                keys.append(key)
                texts.append(body)
                size += len(body)
        encode()
        if held:
            close()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*done)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["temp", "shard", "part", "bytes", "ids", "sha256"])

    written = f"{folder}/manifest-temporary"
    ordered.mapInArrow(write, _FILES).write.parquet(written)

    def rename(batches):
        from pyarrow import fs
        filesystem, root = _filesystem(folder)
        for batch in batches:
            names = []
            for temp, shard, part in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                name = f"ids-{shard:05d}-{part:05d}.bin"
                # A repeated attempt finds the file where the first one put it.
                if filesystem.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:
                    filesystem.move(f"{root}/{temp}", f"{root}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns[1:]],
                                             ["file", "shard", "part", "bytes", "ids", "sha256"])

    named = spark.read.schema(_FILES).parquet(written).repartition(shuffle_width(spark), "temp")
    named.mapInArrow(rename, "file string, shard int, part int, bytes long, ids long, sha256 string") \
        .write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files the manifest lists."""
    prepare(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    placed = group_prefix_sum(manifest, [], ["shard", "part"], "ids", "start")

    def load(batches):
        filesystem, root = _filesystem(folder)
        for batch in batches:
            for name, size, digest, start in zip(*[c.to_pylist() for c in batch.columns]):
                with filesystem.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                if len(data) != size or hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError("file differs from the manifest: " + name)
                docs, ids = read_file(data)
                out, at = [], 0
                for key, n in docs:
                    out.append((key, start + at, n, zlib.crc32(ids[at:at + n])))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (placed.select("file", "bytes", "sha256", "start").repartition(shuffle_width(spark), "file")
            .mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    write_ids(read(spark, sf_dir, "documents"), folder, word_bpe_path())
    return read_ids(spark, folder)
