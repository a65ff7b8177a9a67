"""Exact substring deduplication by a partitioned suffix sort.

A byte goes when some string of ``length`` bytes that covers it also starts
anywhere else. All such strings are decided by sorting suffixes; what is done
before only keeps suffixes that cannot repeat away from the sort:

1. Anchors. The window starting at s (``length`` bytes) has one anchor: the
   position inside it whose 16-byte gram has the least hash, leftmost on ties.
   It depends on the window's bytes alone, so equal windows have their anchor
   at the same offset a. Neighbouring windows mostly share an anchor; such a run
   is one record, cut where a crosses ``length / 2``. All windows of a record
   hold the same half window beside the anchor, its core (before the anchor for
   large a, after it for small a). Windows of different cores are never equal.
2. Only records whose core occurs twice go on (hashes are counted over the
   whole corpus, after partial sums in each task). Records equal byte for byte
   are collapsed to one, with their number.
3. The bytes of the remaining records are cut out of the texts. Sampled
   splitters over (leading bytes of the core, core) range-partition them; the
   suffixes of all windows in a bucket are sorted by multikey quicksort, eight
   bytes as one character: only neighbours still equal are sorted on. Suffixes
   equal over ``length`` bytes repeat. A splitter is a whole core, so no two equal
   suffixes lie on either side of one; suffixes cut off at a batch's end are
   compared with the next batch, as a core's records are held back until the
   core ends.
4. A core with more than ``hot`` distinct records (one passage between a
   million different neighbours) is not sorted in one task: its windows, as
   128-bit digests, are counted by a partially summed aggregate instead, and
   the counts come back by joins that Spark splits where they are skewed.
5. Repeated windows become byte spans of each document, merged and cut out.

Defined results: NULL text counts as empty; a text shorter than ``length`` keeps
all bytes; repeated rows (same id and text) are separate documents, so each
repeats the other; NULL ids are kept and matched with NULL; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import blobs, prepare, read, runs, same, stored
from winnow.operators.index import bucketed
from winnow.session import shuffle_width

LENGTH = 400
GRAM = 16
HOT = 4096
CHUNK = 1 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(data: np.ndarray, big: bool) -> np.ndarray:
    """The eight bytes from each position as one unsigned integer."""
    w = data.astype(np.uint64)
    for step in (1, 2, 4):
        shift = np.uint64(8 * step)
        w = (w[:-step] << shift | w[step:]) if big else (w[:-step] | w[step:] << shift)
    return w


def _window_anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Anchor position of the window at each position of ``data``."""
    w = _words(data, big=False)
    h = w[:len(w) - 8] * _C1 ^ (w[8:] * _C2)
    h ^= h >> np.uint64(29)
    h *= _C2
    # Upper 40 bits: hash; lower 24: position, so the leftmost wins a tie.
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    least = key
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def _records(text: bytes, offset_ends: np.ndarray, length: int):
    """(s0, s1, anchor, side) of each record of a run of texts: windows s0..s1
    (inclusive) share the anchor and the side of it their core is on."""
    anchors = _window_anchors(np.frombuffer(text, np.uint8), length)
    s = np.arange(len(anchors), dtype=np.int64)
    end = offset_ends[np.searchsorted(offset_ends, s, side="right")]
    valid = s + length <= end
    side = anchors - s >= length // 2
    code = np.where(valid, anchors * 2 + side, -1)
    a, b = runs(code)
    keep = code[a] >= 0
    a, b = a[keep], b[keep]
    return a, b - 1, anchors[a], side[a]


def _batches_of_texts(texts: list[bytes], length: int):
    """Groups of text numbers of about CHUNK bytes, texts of a window or more."""
    group, total = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > 4 * CHUNK:
            yield [i]
            continue
        group.append(i)
        total += len(t)
        if total >= CHUNK:
            yield group
            group, total = [], 0
    if group:
        yield group


def _pieces_of(text: bytes, length: int):
    """A text longer than CHUNK in overlapping parts: windows of one part start
    before the next part begins."""
    step = CHUNK * 4
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, text[at:at + step + length - 1]


def anchor_records(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, s0, windows, back, core, c0, c1): one row per record of each text."""
    half = length // 2

    def emit(keys, hashes, texts, places):
        """places: (text number, position of the part in its text) by part."""
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate(([0], ends[:-1]))
        s0, s1, p, side = _records(data, ends, length)
        which = np.searchsorted(ends, s0, side="right")
        core_at = np.where(side, p - half, p)
        core, c0, c1 = [], [], []
        for a, b, c, left, back in zip(s0.tolist(), s1.tolist(), core_at.tolist(), side.tolist(), (p - s0).tolist()):
            core.append(xxhash.xxh3_64_intdigest(data[c:c + half], int(left)))
            whole = xxhash.xxh3_128_intdigest(data[a:b + length], back)
            c0.append(whole >> 64)
            c1.append(whole & 0xFFFFFFFFFFFFFFFF)
        number = np.array([n for n, _ in places], np.int64)[which]
        shift = np.array([o for _, o in places], np.int64)[which]
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(number)), hashes.take(pa.array(number)), pa.array(s0 - starts[which] + shift),
             pa.array((s1 - s0 + 1).astype(np.int32)), pa.array((p - s0).astype(np.int32)),
             signed(core), signed(c0), signed(c1)],
            ["id", "th", "s0", "windows", "back", "core", "c0", "c1"])

    def run(batches):
        for batch in batches:
            texts = blobs(batch.column(2))
            for group in _batches_of_texts(texts, length):
                if len(group) == 1 and len(texts[group[0]]) > CHUNK * 4:
                    for at, part in _pieces_of(texts[group[0]], length):
                        yield emit(batch.column(0), batch.column(1), [part], [(group[0], at)])
                else:
                    yield emit(batch.column(0), batch.column(1), [texts[i] for i in group], [(i, 0) for i in group])

    return docs.mapInArrow(run, "id long, th long, s0 long, windows int, back int, core long, c0 long, c1 long")


def sort_suffixes(data: np.ndarray, starts: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (its start in ``data``): does another share its first
    ``length`` bytes? Multikey quicksort, eight bytes as one character: suffixes
    equal so far form a group; a group is sorted on the next character and falls
    into smaller groups; groups of one leave."""
    word = _words(np.concatenate((data, np.zeros(8, np.uint8))), big=True)
    tail = length % 8
    mask = np.uint64(0xFFFFFFFFFFFFFFFF << (8 * (8 - tail)) & 0xFFFFFFFFFFFFFFFF) if tail else None
    repeated = np.zeros(len(starts), bool)
    members = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in range(0, length, 8):
        if not len(members):
            break
        char = word[starts[members] + depth]
        if mask is not None and depth + 8 > length:
            char = char & mask
        edge = np.concatenate(([True], (group[1:] != group[:-1])))
        differs = np.concatenate(([False], (char[1:] != char[:-1]) & ~edge[1:]))
        if differs.any():
            # Sort only the groups in which the character differs.
            label = np.cumsum(edge) - 1
            mixed = np.zeros(label[-1] + 1, bool)
            mixed[label[differs]] = True
            rows = np.flatnonzero(mixed[label])
            order = rows[np.lexsort((char[rows], label[rows]))]
            members[rows], char[rows] = members[order], char[order]
            edge[1:] |= char[1:] != char[:-1]
        label = np.cumsum(edge) - 1
        size = np.bincount(label)
        alone = size[label] == 1
        repeated[members[alone]] = weight[members[alone]] > 1
        members, group = members[~alone], label[~alone]
    repeated[members] = True
    return repeated


def _spans(flags: np.ndarray, length: int) -> list[dict]:
    a, b = runs(flags)
    return [{"a": int(x), "b": int(y - 1 + length)} for x, y in zip(a, b) if flags[x]]


def _sorted_spans(records: DataFrame, length: int) -> DataFrame:
    """Records of a bucket (sorted by core, c0, c1) -> (core, c0, c1, spans)."""
    def solve(rows):
        size = np.array([len(r[3]) for r in rows])
        at = np.cumsum(size) - size
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        windows = size - length + 1
        first = np.cumsum(windows) - windows
        number = np.repeat(np.arange(len(rows)), windows)
        starts = np.arange(windows.sum()) - first[number] + at[number]
        weight = np.array([r[4] for r in rows], np.int64)[number]
        repeated = sort_suffixes(data, starts, weight, length)
        spans = [_spans(repeated[f:f + w], length) for f, w in zip(first.tolist(), windows.tolist())]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], ["core", "c0", "c1", "spans"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                # Equal records are neighbours; one is enough.
                if held and row[:3] == held[-1][:3]:
                    continue
                # A core's records stay together in one sort.
                if total >= CHUNK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
        if held:
            yield solve(held)

    return (records.select("core", "c0", "c1", "bytes", "copies")
            .mapInArrow(run, "core long, c0 long, c1 long, spans array<struct<a:int,b:int>>"))


def _counted_spans(records: DataFrame, length: int) -> DataFrame:
    """The same for records of hot cores, by counting their windows' digests."""
    def digests(batches):
        for batch in batches:
            for core, c0, c1, data, copies in zip(*[c.to_pylist() for c in batch.columns]):
                n = len(data) - length + 1
                out = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([core] * n, pa.int64()), pa.array([c0] * n, pa.int64()), pa.array([c1] * n, pa.int64()),
                     pa.array(range(n), pa.int32()), pa.array([copies] * n, pa.int64()), pa.array(out, pa.binary())],
                    ["core", "c0", "c1", "w", "copies", "digest"])

    windows = (records.select("core", "c0", "c1", "bytes", "copies")
               .mapInArrow(digests, "core long, c0 long, c1 long, w int, copies long, digest binary"))
    again = windows.groupBy("digest").agg(F.sum("copies").alias("n")).where("n > 1").select("digest")
    hit = windows.join(again, "digest", "left_semi")
    return (hit.groupBy("core", "c0", "c1")
            .agg(F.collect_list(F.struct(F.col("w").alias("a"), (F.col("w") + length).alias("b"))).alias("spans")))


def repeated_spans(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(id, th, spans): byte spans of each document that repeat elsewhere."""
    spark = docs.sparkSession
    records = stored(anchor_records(docs.select("id", "th", "text"), length), "suffix-anchors")
    # Stored, so that both sides of the join are plain shuffles and a hot core is split.
    twice = stored(records.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "suffix-twice")
    # Rows that repeat (id, text) have the same records: one of each goes on, with
    # its number. Not grouped by the core, so that the join may be split; the cores take
    # ten times their file's size in memory and are not broadcast.
    found = (records.join(twice.hint("merge"), "core", "left_semi").groupBy("id", "th", "s0")
             .agg(*[F.first(c).alias(c) for c in ("windows", "back", "core", "c0", "c1")], F.count(F.lit(1)).alias("rows")))
    found = stored(found, "suffix-found")

    # One representative of equal records, with their number.
    place = F.struct(F.col("id"), F.col("th"), F.col("s0"), F.col("windows"), F.col("back"))
    distinct = found.groupBy("core", "c0", "c1").agg(F.sum("rows").alias("copies"), F.min(place).alias("at"))
    crowd = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    wanted = (distinct.join(crowd, "core")
              .select("core", "c0", "c1", "copies", "at.*", (F.col("n") > hot).alias("hot")))
    per_doc = (wanted.groupBy("id", "th")
               .agg(F.collect_list(F.struct("s0", "windows", "back", "core", "c0", "c1", "copies", "hot")).alias("cuts")))
    per_doc = per_doc.select(F.col("id").alias("d_id"), F.col("th").alias("d_th"), "cuts")
    texts = docs.join(per_doc, same(docs["id"], per_doc["d_id"]) & (docs["th"] == per_doc["d_th"])).select("text", "cuts", "d_id", "d_th")

    half = length // 2

    def cut(batches):
        done = set()
        for batch in batches:
            out = []
            for text, cuts, *key in zip(blobs(batch.column(0)), *[c.to_pylist() for c in batch.columns[1:]]):
                # A text cut here already. The records of a text that repeats all have copies.
                if tuple(key) in done:
                    continue
                if all(c["copies"] > 1 for c in cuts):
                    done.add(tuple(key))
                for c in cuts:
                    data = text[c["s0"]:c["s0"] + c["windows"] - 1 + length]
                    at = c["back"] - half if c["back"] >= half + c["windows"] - 1 else c["back"]
                    out.append((c["core"], c["c0"], c["c1"], data, c["copies"], c["hot"], data[at:at + 12].hex()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["core", "c0", "c1", "bytes", "copies", "hot", "lead"])

    # Repeated rows of one document give the same cut once in each task that reads them.
    cuts = stored(texts.mapInArrow(cut, "core long, c0 long, c1 long, bytes binary, copies long, hot boolean, lead string"),
                  "suffix-cuts")
    ordered = (bucketed(cuts.where("not hot"), ["lead", "core"], 2 * shuffle_width(spark))
               .repartition(2 * shuffle_width(spark), "__bucket").sortWithinPartitions("__bucket", "lead", "core", "c0", "c1"))
    often = cuts.where("hot").dropDuplicates(["core", "c0", "c1"])
    spans = _sorted_spans(ordered, length).unionByName(_counted_spans(often, length))
    spans = spans.select("core", "c0", "c1", "spans").where(F.size("spans") > 0)
    hits = (found.join(spans, ["core", "c0", "c1"])
            .select("id", "th", F.explode("spans").alias("x"), "s0")
            .select("id", "th", F.struct((F.col("s0") + F.col("x.a")).alias("a"), (F.col("s0") + F.col("x.b")).alias("b"))
                    .alias("span")))
    return hits.groupBy("id", "th").agg(F.collect_list("span").alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Union of half-open spans, ascending; touching spans join."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_bytes, spans, kept): the spans removed and the remaining
    bytes, one row per input row. ``th`` is the hash of the text that, with the
    id, tells repeated ids apart."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(rows, length, hot).select(F.col("id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    joined = rows.join(spans, same(rows["id"], spans["s_id"]) & (rows["th"] == spans["s_th"]), "left")

    def run(batches):
        for batch in batches:
            sizes, found, kept = [], [], []
            for data, spans in zip(blobs(batch.column(2)), batch.column(3).to_pylist()):
                gone = merged(spans)
                ends = [0, *[b for _, b in gone]]
                starts = [*[a for a, _ in gone], len(data)]
                sizes.append(len(data))
                found.append([{"a": a, "b": b} for a, b in gone])
                kept.append(b"".join(data[x:y] for x, y in zip(ends, starts)))
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, kind),
                 pa.array(kept, pa.binary())], ["doc_id", "th", "n_bytes", "spans", "kept"])

    return joined.select("id", "th", "text", "spans").mapInArrow(
        run, "doc_id long, th long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")


def long_enough(data: bytes, spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """The spans of ``LENGTH`` bytes or more, and those that hold ``min_words`` words
    or more, words cut at their ends included."""
    return [(a, b) for a, b in spans if b - a >= LENGTH or len(data[a:b].split()) >= min_words]


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id",
                    text_col: str = "text", min_words: int = 0) -> DataFrame:
    """``docs`` with its columns, the repeated bytes gone from ``text``; with
    ``min_words`` only passages that have so many words, or ``LENGTH`` bytes. A
    character cut in two goes whole; where the table has ``n_chars`` it is
    counted anew. NULL texts stay NULL."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(rows, length, hot).select(F.col("id").alias("__id"), F.col("th").alias("__th"),
                                                     F.col("spans").alias("__spans"))
    joined = docs.join(spans, same(F.col(id_col).cast("long"), F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    names, at = docs.columns, docs.columns.index(text_col)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            cols, was = batch.columns[:-1], batch.column(at).to_pylist()
            new = [t if t is None or not s else cut_text(d := t.encode(), long_enough(d, merged(s), min_words))
                   for t, s in zip(was, batch.columns[-1].to_pylist())]
            cols[at] = pa.array(new, pa.string())
            if counted is not None:
                cols[counted] = pa.array([n if t is None else len(t) for n, t in zip(cols[counted].to_pylist(), new)],
                                         batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.select(*[F.col(c) for c in docs.columns], "__spans").mapInArrow(run, docs.schema)


def cut_text(data: bytes, gone: list[tuple[int, int]]) -> str:
    ends = [0, *[b for _, b in gone]]
    starts = [*[a for a, _ in gone], len(data)]
    return "".join(data[x:y].decode("utf-8", "ignore") for x, y in zip(ends, starts))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
