"""Alignment of two tokenizers' token streams of the same texts.

A encodes a blank and the text with a byte-level BPE file of `tokenizers`; B
encodes the text with a `sentencepiece` BPE model, which adds that blank itself.
Strings of special tokens are plain text for both. Both streams spell the same
bytes (checked for each text; one that differs has no tokens), so offsets in
bytes compare. Where a token of A and a token of B end together, the streams are
cut into groups; the last two tokens of a group are linked.

Method. A text is tokenised whole by both. Offsets at which both streams go on with
a token that starts with a blank are anchors: the tokens before them verifiably
end together. Anchors cut the text into windows of a few ids of either side. What
a window's groups and links are depends on its ids alone, so a worker remembers
windows by their id tuples and aligns each but once (up to ``WINDOWS`` of them;
then the memory starts anew; long windows are aligned without being remembered).

The encoders remember units - a line end or blanks with what follows up to the next
one. No piece of B's file holds a line end, or a blank after another character
(checked when the file is read), so its merges stay inside units. In a text of plain
characters with single line ends no word of A crosses a unit's end either, and one
memory holds the ids of both; in other texts each side has its own.

Corpus counts. How often two ids are linked is counted over all documents. A
document's links are a few hundred distinct pairs, so documents are gathered in
blocks of ``BLOCK_BYTES`` of text as they are read: pairs are summed up per block,
then over blocks (partial sums in each task), and the counts come back to a block
once for each pair it holds. No pair of ids, however common, has more rows than
there are blocks.

Defined results: NULL and empty texts have no tokens, and neither have texts whose
tokens of A or B do not spell the blank and the text (a U+2581 of the text itself
reads as a blank in B): zeros and an empty string. NULL ids are kept; repeated
rows are separate documents, each counted; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import string
from array import array
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import prepare, read, stored
from winnow.llm.token_ids import _ODD, IdEncoder, _byte_symbols

SPACE = "▁"
REMEMBERED = 400_000
WINDOWS = 400_000
#: Longer units and windows are not remembered.
UNIT_CHARS, WINDOW_IDS = 100, 60
BLOCK_BYTES = 4 << 20
MARK = 0xFFFFFFFF
#: What a text holds whose units are not made of whole words of A: other characters than
#: those split here, special strings, blank characters next to a line end.
_APART = re.compile(rf"{_ODD.pattern}|<\||[\t\r]|\n[ \n]| \n")
#: Characters of text aligned at once.
PART_CHARS = 200_000
_WORKER: dict = {}


class Made(dict):
    """A memory that makes the values it does not hold."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Asked(dict):
    """A memory that notes the keys it does not hold, each with an empty list to be
    filled later, and hands that list out."""

    def __init__(self):
        super().__init__()
        self.asked: dict = {}

    def __missing__(self, key):
        return self.asked.setdefault(key, [])

    def answered(self) -> dict:
        asked, self.asked = self.asked, {}
        return asked


class PlainIds(IdEncoder):
    """Ids of the byte-level file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        back = {c: b for b, c in enumerate(_byte_symbols())}
        special = set(self.library.get_added_tokens_decoder())
        self.bytes_of = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = token.encode() if i in special else bytes(back[c] for c in token)
        self.differs = False
        self.known = Made(self._model_ids)

    def _model_ids(self, word: str) -> bytes:
        ids = super()._model_ids(word)
        self.differs |= spelled(ids, self.bytes_of) != word.encode()
        return ids

    def spelling_ids(self, text: str) -> bytes | None:
        """Ids of a text, or None if they do not spell it."""
        whole = "<|" in text or _ODD.search(text)
        if whole:
            ids = self.ids(text)
        else:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            ids = b"".join(map(self.known.__getitem__, self.split(text)))
        # Texts made of remembered words are checked word by word.
        if whole or self.differs:
            return ids if spelled(ids, self.bytes_of) == text.encode() else None
        return ids


class PieceIds:
    """Ids of the piece file, remembered by unit."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, before = [], {c: set() for c in string.punctuation}
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif self.library.is_control(i) or self.library.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                if "\n" in piece or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} crosses a unit's start")
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                for x, y in zip(piece, piece[1:]):
                    if y in before and x.isalnum():
                        before[y].add(x)
        # Marks that no piece holds after a letter or digit, but for a few characters.
        marks = [c for c, found in before.items() if len(found) < 4]
        seldom = "".join(set().union(*[before[c] for c in marks]))
        ends = rf"(?:\n| *)[^\W_{re.escape(seldom)}]+(?=[{re.escape(''.join(marks))}])|" if marks else ""
        self.units = re.compile(rf"{ends}(?:\n| +)[^ \n]*|[^ \n]+").findall
        self.blank = self.library.piece_to_id(SPACE)
        self.known = Asked()
        self.differs = False

    def _units_ids(self, units: list[str]) -> list[bytes]:
        """The library puts a blank before a text: it stands for the first one of a
        unit. A unit without gets a line end (one id) to keep that blank apart."""
        asked = [u[1:] if u[0] == " " else "\n" + u for u in units]
        out = []
        for unit, ids in zip(units, self.library.encode(asked, num_threads=1)):
            if unit[0] != " ":
                ids = ids[2:]
            elif unit == " ":
                ids = [self.blank]
            out.append(array("I", ids).tobytes())
            self.differs |= spelled(out[-1], self.bytes_of) != unit.encode()
        return out

    def spelling_ids(self, texts: list[str]) -> list[bytes | None]:
        """Little-endian ids of each text (it starts with the added blank), or None if
        they do not spell it. Units not remembered go to the library at once."""
        known = self.known
        units = [[] if SPACE in text else self.units(text) for text in texts]
        found = [list(map(known.__getitem__, u)) for u in units]
        asked = known.answered()
        if asked:
            new = list(asked)
            for slot, ids in zip(asked.values(), self._units_ids(new)):
                slot.append(ids)
            if len(known) > REMEMBERED:
                known.clear()
            known.update({u: tuple(slot) for u, slot in asked.items() if len(u) <= UNIT_CHARS})
        ids = [b"".join(chain.from_iterable(o)) for o in found]
        if self.differs:
            return [i if i and spelled(i, self.bytes_of) == t.encode() else None for i, t in zip(ids, texts)]
        return [i or None for i in ids]


def spelled(ids: bytes, bytes_of: list[bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, array("I", ids)))


class Aligner:
    """Both encoders and the remembered windows of one worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PlainIds(a_path), PieceIds(b_path)
        sides = (self.a.bytes_of, self.b.bytes_of)
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
        self.marked = [np.array([x[:1] == b" " for x in side]) for side in sides]
        # The text of each id, with what follows it inside a group and at its end.
        self.names = [f"{i}{end}" for side, last in zip(sides, "|;") for i in range(len(side)) for end in ("," + last)]
        self.windows, self.units = Asked(), Asked()

    def solve(self, keys: list[bytes]) -> list[tuple[str, bytes]]:
        """Groups, as text, and links of windows, each given as its ids of A, MARK
        and its ids of B. Both sides of a window are as long in bytes, so windows
        one after the other are streams that end together after each of them."""
        ids = np.frombuffer(b"".join(keys), np.uint32)
        ends = np.cumsum([len(k) // 4 for k in keys])
        marks = np.flatnonzero(ids == MARK)
        n_a = marks - np.concatenate(([0], ends[:-1]))
        n_b = ends - marks - 1
        place = np.arange(len(ids))
        side = place > np.repeat(marks, n_a + n_b + 1)
        side_a = ~side
        side_a[marks] = False
        a, b = ids[side_a].astype(np.int64), ids[side].astype(np.int64)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
        last_a = end_b[at] == end_a
        i, j = np.flatnonzero(last_a), at[last_a]
        last_b = np.zeros(len(b), bool)
        last_b[j] = True
        # Groups one after the other: tokens of A, then those of B.
        before_a = np.concatenate(([0], i + 1))[np.cumsum(last_b) - last_b + 1]
        before_b = np.concatenate(([0], j + 1))[np.cumsum(last_a) - last_a]
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + before_b] = 2 * a + last_a
        code[np.arange(len(b)) + before_a] = 2 * (b + len(self.sizes[0])) + last_b
        text = list(map(self.names.__getitem__, code.tolist()))
        links = (a[i] << 32 | b[j]).tobytes()
        cut = np.cumsum(n_a + n_b).tolist()
        told = (8 * np.cumsum(last_a)[np.cumsum(n_a) - 1]).tolist()
        return [("".join(text[x:y]), links[p:q]) for x, y, p, q in zip([0, *cut], cut, [0, *told], told)]

    def _starts(self, side: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets at which tokens with a leading blank start, and their places."""
        size = self.sizes[side][ids]
        place = np.flatnonzero(self.marked[side][ids])
        return (np.cumsum(size) - size)[place], place

    def windows_of(self, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The windows between the anchors of texts one after the other, as keys, and
        the place in ``a`` of each one's first id. Every text starts with a blank on
        either side, so its start is an anchor."""
        (start_a, place_a), (start_b, place_b) = self._starts(0, a), self._starts(1, b)
        # Anchors: offsets in both lists (both ascend; the first is the added blank).
        at = np.minimum(np.searchsorted(start_b, start_a), len(start_b) - 1)
        hit = start_b[at] == start_a
        cut_a, cut_b = np.append(place_a[hit], len(a)), np.append(place_b[at[hit]], len(b))
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        edges = np.concatenate(([0], np.cumsum(n_a + n_b + 1)))
        buffer = np.full(edges[-1], MARK, np.uint32)
        buffer[np.arange(len(a)) + np.repeat(cut_b[:-1] + np.arange(len(n_a)), n_a)] = a
        buffer[np.arange(len(b)) + np.repeat(cut_a[1:] + np.arange(1, len(n_a) + 1), n_b)] = b
        data, ends = buffer.tobytes(), (edges * 4).tolist()
        return [data[i:j] for i, j in zip(ends, ends[1:])], cut_a[:-1]

    def both_ids(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides of each text (it starts with the added blank), or None if
        they do not spell it."""
        known, a, b = self.units, self.a, self.b
        plain = [not _APART.search(t) for t in texts]
        found = [list(map(known.__getitem__, b.units(t))) if p else None for t, p in zip(texts, plain)]
        asked = known.answered()
        if asked:
            for (unit, slot), ids in zip(asked.items(), b._units_ids(list(asked))):
                slot += (b"".join(map(a._model_ids, a.split(unit))), ids)
            if len(known) > REMEMBERED:
                known.clear()
            known.update({u: tuple(slot) for u, slot in asked.items() if len(u) <= UNIT_CHARS})
        other = iter(b.spelling_ids([t for t, p in zip(texts, plain) if not p]))
        out: list = []
        for text, p, units in zip(texts, plain, found):
            if p:
                ids = b"".join(map(itemgetter(0), units)), b"".join(map(itemgetter(1), units))
                if a.differs or b.differs:
                    ids = ids if all(spelled(x, side.bytes_of) == text.encode() for x, side in zip(ids, (a, b))) else None
            else:
                raw = next(other)
                ids = raw and (a.spelling_ids(text), raw)
            out.append(ids if ids and ids[0] else None)
        return out

    def align(self, texts: list[str | None]) -> list[tuple[int, int, str, np.ndarray]]:
        """(n_a, n_b, groups, links) of each text; links are id of A * 2^32 + id of B.
        Windows not remembered are solved at once."""
        out: list = [(0, 0, "", np.zeros(0, np.int64))] * len(texts)
        held = [i for i, t in enumerate(texts) if t]
        told = [(i, *ids) for i, ids in zip(held, self.both_ids([" " + texts[i] for i in held])) if ids]
        if not told:
            return out
        n_a, n_b = ([len(x[side]) // 4 for x in told] for side in (1, 2))
        a, b = (np.frombuffer(b"".join([x[side] for x in told]), np.uint32) for side in (1, 2))
        keys, first = self.windows_of(a, b)
        cuts = [*np.searchsorted(first, np.cumsum(n_a) - n_a).tolist(), len(keys)]
        known = self.windows
        found = list(map(known.__getitem__, keys))
        asked = known.answered()
        if asked:
            for slot, window in zip(asked.values(), self.solve(list(asked))):
                slot += window
            if len(known) > WINDOWS:
                known.clear()
            known.update({k: tuple(slot) for k, slot in asked.items() if len(k) <= 4 * WINDOW_IDS})
        groups, links = list(map(itemgetter(0), found)), list(map(itemgetter(1), found))
        for (i, _, _), m, n, x, y in zip(told, n_a, n_b, cuts, cuts[1:]):
            out[i] = (m, n, "".join(groups[x:y])[:-1], np.frombuffer(b"".join(links[x:y]), np.int64))
        return out


def parts_of(texts: list[str | None]):
    """Neighbouring texts of about ``PART_CHARS`` characters together."""
    part, filled = [], 0
    for text in texts:
        part.append(text)
        filled += len(text or "")
        if filled >= PART_CHARS:
            yield part
            part, filled = [], 0
    if part:
        yield part


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    if (a_path, b_path) not in _WORKER:
        _WORKER[a_path, b_path] = Aligner(a_path, b_path)
    return _WORKER[a_path, b_path]


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times, block), one row per input
    row. ``groups`` is ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct links
    (id of A * 2^32 + id of B), ``times`` how often each occurs in the document.
    Write the result before using ``block``: it numbers stretches of rows as read."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext
        own = aligner(a_path, b_path)
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            texts = batch.column(1).to_pylist()
            for part in parts_of(texts):
                for text, (n_a, n_b, groups, links) in zip(part, own.align(part)):
                    pairs, times = np.unique(links, return_counts=True)
                    for col, value in zip(cols, (n_a, n_b, len(links), groups, pairs, times.astype(np.int32), block)):
                        col.append(value)
                    filled += len(text or "")
                    if filled >= block_bytes:
                        block, filled = block + 1, 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times", "block"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, "
                                "times array<int>, block long")


def block_pairs(aligned: DataFrame) -> DataFrame:
    """(block, pair, n): links of each block, summed up."""
    links = aligned.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return links.select("block", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n")).groupBy("block", "pair").agg(
        F.sum("n").alias("n"))


def pair_counts(by_block: DataFrame) -> DataFrame:
    """(pair, links, best): the corpus-wide count of each linked pair of ids, and
    whether no other id of A is linked more often with the same id of B."""
    counts = by_block.groupBy("pair").agg(F.sum("n").alias("links"))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = stored(counts.withColumn("b_id", b_id), "alignment-pairs")
    most = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    return counts.join(most, "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, extra: str = "") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the columns named
    in ``extra``) of stored :func:`alignments`: how many links of a document are
    their B id's most frequent one, and the sum of the counts of all its links."""
    by_block = stored(block_pairs(aligned), "alignment-blocks")
    told = by_block.join(pair_counts(by_block), "pair").select("block", "pair", "links", "best")
    more = [c for c in extra.split(", ") if c]
    plain = ["doc_id", "n_a", "n_b", "n_groups"]

    def solve(docs: pa.Table, told: pa.Table) -> pa.Table:
        pair = told.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, links = pair[order], told.column("links").to_numpy()[order]
        best = told.column("best").to_numpy()[order]
        held = docs.column("pairs").combine_chunks()
        flat, times = held.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(np.asarray([len(x) for x in held], np.int64))
        at = np.searchsorted(pair, flat)

        def total(values):
            run = np.concatenate(([0], np.cumsum(values)))
            return pa.array(run[ends] - run[np.concatenate(([0], ends[:-1]))], pa.int64())

        cols = [docs.column(c) for c in plain]
        sums = [total(times), total(times * best[at]), total(times * links[at])]
        return pa.Table.from_arrays([*cols, *sums, *[docs.column(c) for c in more]],
                                    names=[*plain, "n_links", "n_best", "count_sum", *more])

    kept = aligned.select("block", *plain, "pairs", "times", *more)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join(["doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long",
                        *[f"{c} {kinds[c]}" for c in more]])
    return kept.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(solve, schema)


def paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    found = alignments(read(spark, sf_dir, "documents"), *paths())
    sha = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "utf-8"), 256)).otherwise("")
    return with_counts(stored(found.withColumn("groups_sha256", sha).drop("groups"), "alignments"), "groups_sha256")
