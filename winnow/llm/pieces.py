"""SentencePiece encoding and decoding with a public model file.

An Aho-Corasick automaton over the normal pieces reads a text once. At each
position it reports, along its output links, every piece that ends there; each
relaxes the best score at that position from the one at its start (Viterbi). A
character that no piece covers takes one step with a score below every piece and
is written as its UTF-8 byte pieces. On equal scores the longer piece wins.
Scores are the file's own.

Pieces begin at word starts or inside words, never across one (checked when the
file is read), so the best path of a text is that of its words, one after the
other; words repeat, and a worker remembers the ids of ``REMEMBERED`` of them.

Text form, as the file asks: one blank before the text, blanks as U+2581, no
other change. Decoding joins the pieces, byte pieces as bytes, and takes the
blank off again. A U+2581 of the text itself comes back as a blank.

Defined results: NULL text counts as empty (no ids); invalid byte sequences
cannot occur in a string column; repeated rows repeat in the result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import prepare, read

SPACE = "▁"
REMEMBERED = 200_000
_WORKER: dict = {}


class Pieces:
    """The automaton and tables of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = {}
        self.automaton = ahocorasick.Automaton()
        scores = []
        crossing = re.compile(f"[^{SPACE}]{SPACE}|\n")
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    if crossing.search(piece):
                        raise ValueError(f"piece {i} crosses a word start")
                    scores.append(model.get_score(i))
                    self.automaton.add_word(piece, (i, len(piece), scores[-1]))
        if len(self.byte_id) != 256:
            raise ValueError("the file has no byte pieces")
        self.automaton.make_automaton()
        # Fixed value: how far an unknown character stands below the worst piece.
        self.unknown = min(scores) - 10.0
        # Marks that no piece has after a letter or digit: a word ends before them.
        inside = "".join(self.automaton.keys())
        after = {b for p in self.automaton.keys() for a, b in zip(p, p[1:]) if a.isalnum()}
        marks = re.escape("".join(c for c in string.punctuation if c in inside and c not in after))
        ends = rf"{SPACE}*[^\W_]+(?=[{marks}])|" if marks else ""
        self.words = re.compile(rf"\n|{ends}{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}

    def best_path(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text`` (blanks already U+2581)."""
        n = len(text)
        best = [0.0] + [None] * n
        back: list = [None] * (n + 1)
        matches = self.automaton.iter(text)
        at, (found, length, score) = next(matches, (n, (0, 0, 0.0)))
        for end in range(n):
            # The step of one unknown character; any piece ending here may beat it.
            top, way = best[end] + self.unknown, (end, -1)
            size = 0
            while at == end:
                through = best[end + 1 - length] + score
                if through > top or (through == top and length > size):
                    top, way, size = through, (end + 1 - length, found), length
                at, (found, length, score) = next(matches, (n, (0, 0, 0.0)))
            best[end + 1], back[end + 1] = top, way
        ids, end = [], n
        while end:
            start, found = back[end]
            if found >= 0:
                ids.append(found)
            else:
                ids += [self.byte_id[b] for b in reversed(text[start:end].encode())]
            end = start
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        words = self.words((" " + text).replace(" ", SPACE))
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    ids = known.get(words[i])
                    if ids is None:
                        ids = array("I", self.best_path(words[i])).tobytes()
                        if len(words[i]) < 100:
                            known[words[i]] = ids
                    out[i] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, array("I", ids)))
        return data.decode("utf-8", "replace")[1:]


def pieces_of(path: str) -> Pieces:
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as an array of int, one row per input row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = pieces_of(path)
        for batch in batches:
            found = [array("i", model.encode(t or "")) for t in batch.column(1).to_pylist()]
            ends = array("i", [0])
            for f in found:
                ends.append(ends[-1] + len(f))
            flat = pa.array(memoryview(b"".join(f.tobytes() for f in found)).cast("i") if ends[-1] else [], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text) from (doc_id, ids)."""
    def run(batches):
        model = pieces_of(path)
        for batch in batches:
            lists = batch.column(1)
            ids = [array("i", x.values.to_numpy()).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([model.decode(x) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text string")


def piece_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Each document's number of ids, their checksum, and the digest of the text
    decoded from them."""
    out = decode(encode(read(spark, sf_dir, "documents"), piece_path()), piece_path())
    return out.select("doc_id", "n_tokens", "ids_crc32", F.char_length("text").cast("long").alias("n_chars"),
                      F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


