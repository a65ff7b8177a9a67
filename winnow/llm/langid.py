"""Language ID by error-correcting output codes.

Each learned language has a codeword of +1/-1 bits. For each bit a binary
classifier over hashed byte 3-grams (lower-cased text, other ASCII characters as
blanks) tells the languages with +1 from those with -1: the weight of a gram is
the log ratio of its smoothed share in either side, every language counting
alike. The counts behind the weights cover every training row; each task sums
its own rows and sends one count per language and gram.

A text's bit margins are the mean weights of its grams. Decoding is
loss-weighted: a language's loss is the sum over bits of logistic loss of the
margin against its codeword, weighted by how well the bit's sides separate (the
symmetric divergence of their gram shares); the least loss wins, and a softmax
over the losses is the score. ``ambiguous`` flags a runner-up nearly as close.

Up to six languages the code is exhaustive (every split of the languages once:
with four, any two codewords differ in four of seven bits); beyond, columns come
from a hash until every pair differs in a quarter of the bits.

Defined results: NULL text or text without a letter is ``und``, score 0, not
ambiguous; with no training row everything is ``und``; rows with NULL id are
neither held out nor learned from; repeated rows repeat in the result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import blobs, prepare, read

GRAM_SLOTS = 1 << 14
#: The model is this many languages x GRAM_SLOTS numbers at most.
MAX_LANGUAGES = 400
SMOOTHING = 0.5
#: Margins are means over grams; the loss sees them times the root of the
#: number of grams, at most this.
SHARPNESS = 6.0
#: The two best scores closer than this: ambiguous.
AMBIGUITY = 0.2
CHUNK = 1 << 18
UNKNOWN = "und"

_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def _slots(data: np.ndarray) -> np.ndarray:
    """Slot of the 3-gram at each position; slot 0 is the gram of three blanks."""
    a = data.astype(np.uint32)
    gram = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
    slot = (gram * np.uint32(2654435761)) >> np.uint32(18)
    return np.where(gram == 0x202020, 0, np.maximum(slot, 1))


def _padded(texts: list[bytes]):
    """Chunks of (slots, start of each text's grams); a text's grams see its own
    bytes and blanks only."""
    group, total = [], 0

    def done(parts):
        data = b"".join([*parts, b"   "])
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        return _slots(np.frombuffer(data, np.uint8))[:len(data) - 3], starts
    for t in texts:
        group.append(b" " + t.decode("utf-8", "replace").lower().encode().translate(_BLANKED) + b"   ")
        total += len(t)
        if total >= CHUNK:
            yield done(group)
            group, total = [], 0
    if group:
        yield done(group)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(label, slot, n) over rows (label, text): partial counts by task, summed."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            texts = blobs(batch.column(1))
            for label in set(labels):
                own = [t for t, x in zip(texts, labels) if x == label]
                held = counts.setdefault(label, np.zeros(GRAM_SLOTS, np.int64))
                for slots, _ in _padded(own):
                    held += np.bincount(slots, minlength=GRAM_SLOTS)
        for label, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])],
                                             ["label", "slot", "n"])

    return (rows.mapInArrow(run, "label string, slot int, n long")
            .groupBy("label", "slot").agg(F.sum("n").alias("n")))


def codewords(n: int) -> np.ndarray:
    """n codewords of +1/-1 bits, one a row."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float64).reshape(-1, n).T
    columns = []
    while True:
        seed = hashlib.sha256(f"column {len(columns)}".encode()).digest()
        rng = np.random.default_rng(int.from_bytes(seed[:8], "little"))
        column = np.ones(n)
        column[rng.permutation(n)[:n // 2]] = -1
        columns.append(column)
        if len(columns) >= 10 * np.ceil(np.log2(n)):
            code = np.array(columns).T
            apart = (len(columns) - code @ code.T) / 2
            if (apart + np.eye(n) * len(columns)).min() >= len(columns) / 4:
                return code


class CodeModel:
    """Languages, codewords, gram weights (slots x bits) and bit weights."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        share = np.array([counts[x] + SMOOTHING for x in self.languages]).reshape(-1, GRAM_SLOTS)
        share[:, 0] = SMOOTHING
        share /= share.sum(axis=1, keepdims=True)
        weights, apart = [], []
        for bit in self.code.T:
            up, down = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
            ratio = np.log(up) - np.log(down)
            ratio[0] = 0.0
            weights.append(ratio)
            apart.append(((up - down) * ratio).sum())
        bits = len(weights)
        self.weights = np.array(weights, np.float32).reshape(bits, -1).T.copy() if bits else np.zeros((GRAM_SLOTS, 0), np.float32)
        total = sum(apart)
        self.bit_weights = np.array(apart) / total * bits if total > 0 else np.ones(bits)

    def scores(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Softmax scores (texts x languages)."""
        # Each text has at least its own blanks, so no range is empty.
        sums = np.add.reduceat(self.weights[slots], starts, axis=0, dtype=np.float64)
        grams = np.add.reduceat((slots > 0).astype(np.int64), starts)
        margin = sums / np.maximum(grams, 1)[:, None] * np.minimum(np.sqrt(grams), SHARPNESS)[:, None]
        loss = np.logaddexp(0.0, -margin[:, None, :] * self.code[None]) @ self.bit_weights
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return near / near.sum(axis=1, keepdims=True)


    def decide(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and ambiguity of each text."""
        names, scores, close = [], [], []
        for slots, starts in _padded(texts):
            if not self.languages:
                names += [UNKNOWN] * len(starts)
                scores += [0.0] * len(starts)
                close += [False] * len(starts)
                continue
            s = self.scores(slots, starts)
            top = np.sort(s, axis=1)[:, ::-1]
            names += [self.languages[i] for i in s.argmax(axis=1)]
            scores += top[:, 0].tolist()
            close += (top[:, 0] - top[:, 1] < AMBIGUITY).tolist() if s.shape[1] > 1 else [False] * len(s)
        for i, t in enumerate(texts):
            if not _LETTER.search(t.decode("utf-8", "replace")):
                names[i], scores[i], close[i] = UNKNOWN, 0.0, False
        return names, scores, close


def train(rows: DataFrame) -> CodeModel:
    """Learn from all rows (label, text) with neither NULL."""
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    names = [r.label for r in rows.select("label").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = {n: np.zeros(GRAM_SLOTS) for n in names}
    for r in gram_counts(rows).toLocalIterator():
        counts[r.label][r.slot] = r.n
    return CodeModel(counts)


def predict(docs: DataFrame, model: CodeModel) -> DataFrame:
    """(key, lang_pred, score, ambiguous) for rows (key, text); key is any column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score, close = shared.value.decide(blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                ["key", "lang_pred", "score", "ambiguous"])

    key = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(run, f"key {key}, lang_pred string, score double, ambiguous boolean")


def tell(docs: DataFrame, model: CodeModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``model`` gives a language without doubt. Rows
    pass through the tasks whole, so nothing is shuffled or matched by id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names, _, close = shared.value.decide(blobs(batch.column(at)))
            yield batch.filter(pa.array([n != UNKNOWN and not c for n, c in zip(names, close)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str):
    """One third of the documents by id; never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learning from the rows of
    ``docs`` that are not held out."""
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    learn = docs.where(~held_out(id_col) & F.col(id_col).isNotNull())
    model = train(learn.select(F.col(lang_col).cast("string").alias("label"), text.alias("text")))
    out = predict(docs.select(F.col(id_col).alias("key"), text.alias("text")), model)
    return out.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, all columns as they are:
    without those that are ``und`` or ambiguous."""
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    learn = docs.where(~held_out(id_col) & F.col(id_col).isNotNull())
    model = train(learn.select(F.col(lang_col).cast("string").alias("label"), text.alias("text")))
    return tell(docs, model, text_col)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
