"""Toxicity by cumulative-link ordinal regression.

Grades are ordered: 0 clean; toxic documents are 1 or, with more marking words
than the median of the toxic documents, 2. Marking words are those that occur in
far more toxic than clean documents (a two-sample z of the document shares of at
least ``MARKING_Z``, whatever other words reach), counted over the rows of the fit;
they are also the features.
P(grade > j) = sigmoid(w.x - t_j) with t_0 < t_1 < ...: one weight vector for all
thresholds. The expected severity is the sum over j of P(grade > j); a document is
flagged when P(grade > 0) passes ``flag_at``.

Features are sparse: hashed words (letters and digits, lower case) with the log
of 1 + their count. Whole texts are read, each in its task.

The model is learned from a bounded sample of the labels (``max_rows``, by hash of
the id). Its ids are broadcast, so the texts are read once and none is shuffled;
their words' slots and counts are stored and counted by an aggregate of at most
``SLOTS`` rows. The fit runs on the driver, to which only the marking words of the
sample arrive: full-batch steps on the negative log likelihood with a ridge penalty.
Prediction covers every row.

Defined results: NULL or wordless text has only the thresholds; labels with NULL
toxic are not learned from; labels of unknown documents are ignored, repeated
labels learned as often as they occur; without labelled rows of both kinds every
severity is that of the one kind (0 without any); repeated rows repeat in the
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import blobs, prepare, read, stored

SLOTS = 1 << 18
MAX_ROWS = 8_000
FLAG_AT = 0.5
MARKING_Z = 6.0
#: Documents a marking word must be in.
MARKING_ROWS = 3
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def word_slots(text: bytes) -> np.ndarray:
    """The slot of each word of a text, in order."""
    words = _WORD.findall(text.decode("utf-8", "replace").lower().encode())
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def features(text: bytes, marking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of the marking words of one text, ascending slots."""
    slots = word_slots(text)
    slots, n = np.unique(slots[marking[slots]], return_counts=True)
    return slots, np.log1p(n)


class OrdinalModel:
    """Shared weights and ascending thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.marking = weights != 0

    def exceed(self, margin: float) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return 1.0 / (1.0 + np.exp(-np.clip(margin - self.thresholds, -40, 40)))

    def margin(self, text: bytes) -> float:
        slots, values = features(text, self.marking)
        return float(self.weights[slots] @ values)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int = 3, steps: int = 1500,
        rate: float = 0.1, ridge: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood by adaptive full-batch steps. Threshold gaps are exp of
    free numbers, so the order of the thresholds holds throughout."""
    k = levels - 1
    if not len(rows) or (grades == grades[0]).all():
        top = 40.0 if not len(rows) or grades[0] == 0 else -40.0
        return OrdinalModel(np.zeros(SLOTS), np.full(k, top))
    sizes = np.array([len(s) for s, _ in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    slot = np.concatenate([s for s, _ in rows])
    value = np.concatenate([v for _, v in rows])
    used, slot = np.unique(slot, return_inverse=True)
    weight = np.full(len(rows), 1.0 / len(rows))
    w, free = np.zeros(len(used)), np.concatenate(([0.0], np.zeros(k - 1)))
    means, squares = [np.zeros(len(used)), np.zeros(k)], [np.zeros(len(used)), np.zeros(k)]
    for step in range(steps):
        t = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        margin = np.bincount(row, value * w[slot], minlength=len(rows))
        # P(y <= j) at the bounds of each row's grade, with 0 and 1 outside.
        cdf = 1.0 / (1.0 + np.exp(-np.clip(t[None] - margin[:, None], -40, 40)))
        edge = np.concatenate((np.zeros((len(rows), 1)), cdf, np.ones((len(rows), 1))), axis=1)
        slope = edge * (1 - edge)
        at = np.arange(len(rows))
        p = np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-12)
        d_margin = weight * (slope[at, grades + 1] - slope[at, grades]) / p
        d_t = np.zeros(k)
        for j in range(k):
            d_t[j] = -(weight * ((grades == j) * slope[:, j + 1] - (grades == j + 1) * slope[:, j + 1]) / p).sum()
        gaps = np.exp(free[1:])
        grads = [np.bincount(slot, value * d_margin[row], minlength=len(used)) + ridge * w,
                 np.concatenate(([d_t.sum()], [d_t[j:].sum() * gaps[j - 1] for j in range(1, k)]))]
        # Steps of a running mean of gradients over their running size.
        for x, g, mean, size in zip((w, free), grads, means, squares):
            mean += 0.1 * (g - mean)
            size += 0.01 * (g * g - size)
            x -= rate * (1 - step / steps) * mean / (np.sqrt(size / (1 - 0.99 ** (step + 1))) + 1e-9)
    weights = np.zeros(SLOTS)
    weights[used] = w
    return OrdinalModel(weights, np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))))


def word_rows(rows: DataFrame) -> DataFrame:
    """Of (text, hit): (slots, counts, hit), the distinct slots of each text's words."""
    def run(batches):
        for batch in batches:
            slots, counts = [], []
            for text in blobs(batch.column(0)):
                own, n = np.unique(word_slots(text), return_counts=True)
                slots.append(own.astype(np.int32))
                counts.append(n.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(slots, kind), pa.array(counts, kind), batch.column(1)],
                                             ["slots", "counts", "hit"])

    return rows.select("text", "hit").mapInArrow(run, "slots array<int>, counts array<int>, hit boolean")


def document_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of :func:`word_rows`: the clean and toxic rows that hold each slot's word, and
    how many rows there are of either kind."""
    n = np.zeros(2)
    for row in words.groupBy("hit").count().collect():
        n[int(row.hit)] = row["count"]
    toxic = F.sum(F.col("hit").cast("long"))
    table = (words.select("hit", F.explode("slots").alias("slot")).groupBy("slot")
             .agg((F.count(F.lit(1)) - toxic).alias("clean"), toxic.alias("toxic")).toArrow())
    kinds = np.zeros((2, SLOTS))
    for kind, name in zip(kinds, ("clean", "toxic")):
        kind[table.column("slot").to_numpy()] = table.column(name).to_numpy()
    return kinds, n


def marking_words(kinds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each slot's word marks, from the counts of :func:`document_counts`."""
    n = np.maximum(n, 1)
    both = kinds.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(both * (1 - both) * (1 / n[0] + 1 / n[1]), 1e-12))
    z = (kinds[1] / n[1] - kinds[0] / n[0]) / spread
    return (z >= MARKING_Z) & (kinds[1] >= MARKING_ROWS)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, levels: int = 3) -> OrdinalModel:
    """From the marking words (slots, counts) of each labelled text and whether it is toxic."""
    marks = np.array([int(n.sum()) for _, n in rows])
    grades = np.zeros(len(rows), np.int64)
    if toxic.any():
        grades[toxic] = 1 + (marks[toxic] > np.median(marks[toxic]))
    return fit([(slots, np.log1p(n)) for slots, n in rows], grades, levels)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_ROWS) -> OrdinalModel:
    prepare(docs.sparkSession)
    graded = labels.where(F.col("toxic").isNotNull()).select(F.col(id_col).alias("l_id"), (F.col("toxic") > 0).alias("hit"))
    # The smallest hashes: the same rows whatever the layout. Each task first drops
    # hashes far above those, so about as many rows as are wanted are ordered.
    graded = graded.withColumn("hash", F.xxhash64("l_id").bitwiseAND(F.lit((1 << 40) - 1)))
    rate = 2 * (max_rows + 100) / max(1, graded.count())
    graded = graded.where(F.col("hash") < int(min(1.0, rate) * (1 << 40))).orderBy("hash", "l_id", "hit").limit(max_rows)
    # At most ``max_rows`` ids: small enough to go to every task, so no text is shuffled.
    chosen = F.broadcast(graded.select("l_id", "hit"))
    rows = docs.join(chosen, docs[id_col] == chosen["l_id"]).select(F.col(text_col).cast("string").alias("text"), "hit")
    words = stored(word_rows(rows), "toxicity-words")
    shared = docs.sparkSession.sparkContext.broadcast(marking_words(*document_counts(words)))

    def run(batches):
        marks = shared.value
        for batch in batches:
            slots, counts = [], []
            for own, n in zip(batch.column(0), batch.column(1)):
                own, n = own.values.to_numpy(), n.values.to_numpy()
                slots.append(own[marks[own]])
                counts.append(n[marks[own]])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(slots, kind), pa.array(counts, kind), batch.column(2)],
                                             ["slots", "counts", "hit"])

    table = words.mapInArrow(run, "slots array<int>, counts array<int>, hit boolean").toArrow()
    found = [(np.asarray(s.values, np.int64), np.asarray(n.values, np.int64), t)
             for s, n, t in zip(table.column("slots"), table.column("counts"), table.column("hit").to_pylist())]
    # Rows arrive in no fixed order; the sums of the fit should not depend on it.
    found.sort(key=lambda x: (x[2], x[0].tobytes(), x[1].tobytes()))
    return learn([(s, n) for s, n, _ in found], np.array([t for _, _, t in found], bool))


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
             flag_at: float = FLAG_AT) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic), one row per input row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        m = shared.value
        for batch in batches:
            over = np.array([m.exceed(m.margin(t)) for t in blobs(batch.column(1))]).reshape(-1, len(m.thresholds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(over.sum(axis=1)), pa.array((over > 0.5).sum(axis=1).astype(np.int32)),
                 pa.array(over[:, 0]), pa.array(over[:, 0] > flag_at)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return severity(docs, train(docs, read(spark, sf_dir, "labels")))
