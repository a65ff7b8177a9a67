"""Best-fit packing of documents into token sequences.

1. Documents become ids (public tokenizer, then the end id) inside tasks; only
   a document longer than a sequence is cut, its first piece taking the
   remainder. A narrow table of pieces (no ids) is written once.
2. Packing needs only how many pieces of each length there are: at most
   ``tokens`` numbers, whatever the corpus. Vector best-fit runs on that
   histogram, longest pieces first. Open sequences with the same residual vector
   (tokens, documents, attention cost) form one class; for each length the class
   that meets every constraint with the best score takes as many pieces as it
   has sequences. Score: the weighted dot product of the piece's demand and the
   residual (``rule="dot"``: largest), or the norm of what would be left
   (``rule="residual"``: smallest). Attention cost of a piece: its length
   squared.
3. The result is a short table of ranges: pieces number r0..r1 of one length go
   to sequences s0.. at one offset. Pieces are numbered within their length
   (skew-safe, so a length that a third of all pieces share is no problem), and
   a range join by (length, block of numbers) gives each piece its sequence.

With the default capacities only the token limit binds: at most ``tokens``
documents and ``tokens`` squared attention cost fit any sequence.

Defined results: NULL text counts as empty (the end id alone); repeated rows
and ids are separate documents; a NULL id is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import prepare, read, stored
from winnow.llm.token_ids import encoder
from winnow.operators.index import group_index

END_ID = 2
# Numbers of one length fall into blocks of this many, for the range join.
BLOCK = 4096


def pieces(docs: DataFrame, tokenizer: str, tokens: int, id_col: str = "doc_id", text_col: str = "text",
           end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                n = len(ids) // 4
                first = (n - 1) % tokens + 1
                starts = [0, *range(first, n, tokens)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    out.append((key, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], tokens: int, max_docs: int, max_cost: int,
             weights=(1.0, 0.0, 0.0), rule: str = "residual") -> list[tuple[int, int, int, int, int]]:
    """Pack ``counts`` pieces of each length: rows (length, first number, one
    past the last, first sequence, offset). Longest first; bounded by lengths
    and residual classes, not by the number of pieces."""
    scale = np.array([tokens, max_docs, max_cost], float)
    w = np.array(weights, float)
    # Residual vector -> ranges of sequences [from, to) in that state.
    open_: dict[tuple[int, int, int], list[list[int]]] = defaultdict(list)
    plan, made = [], 0
    for length in sorted(counts, reverse=True):
        need, at = counts[length], 0
        demand = np.array([length, 1, length * length], float)
        while need:
            states = np.array([s for s in open_], float).reshape(-1, 3)
            fits = np.flatnonzero((states >= demand).all(axis=1))
            if len(fits):
                left = (states[fits] - demand) / scale
                if rule == "dot":
                    score = -(states[fits] / scale * (demand / scale) * w).sum(axis=1)
                else:
                    score = np.sqrt((left * left * w).sum(axis=1))
                pick = fits[np.lexsort((states[fits, 2], states[fits, 1], states[fits, 0], score))[0]]
                state = tuple(int(x) for x in states[pick])
                spans = open_[state]
                a, b = spans.pop()
                n = min(need, b - a)
                if n < b - a:
                    spans.append([a + n, b])
                if not spans:
                    del open_[state]
                seq = a
            else:
                # No open sequence can take one: open as many as are needed
                # now; the rest of this length still fits beside each other.
                state, seq = (tokens, max_docs, max_cost), made
                together = max(1, min(tokens // length, max_docs, max_cost // (length * length)))
                n = -(-need // together)
                made += n
            plan.append((length, at, at + n, seq, tokens - state[0]))
            after = (state[0] - length, state[1] - 1, state[2] - length * length)
            if after[0] > 0 and after[1] > 0 and after[2] > 0:
                open_[after].append([seq, seq + n])
            need, at = need - n, at + n
    return plan


def pack(docs: DataFrame, tokenizer: str, tokens: int = 1024, max_docs: int | None = None,
         max_cost: int | None = None, weights=(1.0, 0.0, 0.0), rule: str = "residual",
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    prepare(spark)
    max_docs = max_docs or tokens
    max_cost = max_cost or tokens * tokens
    if max_cost < tokens * tokens:
        raise ValueError("one piece of full length must meet the attention capacity")
    table = stored(pieces(docs, tokenizer, tokens, id_col, text_col), "pack-pieces")
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, tokens, max_docs, max_cost, weights, rule)
    ranges = spark.createDataFrame(plan, "p_length long, r0 long, r1 long, s0 long, offset long")
    # A plan row meets the blocks of numbers it covers.
    ranges = ranges.select("*", F.explode(F.sequence(F.floor(F.col("r0") / BLOCK), F.floor((F.col("r1") - 1) / BLOCK)))
                           .alias("p_block"))
    numbered = group_index(table, ["length"], ["doc_id", "piece", "start", "ids_crc32"], out="number")
    numbered = numbered.withColumn("block", F.floor(F.col("number") / BLOCK))
    hit = ((numbered["length"] == ranges["p_length"]) & (numbered["block"] == ranges["p_block"])
           & (numbered["number"] >= ranges["r0"]) & (numbered["number"] < ranges["r1"]))
    return (numbered.join(ranges, hit)
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("s0") + F.col("number") - F.col("r0")).alias("sequence_id"), "offset"))


def byte_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), byte_bpe_path())
