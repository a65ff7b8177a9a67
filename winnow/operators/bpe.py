"""Byte-level BPE: pre-token counts, vocabulary training, encoding.

Pre-tokens come from the GPT-2 style split (letters, digits, other runs,
with one leading blank; blank runs) applied with a Java regex; each
pre-token's UTF-8 bytes become byte-level symbols (printable bytes keep their
code point, the other 68 bytes map to 256 + their order). The vocabulary is
the special tokens, then the symbols seen (sorted by code point), then one
entry per merge.

Training works on the *distinct* words with their counts, dealt out once and
never shuffled again, packed by the batch. A word is a string with one character per
symbol, so a merge is a string replacement (left to right, not overlapping). The
driver holds the pair counts - bounded by the vocabulary squared - in a heap and
proposes the next few merges; one narrow job finds the words that hold any of them
in the packed symbols, applies them in turn to those alone and returns, per merge,
what it changed in the counts. The driver replays the
changes and commits the proposals as long as each still is the best pair
(highest count, then lowest (left id, right id)); so the merges are those of a
run with one round per merge, in far fewer jobs. Every ``REWRITE_EVERY`` merges
the words are checkpointed in their current form.

Encoding is one pass over the texts without a shuffle: an Arrow UDF looks each
distinct pre-token of a batch up in a memory that a worker keeps (bounded, words in
use stay), encodes new ones and puts the ids of all pre-tokens together at once. A
total of tokens needs no ids of texts: it comes from the distinct pre-tokens.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.tokens import SPECIAL_TOKENS, UNK_ID
from winnow.session import checkpoint_dir, materialize, ship_package, shuffle_width

# Fixed value: the byte-level pre-token pattern (GPT-2 style), with Java's
# (?U) so \s, \p{L}, \p{N} are Unicode classes.
PRETOKEN_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: entries of the trained vocabulary.
VOCAB_SIZE = 2048
REWRITE_EVERY = 48
PROPOSALS = 24
# Pre-tokens a worker remembers while encoding.
REMEMBERED_WORDS = 100_000
# Symbol id -> one character of a word string (private use planes).
FIRST_SYMBOL = 0xF0000
# Behind each packed word, and the packed form: many words a row.
END = chr(FIRST_SYMBOL - 1)
PACKED = "s binary, n binary"
PACK_SYMBOLS = 1 << 20


def _printable(b: int) -> bool:
    return 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255


def byte_symbol(b: int) -> int:
    """Code point of the byte-level character for byte ``b`` (rule, not table)."""
    if _printable(b):
        return b
    return 256 + sum(1 for x in range(b) if not _printable(x))


def pretokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(PRETOKEN_PATTERN), F.lit(0))


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): pre-token frequencies over all texts (skips NULL/empty)."""
    words = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.explode(pretokens(text)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _packed(words: list[str], counts) -> pa.RecordBatch:
    """One row: the words as UTF-32, each with ``END`` behind it, and their counts.
    Words of one symbol hold no pair and go."""
    kept = [(w, n) for w, n in zip(words, counts) if len(w) > 1]
    text = "".join([w + END for w, _ in kept])
    return pa.RecordBatch.from_arrays([pa.array([text.encode("utf-32-le")], pa.binary()),
                                       pa.array([np.array([n for _, n in kept], "<i8").tobytes()], pa.binary())], ["s", "n"])


def _unpacked(batches) -> Iterator[tuple[bytes, np.ndarray]]:
    for batch in batches:
        for s, n in zip(*[c.to_pylist() for c in batch.columns]):
            yield s, np.frombuffer(n, "<i8")


def _codes(packed: bytes) -> np.ndarray:
    """The symbols of packed words, from 1; 0 ends a word."""
    return np.frombuffer(packed, "<u4") - np.uint32(ord(END))


def _code(symbol: str) -> int:
    return ord(symbol) - ord(END)


def _numbers_holding(ids: np.ndarray, ends: np.ndarray, pairs: list[str]) -> np.ndarray:
    """Numbers of the words that hold one of the pairs. Merges of these pairs, one
    after the other, leave every other word as it is."""
    if not len(ids) or not pairs:
        return np.zeros(0, np.int64)
    wanted = np.array([[_code(a), _code(b)] for a, b in pairs], "i8")
    size = max(int(ids.max()), int(wanted.max())) + 1
    left, right = np.zeros(size, bool), np.zeros(size, bool)
    left[wanted[:, 0]], right[wanted[:, 1]] = True, True
    at = np.flatnonzero(left[ids[:-1]] & right[ids[1:]])
    at = at[np.isin(ids[at].astype("i8") * size + ids[at + 1], wanted[:, 0] * size + wanted[:, 1])]
    return np.unique(np.searchsorted(ends, at))


def _holding(packed: bytes, pairs: list[str]) -> Iterator[tuple[int, str]]:
    """(number, word) of the packed words that hold one of the pairs."""
    ids = _codes(packed)
    ends = np.flatnonzero(ids == 0)
    for i in _numbers_holding(ids, ends, pairs).tolist():
        start = int(ends[i - 1]) + 1 if i else 0
        yield i, packed[4 * start:4 * int(ends[i])].decode("utf-32-le")


def _held(packed: bytes, counts: np.ndarray, pairs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words that hold one of the pairs, a 0 before the first and behind
    each word, and at each place the count of its word."""
    ids = _codes(packed)
    ends = np.flatnonzero(ids == 0)
    chosen = np.zeros(len(ends), bool)
    chosen[_numbers_holding(ids, ends, pairs)] = True
    size = np.diff(ends, prepend=-1)
    return (np.concatenate(([0], ids[np.repeat(chosen, size)])).astype(np.uint32),
            np.concatenate(([0], np.repeat(counts[chosen], size[chosen]))))


def _places(ids: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where a merge of (a, b) applies: left to right, not overlapping."""
    at = np.flatnonzero(ids[:-1] == a)
    at = at[ids[at + 1] == b]
    if a == b and len(at):
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
    return at


def _sums(left, right, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with its sum; sums of 0 go."""
    code = left.astype("i8") << 32 | right.astype("i8")
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    total = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, "i8")
    code, total = code[first][total != 0], total[total != 0]
    return code >> 32, code & 0xFFFFFFFF, total


def _beside(ids: np.ndarray, n: np.ndarray, at: np.ndarray, sign: int):
    """The pairs that begin at these places, inside words."""
    at = np.unique(at)
    at = at[(ids[at] > 0) & (ids[at + 1] > 0)]
    return ids[at], ids[at + 1], sign * n[at]


def _merge(ids: np.ndarray, n: np.ndarray, pair: str, new: str, changes: list | None = None):
    """Symbols and counts (see :func:`_held`) after a merge; what it changes in the pair
    counts goes to ``changes``. Only pairs beside a merged place change."""
    at = _places(ids, _code(pair[0]), _code(pair[1]))
    if not len(at):
        return ids, n
    if changes is not None:
        gone = _beside(ids, n, np.concatenate((at - 1, at, at + 1)), -1)
    keep = np.ones(len(ids), bool)
    keep[at + 1] = False
    ids[at] = _code(new)
    ids, n = ids[keep], n[keep]
    if changes is not None:
        now = at - np.arange(len(at))
        come = _beside(ids, n, np.concatenate((now - 1, now)), 1)
        changes.append(_sums(*map(np.concatenate, zip(gone, come))))
        if len(changes) > 16:
            changes[:] = [_sums(*map(np.concatenate, zip(*changes)))]
    return ids, n


def _pair_totals(words: DataFrame) -> dict:
    """(left, right) characters -> weighted count over all words."""
    def run(batches):
        found = [(np.zeros(0, "i8"),) * 3]
        for s, counts in _unpacked(batches):
            ids = _codes(s)
            n = np.repeat(counts, np.diff(np.flatnonzero(ids == 0), prepend=-1))
            inside = (ids[:-1] > 0) & (ids[1:] > 0)
            found.append(_sums(ids[:-1][inside], ids[1:][inside], n[:-1][inside]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _sums(*map(np.concatenate, zip(*found)))], ["a", "b", "n"])
    rows = words.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(chr(ord(END) + r.a), chr(ord(END) + r.b)): r.n for r in rows}


def _merge_changes(words: DataFrame, done: list[tuple[str, str]], next_: list[tuple[str, str]]) -> Iterator[Counter]:
    """Apply ``done`` and then each of ``next_`` (pair string, new character);
    what each of the latter changed in the pair counts."""
    def run(batches):
        pairs = [pair for pair, _ in done + next_]
        changes = [[(np.zeros(0, "i8"),) * 3] for _ in next_]
        for s, counts in _unpacked(batches):
            ids, n = _held(s, counts, pairs)
            for pair, new in done:
                ids, n = _merge(ids, n, pair, new)
            for change, (pair, new) in zip(changes, next_):
                ids, n = _merge(ids, n, pair, new, change)
        sums = [_sums(*map(np.concatenate, zip(*c))) for c in changes]
        at = np.repeat(np.arange(len(sums)), [len(c[0]) for c in sums])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, *map(np.concatenate, zip(*sums)))], ["i", "a", "b", "n"])
    # One row per task and changed pair: at most tasks x vocabulary x proposals.
    found = words.mapInArrow(run, "i long, a long, b long, n long").toArrow()
    i, *columns = [c.to_numpy() for c in found.columns]
    for k in range(len(next_)):
        a, b, n = [c.tolist() for c in _sums(*[c[i == k] for c in columns])]
        yield Counter({(chr(ord(END) + x), chr(ord(END) + y)): z for x, y, z in zip(a, b, n)})


def _rewritten(words: DataFrame, done: list[tuple[str, str]]) -> DataFrame:
    def run(batches):
        for s, counts in _unpacked(batches):
            ids = np.concatenate(([0], _codes(s))).astype(np.uint32)
            n = np.concatenate(([0], np.repeat(counts, np.diff(np.flatnonzero(ids == 0)))))
            for pair, new in done:
                ids, n = _merge(ids, n, pair, new)
            ends = np.flatnonzero(ids == 0)
            size = np.diff(ends)
            kept = size > 2  # the end and two symbols
            s = ids[1:][np.repeat(kept, size)] + np.uint32(ord(END))
            yield pa.RecordBatch.from_arrays([pa.array([s.astype("<u4").tobytes()], pa.binary()),
                                              pa.array([n[ends[1:][kept]].astype("<i8").tobytes()], pa.binary())], ["s", "n"])
    return words.mapInArrow(run, PACKED).checkpoint(eager=True)


class PairCounts:
    """The pair counts and their order: highest count first, then lowest ids. Entries
    of the heap whose count has changed since are passed over."""

    def __init__(self, totals: dict):
        self.totals = totals
        self._sort()

    def _sort(self) -> None:
        self.heap = [(-n, a, b) for (a, b), n in self.totals.items() if n > 0]
        heapq.heapify(self.heap)

    def best(self, limit: int) -> list[tuple[str, str]]:
        found: list[tuple] = []
        while self.heap and len(found) < limit:
            entry = heapq.heappop(self.heap)
            if self.totals.get(entry[1:]) == -entry[0] and (not found or entry != found[-1]):
                found.append(entry)
        for entry in found:
            heapq.heappush(self.heap, entry)
        return [entry[1:] for entry in found]

    def add(self, change: Counter) -> None:
        for p, n in change.items():
            now = self.totals.get(p, 0) + n
            if not now:
                self.totals.pop(p, None)
                continue
            self.totals[p] = now
            if n and now > 0:
                heapq.heappush(self.heap, (-now, *p))
        if len(self.heap) > 2 * len(self.totals) + 1000:
            self._sort()


def bpe_train(spark: SparkSession, counts: DataFrame, vocab_size: int | None = None,
              num_merges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Learn a vocabulary of ``vocab_size`` entries (or specials + alphabet +
    ``num_merges``) from (word, n) counts.

    Returns (vocab(token STRING, id INT), merges(rank INT, left STRING, right STRING)).
    """
    ship_package(spark)
    checkpoint_dir(spark)
    symbols = [byte_symbol(b) for b in range(256)]
    # Written once: the alphabet and the words both read them.
    counts = materialize(counts.select("word", F.col("n").cast("long").alias("n")), "bpe_counts")
    seen = counts.select(F.explode(F.array_distinct(F.split(F.hex(F.encode("word", "utf-8")), "(?<=\\G..)"))).alias("h"))
    alphabet = sorted(symbols[int(r.h, 16)] for r in seen.where("h != ''").distinct().collect())
    id_to_token: list[str] = list(SPECIAL_TOKENS) + [chr(x) for x in alphabet]
    token_to_id = {t: i for i, t in enumerate(id_to_token)}
    letter = [chr(FIRST_SYMBOL + token_to_id.get(chr(x), UNK_ID)) for x in symbols]

    def spell(batches):
        words, times, size = [], [], 0
        for batch in batches:
            for w, n in zip(*[c.to_pylist() for c in batch.columns]):
                words.append("".join([letter[b] for b in w.encode()]))
                times.append(n)
                size += len(words[-1]) + 1
                if size >= PACK_SYMBOLS:
                    yield _packed(words, times)
                    words, times, size = [], [], 0
        yield _packed(words, times)

    # Hundreds of short jobs read the words: no more tasks than there is work for.
    tasks = min(shuffle_width(spark), 2 * spark.sparkContext.defaultParallelism)
    words = counts.repartition(tasks, "word").mapInArrow(spell, PACKED).checkpoint(eager=True)
    totals = PairCounts(_pair_totals(words))
    if vocab_size is None:
        vocab_size = len(id_to_token) + (num_merges or 0)
    merges: list[tuple[int, str, str]] = []
    done: list[tuple[str, str]] = []
    while len(id_to_token) < vocab_size:
        picks = totals.best(min(PROPOSALS, vocab_size - len(id_to_token)))
        if not picks:
            break
        proposals, names = [], dict(token_to_id)
        for a, b in picks:
            token = id_to_token[ord(a) - FIRST_SYMBOL] + id_to_token[ord(b) - FIRST_SYMBOL]
            names.setdefault(token, len(names))
            proposals.append((a + b, chr(FIRST_SYMBOL + names[token])))
        changes = _merge_changes(words, done, proposals)
        for (a, b), (pair, new), change in zip(picks, proposals, changes):
            if totals.best(1) != [(a, b)]:
                break
            token = id_to_token[ord(a) - FIRST_SYMBOL] + id_to_token[ord(b) - FIRST_SYMBOL]
            if token not in token_to_id:
                if ord(new) - FIRST_SYMBOL != len(id_to_token):
                    break
                token_to_id[token] = len(id_to_token)
                id_to_token.append(token)
            merges.append((len(merges), id_to_token[ord(a) - FIRST_SYMBOL], id_to_token[ord(b) - FIRST_SYMBOL]))
            done.append((pair, new))
            totals.add(change)
        if len(done) >= REWRITE_EVERY:
            words, done = _rewritten(words, done), []
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(id_to_token)], "token string, id int")
    merge_df = spark.createDataFrame(merges, "rank int, left string, right string")
    return vocab, merge_df


class WordEncoder:
    """Pre-token -> ids with a trained vocabulary, remembering what it met lately."""

    def __init__(self, token_to_id: dict, merges: list[tuple[str, str]]):
        self.ids = token_to_id
        self.letter = [chr(FIRST_SYMBOL + token_to_id.get(chr(byte_symbol(b)), UNK_ID)) for b in range(256)]
        code = {t: chr(FIRST_SYMBOL + i) for t, i in token_to_id.items()}
        self.rules = [(code[a] + code[b], code[a + b]) for a, b in merges]
        self.rank = {pair: rank for rank, (pair, _) in reversed(list(enumerate(self.rules)))}
        # Two generations: a word met again moves to the newer one, the older one goes.
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def encode(self, word: str) -> list[int]:
        s = "".join([self.letter[b] for b in word.encode()])
        none = len(self.rules)
        while len(s) > 1:
            # The lowest-rank merge first, everywhere in the word.
            rank = min(map(self.rank.get, map(add, s, s[1:]), repeat(none)))
            if rank == none:
                break
            s = s.replace(*self.rules[rank])
        return [ord(c) - FIRST_SYMBOL for c in s]

    def word_ids(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self.encode(word)
            if len(self.known) >= REMEMBERED_WORDS // 2:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def __call__(self, words) -> list[int]:
        return list(chain.from_iterable(map(self.word_ids, words)))

    def lists(self, words: pa.ListArray) -> pa.ListArray:
        """The ids of each list of pre-tokens; each distinct one is looked up once."""
        found = words.flatten().dictionary_encode()
        ids = [self.word_ids(w) for w in found.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        table = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        at = found.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = table[np.repeat((np.cumsum(size) - size)[at] - ends[:-1], n) + np.arange(ends[-1])]
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(flat, pa.int32()))


def bpe_tokenizer(vocab: DataFrame, merges: DataFrame):
    """Column function text -> ids, for every place that takes a tokenizer (role
    masks, reports). The vocabulary and merges are bounded by the vocabulary
    size; they are collected once and broadcast. Its ``total(texts, text)`` is the
    one-row frame of :func:`bpe_token_total`."""
    spark = vocab.sparkSession
    ship_package(spark)
    table = ({r.token: int(r.id) for r in vocab.collect()},
             [(r.left, r.right) for r in merges.orderBy("rank").collect()])
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: "Iterator[pa.Array]") -> "Iterator[pa.Array]":
        enc = WordEncoder(*shared.value)
        for words in batches:
            yield enc.lists(words)

    def tokenize(text) -> Column:
        return encode(F.coalesce(pretokens(text), F.array().cast("array<string>")))

    def total(texts: DataFrame, text: str = "text") -> DataFrame:
        # Each distinct pre-token is encoded once, wherever it occurs. Dealt out again: small
        # rows, but work for all tasks.
        tokens = F.size(encode(F.array("word"))).cast("long") * F.col("n")
        return (word_counts(texts, text).repartition(shuffle_width(spark), "word").select(tokens.alias("t"))
                .agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("total_tokens")))

    tokenize.total = total
    return tokenize


def bpe_encode(texts: DataFrame, vocab: DataFrame, merges: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>) for each text; NULL and empty texts have no ids.
    One pass over the texts, no shuffle."""
    return texts.select(key, bpe_tokenizer(vocab, merges)(text).alias("ids"))


def bpe_token_total(texts: DataFrame, vocab: DataFrame, merges: DataFrame, text: str = "text") -> DataFrame:
    """One row: total BPE tokens over all texts."""
    return bpe_tokenizer(vocab, merges).total(texts, text)


def save_vocab(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """vocab_store: two parquet tables under ``path``."""
    vocab.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    merges.coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")
