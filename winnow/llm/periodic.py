"""Periodic runs of words: stretches that repeat themselves at least three times.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) and a length of at least ``max(min_length, min_exponent * q)`` that no
neighbouring word extends with period q.

Method, for one text as a sequence of word numbers:

1. Ukkonen's algorithm builds the suffix tree of the sequence and that of its
   reversal. An Euler tour of each tree with a sparse table of the least depths
   gives the lowest common ancestor of two leaves, so the longest common extension
   of two positions, in constant time: forwards from one tree, backwards from the
   other.
2. Candidates are Lyndon roots. Every run with period q holds, for one of the two
   orders of the alphabet, a Lyndon word of length q that is the longest one
   starting at its place. The longest Lyndon word at i ends before the next
   smaller suffix; suffix ranks are the order of the tree's leaves with children
   sorted by their first word (by either order, a suffix before its extensions).
3. Each candidate (i, q) is extended to both sides as far as words q apart are
   equal. Roots are primitive, so q is the smallest period of a stretch of at
   least 2q. Stretches long enough are the runs, each found from several roots.

Before that, words are left out that no run can hold. In a run of at least
``min_length`` = 24 words and three periods every 9 words come again one period
on or back, within the run. So only stretches of 24 or more words whose
9-word hashes all come twice within the stretch are kept, again and again until
nothing changes; hashes of equal words are equal, so no run is lost, and ordinary
prose costs one sort a text. (The 9 follows from the parameters, see ``gram``.)

Memory is that of one text: a tree holds at most two nodes a word.

Defined results: NULL, empty and blank texts have no words and no runs; a NULL id
is kept; repeated rows repeat in the result; an empty table gives an empty result;
other columns are ignored, whatever their names. In the query a NULL id changes
no word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import blobs, prepare, read, runs

MIN_LENGTH = 24
MIN_EXPONENT = 3
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class SuffixTree:
    """Ukkonen's suffix tree of a list of non-negative integers; the end of the
    list is a symbol of its own (-1), so every suffix is a leaf."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]
        self.text, n = text, len(text)
        # Node 0 is the root. An edge is kept with its lower node: text[start:end].
        start, end, link, children = [0], [0], [0], [{}]
        node, edge, length, waiting = 0, 0, 0, 0
        for at, symbol in enumerate(text):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = at
                below = children[node].get(text[edge])
                if below is None:
                    children[node][symbol] = len(start)
                    start.append(at), end.append(n), link.append(0), children.append(None)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = min(end[below], at + 1) - start[below]
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    if text[start[below] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    upper = len(start)
                    start.append(start[below]), end.append(start[below] + length), link.append(0)
                    children.append({text[start[below] + length]: below, symbol: upper + 1})
                    children[node][text[start[below]]] = upper
                    start[below] += length
                    start.append(at), end.append(n), link.append(0), children.append(None)
                    if last:
                        link[last] = upper
                    last = upper
                waiting -= 1
                if node == 0 and length:
                    length -= 1
                    edge = at - waiting + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.children = start, end, children

    def leaves(self, descending: bool = False) -> np.ndarray:
        """Starts of the suffixes in lexicographic order of the words (or of the
        words in opposite order); the end comes before every word either way."""
        start, end, children, n = self.start, self.end, self.children, len(self.text)
        out, stack = [], [(0, 0)]
        while stack:
            node, depth = stack.pop()
            below = children[node]
            if below is None:
                out.append(n - depth)
                continue
            order = sorted(below)
            if descending:
                # The end (-1) first, then the largest word.
                order = order[:1] + order[:0:-1] if order[0] < 0 else order[::-1]
            for symbol in reversed(order):
                child = below[symbol]
                stack.append((child, depth + end[child] - start[child]))
        return np.array(out, np.int64)

    def extensions(self) -> "Extensions":
        """Longest common extensions, from an Euler tour of the tree."""
        start, end, children, n = self.start, self.end, self.children, len(self.text)
        tour, place = [], [0] * n
        stack = [(0, 0, False)]
        # A node's depth in words is written when it is entered and again after
        # each child; the least between two leaves is that of their common ancestor.
        while stack:
            node, depth, again = stack.pop()
            below = None if again else children[node]
            if below is None:
                if not again:
                    place[n - depth] = len(tour)
                tour.append(depth)
                continue
            tour.append(depth)
            for child in below.values():
                stack.append((node, depth, True))
                stack.append((child, depth + end[child] - start[child], False))
        return Extensions(np.array(tour, np.int32), np.array(place, np.int64))


class Extensions:
    """Constant-time least value between two places of a tour (sparse table)."""

    def __init__(self, tour: np.ndarray, place: np.ndarray):
        self.place, self.table, width = place, [tour], 1
        while 2 * width <= len(tour):
            row = self.table[-1]
            self.table.append(np.minimum(row[:-width], row[width:]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and at j (i != j);
        the position after the last word is the empty suffix."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(k)) + 1])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix the next one that is smaller (the end, if none)."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def lyndon_roots(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest Lyndon word at each position, for both orders."""
    n = len(tree.text) - 1
    starts, sizes = [], []
    for descending in (False, True):
        rank = np.empty(n + 1, np.int64)
        rank[tree.leaves(descending)] = np.arange(n + 1)
        starts.append(np.arange(n))
        sizes.append(_next_smaller(rank[:n].tolist()) - starts[-1])
    return np.concatenate(starts), np.concatenate(sizes)


def find_runs(symbols: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, ascending."""
    n = len(symbols)
    if n < 2:
        return []
    tree = SuffixTree(symbols)
    i, q = lyndon_roots(tree)
    forward = tree.extensions()
    backward = SuffixTree(symbols[::-1]).extensions()
    # The root is symbols[i:i + q]: how far on do words q apart agree, how far back?
    right = forward.common(i, i + q)
    left = backward.common(n - i, n - i - q)
    start, length = i - left, left + q + right
    good = (length >= min_length) & (length >= min_exponent * q) & (length >= 2 * q)
    return sorted(set(zip(start[good].tolist(), length[good].tolist(), q[good].tolist())))


def gram(min_length: int, min_exponent: int) -> int:
    """The most consecutive words that must come again within any run, one period
    on or back: length - 2q + 1 at the least, over all periods q."""
    return min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1))


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Stretches (start, end) outside of which no run has a word."""
    k = gram(min_length, min_exponent)
    if k < 2 or len(ids) < min_length:
        return [(0, len(ids))] if len(ids) >= max(2, min_length) else []
    h = ids.astype(np.uint64) * _C1
    size = 1
    with np.errstate(over="ignore"):
        while size < k:
            # Windows of twice the size, or overlapping ones at the last step.
            step = min(size, k - size)
            h = (h[:-step] * _C2) ^ (h[step:] + (h[:-step] >> np.uint64(29))) * _C1
            size += step
    found = [(0, len(ids))]
    while found:
        # Which hashes come twice within their stretch?
        at = np.concatenate([np.arange(a, b - k + 1) for a, b in found])
        label = np.repeat(np.arange(len(found)), [b - a - k + 1 for a, b in found])
        order = np.lexsort((h[at], label)) if len(found) > 1 else np.argsort(h[at], kind="stable")
        value, group = h[at][order], label[order]
        equal = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        if twice.all():
            return found
        flag = np.zeros(len(ids), np.int64)
        flag[at[twice]] = label[twice] + 1
        a, b = runs(flag)
        left = [(int(x), int(y) + k - 1) for x, y in zip(a, b) if flag[x] and y - x + k - 1 >= min_length]
        found = left
    return []


def text_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Runs of a text's words; equal words, equal numbers."""
    if len(words) < min_length:
        return []
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))
    out = []
    for a, b in stretches(ids, min_length, min_exponent):
        out += [(a + s, n, q) for s, n, q in find_runs(ids[a:b].tolist(), min_length, min_exponent)]
    return sorted(out)


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that some run holds after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT, edit: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per input row: the runs of the
    words ``[^\\x20\\x09-\\x0D]+`` by start and period, and the words that no run
    repeats, joined by one blank. ``edit(id, words)`` may change the words first."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            sizes, found, kept = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                # bytes.split cuts at exactly these blanks.
                words = text.split()
                if edit is not None:
                    words = edit(key, words)
                own = text_runs(words, min_length, min_exponent)
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                kept.append(b" ".join(kept_words(words, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_period(key: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: a tenth of the documents, by their id, end periodically."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[:n - a]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(read(spark, sf_dir, "documents"), edit=with_period)

    # Exact: lengths times periods stay far below 2^63, and no quotient is rounded.
    def better(x, best):
        more, tie = x["length"] * best["period"], best["length"] * x["period"]
        earlier = (x["start"] < best["start"]) | ((x["start"] == best["start"]) & (x["period"] < best["period"]))
        return best.isNull() | (more > tie) | ((more == tie) & earlier)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda acc, x: F.when(better(x, acc), x).otherwise(acc))
    line = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    told = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                      sha(F.array_join(line, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
