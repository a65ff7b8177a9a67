"""Approximate nearest neighbours by a hierarchical k-means tree.

* Fit: the tree is fitted on a bounded sample of rows (``FIT_ROWS``, by hash of
  the id), splitting every node with more than its share of the sample into
  ``branching`` clusters. It holds centres only, at most ``MAX_LEAVES`` leaves, so it
  may be broadcast.
* Index: every row is sent to its leaf. A leaf is dealt out in as many shards as
  its counted rows need, so one that holds a third of all rows (one very common
  vector) spans many tasks.
* Search: best-bin-first. A query walks to a leaf, putting the branches it
  passes into a priority queue by distance to their centres, then goes on with
  the nearest branch. The number of leaves to visit is widened until the recall
  measured on sampled queries against brute force over the sample reaches
  ``target``. The sample is sparser than the rows it stands for, so its neighbours lie
  further out than theirs: the width errs to the wide side.
* Leaves next to each other in the tree form tiles. A query's vector goes once to
  each tile it visits, with the leaves it visits there, and leaves a tile as its k
  best. Each shard of a tile meets the tile's queries in blocks; the last step keeps
  the k best of those.
* Fast squares choose the rows whose distances are computed from the differences
  themselves, in double precision; the choice allows for the largest rounding error that
  squares can have at the norms of both vectors, so no neighbour in a visited leaf is
  lost. Ties go to the smaller id.

Defined results: vectors that are NULL, empty, of another length than most of
the sample, zero, or with NULL or non-finite components take no part as query or
candidate; a query meets every row but its own (id and vector); with fewer
candidates than k all are returned; repeated rows are separate candidates but
one query; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import prepare, read, stored

FIT_ROWS = 20_000
MAX_LEAVES = 4096
BRANCHING = 16
LEAF_ROWS = 40
TILE_LEAVES = 32
SHARD_ROWS = 20_000
BLOCK_QUERIES = 4_000
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.95
BLOCK = 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows of a x rows of b) from the differences themselves.
    Differences whose squares would leave the range of doubles are scaled by a power of two."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        with np.errstate(over="ignore", invalid="ignore"):
            d = b - a[i]
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        for beyond, part in ((~np.isfinite(out[i]), 0.5), (out[i] < 1e-140, 1.0)):
            if beyond.any():
                # Halves where a difference itself may be too large.
                d = b[beyond] * part - a[i] * part
                scale = np.ldexp(1.0, np.frexp(np.abs(d).max(axis=1))[1] - 1)
                d = d / scale[:, None]
                out[i, beyond] = np.sqrt(np.einsum("ij,ij->i", d, d)) * scale / part
    return out


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far :func:`_squares` may be off (rows of a x rows of b): rounding errors of sums of
    as many products as a vector has components, with both norms."""
    unit = 4 * (a.shape[1] + 4) * np.finfo(float).eps
    # Squares below the smallest doubles count as their own error.
    return unit * (np.sqrt((a * a).sum(1))[:, None] + np.sqrt((b * b).sum(1))[None]) ** 2 + 1e-290


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, fast; only for choosing branches."""
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return np.unique(centres, axis=0)


class Tree:
    """Inner nodes hold child centres and child numbers; a leaf is ~number."""

    def __init__(self, sample: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        # A power of two keeps squares within doubles; it changes no comparison.
        self.unit = float(np.ldexp(1.0, -int(np.frexp(np.abs(sample).max())[1])))
        sample = self.scaled(sample)
        leaf_rows = max(leaf_rows, -(-len(sample) * BRANCHING // MAX_LEAVES))
        self.root = self._grow(sample, leaf_rows, rng)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Vectors in the tree's unit; far outside the sample's range they end at its edge."""
        with np.errstate(over="ignore"):
            return np.clip(x * self.unit, -1e100, 1e100)

    def _grow(self, x: np.ndarray, leaf_rows: int, rng) -> int:
        if len(x) > leaf_rows:
            centres = _kmeans(x, min(BRANCHING, -(-len(x) // leaf_rows) + 1), rng)
            if len(centres) > 1:
                near = _squares(x, centres).argmin(axis=1)
                # Centres that rounding leaves without rows go.
                used, near = np.unique(near, return_inverse=True)
                centres = centres[used]
            if len(centres) > 1:
                number = len(self.nodes)
                self.nodes.append((centres, []))
                self.nodes[number] = (centres, [self._grow(x[near == c], leaf_rows, rng) for c in range(len(centres))])
                return number
        self.leaves += 1
        return ~(self.leaves - 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        x = self.scaled(x)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            centres, children = self.nodes[node]
            near = _squares(x[rows], centres).argmin(axis=1)
            todo += [(children[c], rows[near == c]) for c in np.unique(near)]
        return out

    def visits(self, q: np.ndarray, limit: int) -> list[int]:
        """Leaves in best-bin-first order, at most ``limit``."""
        queue, out, count = [(0.0, 0, self.root)], [], 0
        q = self.scaled(q)
        while queue and len(out) < limit:
            _, _, node = heapq.heappop(queue)
            while node >= 0:
                centres, children = self.nodes[node]
                d = ((centres - q) ** 2).sum(axis=1)
                first = int(d.argmin())
                for c in range(len(children)):
                    if c != first:
                        count += 1
                        heapq.heappush(queue, (float(d[c]), count, children[c]))
                node = children[first]
            out.append(~node)
        return out


def calibrate(tree: Tree, sample: np.ndarray, k: int, target: float = TARGET_RECALL) -> int:
    """Leaves to visit so that ``target`` of the true k nearest are in them,
    measured on sampled queries against every sampled row."""
    if len(sample) <= 1 or tree.leaves == 1:
        return tree.leaves
    queries = sample[:: max(1, len(sample) // CALIBRATION_QUERIES)]
    leaf = tree.assign(sample)
    ranks = []
    scaled = tree.scaled(sample)
    for q in queries:
        d = ((scaled - tree.scaled(q)) ** 2).sum(axis=1)
        true = leaf[np.argsort(d, kind="stable")[1:k + 1]]
        order = {x: i for i, x in enumerate(tree.visits(q, tree.leaves))}
        ranks += [order[x] for x in true.tolist()]
    ranks = np.sort(ranks)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def usable(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector is finite, complete and not zero, in doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (docs.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0))
            .where(~bad & F.exists("v", lambda x: x != 0)))


def nearest(docs: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            target: float = TARGET_RECALL, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS,
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows where ``is_query`` (a condition on
    ``id``) holds, against every other row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = usable(docs, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    rate = min(1.0, fit_rows / total) if total else 1.0
    picked = rows.where(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(int(rate * (1 << 40))))
    # Repeated ids share a hash: the limit holds the bound for them as well.
    sample = [r.v for r in picked.limit(2 * fit_rows).collect()]
    if not sample:
        sample = [r.v for r in rows.limit(1).collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    sizes = [len(v) for v in sample]
    size = max(set(sizes), key=sizes.count)
    sample = np.array([v for v in sample if len(v) == size])
    rows = rows.where(F.size("v") == size)
    tree = Tree(sample, leaf_rows)
    width = calibrate(tree, sample, k, target)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "v", "leaf"])

    def route(batches):
        for batch in batches:
            at, tiles, lists = [], [], []
            for row, q in enumerate(_matrix(batch.column(1), size)):
                leaves = np.sort(shared.value.visits(q, width))
                for part in np.split(leaves, np.flatnonzero(np.diff(leaves // TILE_LEAVES)) + 1):
                    at.append(row)
                    tiles.append(int(part[0]) // TILE_LEAVES)
                    lists.append(part)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at),
                 pa.array(tiles, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["id", "v", "number", "tile", "leaves"])

    index = stored(rows.mapInArrow(place, "id long, v array<double>, leaf long")
                   .withColumn("tile", F.floor(F.col("leaf") / TILE_LEAVES)), "ann-index")
    # Repeated query rows are one query; its number stands for id and vector.
    asked = stored(rows.where(is_query).dropDuplicates(["id", "v"])
                   .withColumn("number", F.monotonically_increasing_id()), "ann-asked")
    routed = stored(asked.mapInArrow(
        route, "id long, v array<double>, number long, tile long, leaves array<long>"), "ann-queries")
    # One row per tile: bounded like the tree, so it may be broadcast. A tile's
    # rows are dealt into shards and its queries into blocks; each shard meets
    # each block in a task of its own.
    deal = (index.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
            .join(routed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks")), "tile"))
    deal = F.broadcast(deal)
    dealt = index.join(deal, "tile").select(
        "tile", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "leaf", "id", "v")
    queries = routed.join(deal, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int").alias("block"), "leaves", "number", "id", "v")
    best = _best_in_shards(dealt, queries, size, k)
    order = Window.partitionBy("number").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _best_in_shards(dealt: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    """(query_id, number, vec_id, score): the k best of each query in each shard."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("leaf")
        leaf = np.asarray(left.column("leaf").combine_chunks())
        names, starts = np.unique(leaf, return_index=True)
        ends = np.append(starts[1:], len(leaf))
        ids = np.asarray(left.column("id").combine_chunks().fill_null(-1))
        null = np.asarray(left.column("id").combine_chunks().is_null())
        x = _matrix(left.column("v").combine_chunks(), size)
        q = _matrix(right.column("v").combine_chunks(), size)
        q_ids = right.column("id").to_pylist()
        numbers = np.asarray(right.column("number").combine_chunks())
        visited = right.column("leaves").to_pylist()
        out_q, out_n, out_i, out_s = [], [], [], []
        for at in range(0, len(q), BLOCK):
            block = q[at:at + BLOCK]
            # [low, high] holds the square; rows of leaves not visited stay out.
            low = np.full((len(block), len(x)), np.inf)
            high = np.full((len(block), len(x)), np.inf)
            askers: dict[int, list[int]] = {}
            for n, leaves in enumerate(visited[at:at + BLOCK]):
                for one in leaves:
                    askers.setdefault(one, []).append(n)
            for name, start, end in zip(names.tolist(), starts.tolist(), ends.tolist()):
                asking = askers.get(name)
                if asking:
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = _squares(block[asking], x[start:end])
                        off = slack(block[asking], x[start:end])
                        low[asking, start:end] = np.nan_to_num(rough - off, nan=-np.inf, posinf=0.0)
                        high[asking, start:end] = np.nan_to_num(rough + off, nan=np.inf)
            keep = min(len(x), k + 1)
            for n in range(len(block)):
                # The k nearest and the own row lie at or below this edge.
                edge = np.partition(high[n], keep - 1)[keep - 1]
                near = np.flatnonzero((low[n] <= edge) & (low[n] < np.inf))
                d = distances(block[n:n + 1], x[near])[0]
                order = np.lexsort((ids[near], d))
                own, taken = False, 0
                for j in order.tolist():
                    row = near[j]
                    candidate = None if null[row] else int(ids[row])
                    if not own and d[j] == 0.0 and q_ids[at + n] == candidate:
                        own = True  # the query's own row, once
                        continue
                    out_q.append(q_ids[at + n])
                    out_n.append(int(numbers[at + n]))
                    out_i.append(candidate)
                    out_s.append(float(d[j]))
                    taken += 1
                    if taken == k:
                        break
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "number": pa.array(out_n, pa.int64()),
                         "vec_id": pa.array(out_i, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return (dealt.groupBy("tile", "shard", "block").cogroup(queries.groupBy("tile", "shard", "block"))
            .applyInArrow(search, "query_id long, number long, vec_id long, score double"))


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
