"""SimHash near-duplicates through a segment-popcount grid.

1. Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, n-word
   shingles (repeats included), XXH64 with seed 42 of each; bit i is 1 when set
   in over half the hashes.
2. Embedding: the 64 bits are 16 segments of 4; a fingerprint becomes the
   vector of the segments' bit counts (0..4). The Manhattan distance of two
   vectors is at most the fingerprints' bit distance.
3. Grid range join: integer vectors at Manhattan distance d have a lattice point
   within ceil(d/2) of the one and floor(d/2) of the other. So each distinct
   fingerprint is sent to the grid cells within ceil(max_bits / 2) of its
   vector, and fingerprints that meet in a cell are candidates.
4. Each candidate pair is verified on the bits themselves (XOR, bit count).
5. Links between distinct fingerprints become components by alternating
   large-star and small-star rounds; the label is the smallest document id.

Equal texts share a fingerprint, so a group of exact copies - however large -
is one node, and its members come back by a join on the fingerprint. The 2-bit
ball around a fingerprint bounds its links; no link is left out.

Defined results: NULL or blank text has fingerprint zero, linked like any
other; fewer words than the shingle length give one shingle of all words; a
NULL id gets a component like any row but never names one unless every id of
the component is NULL; repeated rows repeat in the result; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import blobs, prepare, read, same, stored

SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def text_sha(text: Column) -> Column:
    """What, with the id, tells rows that repeat an id apart (NULL counts as empty)."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 hashed: bool = False) -> DataFrame:
    """(id, fp): one row per document, ``fp`` the fingerprint as a signed long;
    where ``hashed``, (id, fp, sha) with the text's hash."""
    sha = [text_sha(F.col(text_col)).alias("sha")] if hashed else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *sha)
    names = ["id", "fp", "sha"][:2 + hashed]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in blobs(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names)

    return rows.mapInArrow(run, "id long, fp long" + ", sha string" * hashed)


def _embedded(fp):
    """Bit counts of the 16 segments, one nibble each (at most 4: no carry)."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(1, SEGMENT_BITS)), fp.bitwiseAND(ones))


def _steps(cells: DataFrame) -> DataFrame:
    """Each cell and its neighbours at Manhattan distance 1 inside the grid."""
    def moved(i: int):
        unit = F.lit(1 << (SEGMENT_BITS * i))
        count = F.shiftrightunsigned("cell", SEGMENT_BITS * i).bitwiseAND(F.lit(15))
        return [F.when(count < SEGMENT_BITS, F.col("cell") + unit), F.when(count > 0, F.col("cell") - unit)]
    near = F.array(F.col("cell"), *[c for i in range(SEGMENTS) for c in moved(i)])
    return cells.select("fp", F.explode(F.array_compact(near)).alias("cell"))


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at most ``max_bits`` apart.

    Each fingerprint comes to 33 cells or more, but Spark sizes the cells as the
    fingerprints they are made of, so it would send them to the driver to broadcast:
    the cells are always shuffled."""
    cells = distinct.select("fp", _embedded(F.col("fp")).alias("cell"))
    for _ in range((max_bits + 1) // 2):
        cells = _steps(cells).distinct() if max_bits > 2 else _steps(cells)
    left, right = cells.select(F.col("fp").alias("a"), "cell"), cells.select(F.col("fp").alias("b"), "cell")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return left.hint("merge").join(right, "cell").where(near).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) links, root = smallest node.
    Alternates large-star and small-star; each round's links are checkpointed
    and the rounds end when no link changes."""
    edges = links.select("a", "b").checkpoint(eager=True)
    total = None
    while True:
        # Large star: every larger neighbour of a node links to the smallest one.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        # Small star: a node and its smaller neighbours link to the smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        edges = edges.checkpoint(eager=True)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == tuple(now):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        total = tuple(now)


def _component_labels(marked: DataFrame, of_row: Column, max_bits: int) -> DataFrame:
    """(label_fp, label): for each fingerprint the least ``of_row`` of its component."""
    nodes = stored(marked.groupBy("fp").agg(F.min(of_row).alias("low")), "simhash-nodes")
    tree = components(fingerprint_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(tree, nodes["fp"] == tree["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("label"))
    return rooted.join(names, "root").select(F.col("fp").alias("label_fp"), "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    prepare(docs.sparkSession)
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    labels = _component_labels(marked, F.col("id"), max_bits)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return (marked.join(labels, marked["fp"] == labels["label_fp"])
            .select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("label").alias("component_id")))


def near_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, text_sha, stays), one row per input row: of each component the
    row with the smallest id stays - a NULL id after every other, equal ids by
    the smaller text hash - together with the rows that repeat its id and text."""
    prepare(docs.sparkSession)
    marked = stored(fingerprints(docs, id_col, text_col, shingle, hashed=True), "simhash-fp")
    labels = _component_labels(marked, F.struct(F.isnull("id").alias("no_id"), "id", "sha"), max_bits)
    stays = same(F.col("id"), F.col("label.id")) & (F.col("sha") == F.col("label.sha"))
    return (marked.join(labels, marked["fp"] == labels["label_fp"])
            .select(F.col("id").alias("doc_id"), F.col("sha").alias("text_sha"), stays.alias("stays")))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

