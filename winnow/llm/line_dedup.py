"""Line deduplication over levelled sorted runs, in DataFrame operations only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z in
lower case. Keys of at least ``min_chars`` code points belong to the document that
held them first; the lines that hold them in any other document go.

``LineRuns`` keeps what has been seen as sorted runs of key hashes, in levels as a
log-structured merge tree does:

- a batch of documents reduces its lines to one row per key (reduced in each task
  before the shuffle) and merge-anti-joins every run; keys found in no run are new
  and form a run of level 0;
- a run is a bucketed table: hashed on the key into one sorted file per bucket. The
  batch's keys are written so too; the anti joins then merge sorted files, without a
  shuffle or a sort;
- when a level holds ``fan`` runs, they are merged into one run of the next level
  (their keys are disjoint, so nothing has to be compared). A batch meets at most
  ``fan - 1`` runs of each level;
- a line of the batch stays if its key is new and its document is the one the key
  belongs to. That is an anti join on (key, document): a line that a third of all
  documents hold is spread over their ids.

Key hashes are two 64-bit hashes of different seeds and the key's length. The
state lies below the shared checkpoint folder; a manifest table names the live
runs, so that a later session can go on with it (``LineRuns.open``).

``line_dedup`` deals one table into ``batches`` ranges of ascending ids (sampled
splitters) and adds them in order: the smallest id holding a key keeps it.

Defined results: NULL text is an empty text, with one empty line; rows of one id
are one document and never take lines from each other; NULL ids are one document
that comes after all others; repeated rows repeat in the result; an empty table
gives an empty result; other columns are ignored, whatever their names. Across
batches of ``LineRuns.add`` the earlier batch keeps a line, whatever the ids; a
document whose rows arrive in two batches counts as two.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import read, same, stored
from winnow.operators.index import bucketed
from winnow.session import checkpoint_dir, scratch_path, shuffle_width

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BATCHES = 8
FAN = 4
KEY = ["h1", "h2", "chars"]
_COLUMNS = "h1 BIGINT, h2 BIGINT, chars INT, owner BIGINT"


def line_key(line: Column) -> Column:
    """Stripped and with A-Z (no other letter) in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def key_rows(rows: DataFrame, min_chars: int, *extra: str) -> DataFrame:
    """(id, th, pos, h1, h2, chars): the lines whose keys are long enough."""
    lines = rows.select("id", "th", *extra, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("id", "th", *extra, "pos", line_key(F.col("line")).alias("key"))
    return (keyed.where(F.char_length("key") >= min_chars)
            .select("id", "th", *extra, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"),
                    F.char_length("key").alias("chars")))


class LineRuns:
    """What has been seen so far, as levelled sorted runs below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.folder = folder or scratch_path(spark, "line-runs")
        self.buckets = buckets or shuffle_width(spark)
        #: Live runs as (level, name), oldest first.
        self.runs: list[tuple[int, str]] = []
        self._tag = uuid.uuid4().hex[:8]
        # One sorted file per bucket: its order may be relied on.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fan: int = FAN) -> "LineRuns":
        """The state that ``save_manifest`` left, in any session."""
        rows = spark.read.parquet(f"{folder}/manifest").collect()
        state = cls(spark, folder, fan, rows[0]["buckets"] if rows else None)
        for row in sorted(rows, key=lambda r: r["nth"]):
            if row["name"]:
                state._declare(row["name"])
                state.runs.append((row["level"], row["name"]))
        return state

    def save_manifest(self) -> None:
        rows = [(i, level, name, self.buckets) for i, (level, name) in enumerate(self.runs)] or [(0, 0, "", self.buckets)]
        (self.spark.createDataFrame(rows, "nth int, level int, name string, buckets int")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest"))

    def _table(self, name: str) -> str:
        return f"line_runs_{self._tag}_{name}"

    def _declare(self, name: str) -> None:
        keys = ", ".join(KEY)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({_COLUMNS}) USING parquet "
                       f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS "
                       f"LOCATION '{self.folder}/{name}'")

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"run_{level}_{uuid.uuid4().hex[:8]}"
        (rows.select(*KEY, "owner").write.format("parquet").option("path", f"{self.folder}/{name}")
         .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(self._table(name)))
        return name

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def new_keys(self, batch: str) -> DataFrame:
        """(key, owner) of the batch's table that no run holds."""
        keys = self.table(batch)
        for _, name in self.runs:
            keys = keys.join(self.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of :func:`key_rows`; returns the lines of it that go (id, th, pos)."""
        # One row per key, as a sorted table of its own: what follows merges tables
        # without a shuffle, and a key that many lines hold is one row in it.
        keys = lines.groupBy(*KEY).agg(F.min("id").alias("owner"))
        name = self._write(keys.repartition(self.buckets, *KEY) if shuffle_width(self.spark) != self.buckets else keys, 0)
        if self.runs:
            name = self._write(self.new_keys(name), 0)
        self.runs.append((0, name))
        owned = self.table(name)
        stays = [lines[c] == owned[c] for c in KEY] + [same(lines["id"], owned["owner"])]
        gone = lines.join(owned.hint("merge"), stays, "left_anti").select("id", "th", "pos")
        self._compact()
        return gone

    def _compact(self) -> None:
        """Merge a level that is full into one run of the next."""
        level = 0
        while sum(at == level for at, _ in self.runs) >= self.fan:
            full = [name for at, name in self.runs if at == level]
            whole = self.table(full[0])
            for name in full[1:]:
                whole = whole.unionByName(self.table(name))
            name = self._write(whole.repartition(self.buckets, *KEY), level + 1)
            # Files of merged runs stay: a batch not yet written may still read them.
            self.runs = [(level + 1, name)] + [r for r in self.runs if r[0] != level]
            self.runs.sort(key=lambda r: -r[0])
            level += 1


def without_lines(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): ``rows`` (id, th, text) without the lines
    that ``gone`` (id, th, pos) names."""
    by_doc = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("drops")).withColumnsRenamed({"id": "d_id", "th": "d_th"})
    joined = rows.join(by_doc, same(rows["id"], by_doc["d_id"]) & (rows["th"] == by_doc["d_th"]), "left")
    lines = lines_of(F.col("text"))
    # Positions by hash sets, in order: linear however many lines go.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return joined.select(F.col("id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"),
                         F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
                         F.when(F.col("drops").isNull(), F.col("text")).otherwise(rest).alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), one row per input row."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = document_rows(docs, id_col, text_col)
    # Batches in the order of the ids, NULL last.
    dealt = bucketed(rows.withColumn("no_id", F.isnull("id").cast("int")), ["no_id", "id"], batches)
    path = scratch_path(spark, "line-keys")
    (key_rows(dealt.withColumnRenamed("__bucket", "batch"), min_chars, "batch")
     .write.option("compression", "zstd").partitionBy("batch").parquet(path))
    lines = spark.read.schema("id long, th long, pos int, h1 long, h2 long, chars int, batch int").parquet(path)
    state = LineRuns(spark, fan=fan)
    gone = None
    for batch in range(batches):
        found = stored(state.add(lines.where(F.col("batch") == batch).drop("batch")), "line-drops")
        gone = found if gone is None else gone.unionByName(found)
    state.save_manifest()
    return without_lines(rows, gone)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
