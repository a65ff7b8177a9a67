"""Job rows: every source row tagged (dataset, config, split, row_index, sample).

Each source is one scan; ``lit()`` tags name it; ``unionByName`` stacks them.
``row_index`` is the row's position inside its (dataset, config, split),
numbered by :func:`winnow.operators.index.group_index` so a huge split is
spread over many tasks instead of one window partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.keys import canonical_sample, example_key
from winnow.operators.index import group_index
from winnow.sources.tables import read_table

JOB_COLUMNS = ("source_dataset", "config", "split", "row_index", "sample")
DEFAULT_CONFIG = "default"

@dataclass(frozen=True)
class Source:
    """How one readable dataset becomes job rows.

    ``config`` / ``split``: a column name of the source or a literal string;
    ``order``: columns giving the row order inside a split (must be unique).
    """
    name: str
    frame: DataFrame
    order: tuple
    config: str | None = None
    split: str = "train"
    config_is_column: bool = False
    split_is_column: bool = False

    def _tag(self, value, is_column) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        return F.col(value).cast("string") if is_column else F.lit(value)

    def tags(self) -> tuple[Column, Column]:
        """The row's config and split."""
        # A repository without a named config is filed under "default".
        return (F.coalesce(self._tag(self.config, self.config_is_column), F.lit(DEFAULT_CONFIG)),
                self._tag(self.split, self.split_is_column))

    def rows(self) -> DataFrame:
        df = self.frame
        config, split = self.tags()
        order = [F.col(c).alias(f"__order{i}") for i, c in enumerate(self.order)]
        return df.select(
            F.lit(self.name).alias("source_dataset"),
            config.alias("config"),
            split.alias("split"),
            *order,
            canonical_sample(df).alias("sample"),
        )


def conversation_frame(conversations: DataFrame) -> DataFrame:
    """One chat row per conversation: ``{conv_id, messages: [{content, role}]}``.

    A chat record is one row by definition (its sample is one JSON text), so
    the messages of one conversation are gathered; they stay in turn order.
    """
    msgs = (conversations.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("content"), "role")))
                 .alias("m")))
    return msgs.select("conv_id", F.transform("m", lambda x: F.struct(
        x["content"].alias("content"), x["role"].alias("role"))).alias("messages"))


def given_sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    """The given tables as sources: documents (config = source, split = lang)
    and conversations (config default, split train)."""
    docs = read_table(spark, sf_dir, "documents")
    convs = conversation_frame(read_table(spark, sf_dir, "conversations"))
    return [
        Source("documents", docs, ("doc_id",), config="source", split="lang",
               config_is_column=True, split_is_column=True),
        Source("conversations", convs, ("conv_id",), config=None, split="train"),
    ]


def validate_choice(chosen, allowed) -> list[str]:
    """None chosen = all; an unknown name is rejected before any scan."""
    allowed = list(allowed)
    if not chosen:
        return allowed
    unknown = sorted(set(chosen) - set(allowed))
    if unknown:
        raise ValueError(f"unknown source(s): {unknown}; allowed: {allowed}")
    return [s for s in allowed if s in set(chosen)]


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def source_samples(sources: list[Source]) -> DataFrame:
    """The rows of all sources without positions (source_dataset, config, split,
    sample): what a report over all samples needs, without any shuffle."""
    return union_sources([s.rows().select("source_dataset", "config", "split", "sample") for s in sources])


def scan_sources(sources: list[Source], chosen=None, partitions: int | None = None) -> DataFrame:
    """Job rows of the chosen sources (source filter applied before the scan).

    Output: source_dataset, config, split, row_index, sample.
    """
    names = validate_choice(chosen, [s.name for s in sources])
    picked = [s for s in sources if s.name in names]
    width = max(len(s.order) for s in picked)
    frames = []
    for s in picked:
        rows = s.rows()
        for i in range(len(s.order), width):
            rows = rows.withColumn(f"__order{i}", F.lit(None).cast("long"))
        frames.append(rows)
    stacked = union_sources(frames)
    order = [f"__order{i}" for i in range(width)]
    indexed = group_index(stacked, ["source_dataset", "config", "split"], order, out="row_index",
                          partitions=partitions)
    return indexed.select(*JOB_COLUMNS)


def with_example_id(jobs: DataFrame, out: str = "example_id") -> DataFrame:
    return jobs.withColumn(out, example_key())
