"""Positions and running sums inside groups that may be very large.

A plain ``row_number().over(partitionBy(g).orderBy(k))`` sends a whole group to
one task; when one dataset split (or one conversation) holds a third of all
rows, that task is the job. Here rows are cut into buckets of the global
(group, order) sort order instead, so a hot group spans many buckets:

1. a sample of the keys (about 30 per bucket) gives the bucket boundaries,
   frozen as one array literal - so a row's bucket is a pure function of its
   key (binary search) and every recomputation (retries, lost executors, the
   two branches below) agrees. A key is in the sample when its hash falls under
   a rate computed from the row count: every task filters its own rows, equal
   keys are counted before they meet, and the driver receives the sample only;
2. positions / running sums are windows over (bucket, group) - partitions
   bounded by the bucket size;
3. a per-(bucket, group) total gives each bucket the amount of its group in
   earlier buckets. Only a group continuing from an earlier bucket needs one,
   and each bucket starts with at most one such group, so the broadcast
   offsets table has at most ``buckets`` rows whatever the data size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.session import shuffle_width

_B, _N, _BASE, _RUN = "__bucket", "__n", "__base", "__run"
SAMPLES_PER_BUCKET = 30
# Buckets per shuffle partition: several small buckets per task even out the
# hash placement of (bucket, group) keys onto tasks.
BUCKETS_PER_PARTITION = 4
_HASH_BITS = 40


_PY_SORTABLE = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DateType,
                T.TimestampType, T.BooleanType)


def _bounds(df: DataFrame, keys: list[str], buckets: int) -> list[tuple]:
    """Up to ``buckets - 1`` distinct boundary keys, in Spark's sort order.

    Two narrow jobs: a row count, then the distinct keys whose hash falls under
    the sampling rate, with their row counts as weights. The sample depends on
    the keys alone, not on how rows are laid out in files. Strings, integers
    and dates sort the same in Python (code points = UTF-8 byte order) as in
    Spark; other key types are sorted by Spark.
    """
    if buckets <= 1:
        return []
    total = df.count()
    if not total:
        return []
    rate = SAMPLES_PER_BUCKET * buckets / total
    keyed = df.select(*keys)
    if rate < 1:
        low = F.xxhash64(*[F.col(k) for k in keys]).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
        keyed = keyed.where(low < F.lit(int(rate * (1 << _HASH_BITS))))
    sample = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__weight"))
    types = {f.name: f.dataType for f in df.schema.fields}
    if not all(isinstance(types[k], _PY_SORTABLE) for k in keys):
        sample = sample.orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    rows = [tuple(r) for r in sample.collect()]
    if all(isinstance(types[k], _PY_SORTABLE) for k in keys):
        rows.sort(key=lambda r: tuple((0, 0) if v is None else (1, v) for v in r[:-1]))
    weight = sum(r[-1] for r in rows)
    picked, seen, due = [], 0, 1
    for r in rows:
        if due < buckets and seen * buckets >= due * weight:
            picked.append(r[:-1])
            due = seen * buckets // weight + 1
        seen += r[-1]
    return picked


def _json_value(v):
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _bucket_expr(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """Number of boundaries <= the row's key: a binary search over one array
    literal (``aggregate`` over log2(buckets) steps). The boundaries travel
    as a single constant - folded once from JSON - so the plan stays small
    and code generation is unaffected however many buckets there are."""
    if not bounds:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [f"k{i}" for i in range(len(keys))]
    key = F.struct(*[F.col(k).alias(f) for k, f in zip(keys, fields)])
    schema = T.ArrayType(T.StructType([T.StructField(f, types[k]) for k, f in zip(keys, fields)]))
    text = json.dumps([{f: _json_value(v) for f, v in zip(fields, b)} for b in bounds], ensure_ascii=False)
    arr = F.from_json(F.lit(text), schema)
    n = len(bounds)
    steps = max(1, n.bit_length() + 1)

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        go_right = key >= F.element_at(arr, mid + 1)
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.when(go_right, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
             .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"))))

    init = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


def _bucketed(df: DataFrame, keys: list[str], buckets: int | None) -> tuple[DataFrame, bool]:
    """(df + ``__bucket``, single) - single when no boundary was found."""
    n = buckets or BUCKETS_PER_PARTITION * shuffle_width(df.sparkSession)
    bounds = _bounds(df, keys, n)
    return df.withColumn(_B, _bucket_expr(df, keys, bounds)), not bounds


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` plus ``__bucket``: contiguous ranges of the (keys) sort order."""
    return _bucketed(df, keys, buckets)[0]


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _offsets(stats: DataFrame, group_cols, agg: str = "sum") -> DataFrame:
    before = Window.partitionBy(*group_cols).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    base = _AGG[agg](_N).over(before)
    keep = (F.col(_BASE) > 0) if agg == "sum" else F.col(_BASE).isNotNull()
    return (stats.select(F.col(_B).alias("__ob"),
                         *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group_cols)],
                         base.alias(_BASE))
                 .where(keep))


def _with_offsets(local: DataFrame, stats: DataFrame, group_cols, out: str, agg: str = "sum") -> DataFrame:
    # At most one offset row per bucket: a bounded broadcast.
    right = F.broadcast(_offsets(stats, group_cols, agg))
    # Null-safe (a bucket is never NULL): from ``bucket = __ob`` the optimizer may infer
    # a filter on ``__ob`` that holds the bucket's expression over columns of ``local``.
    cond = local[_B].eqNullSafe(right["__ob"])
    for i, c in enumerate(group_cols):
        cond = cond & local[c].eqNullSafe(right[f"__g{i}"])
    joined = local.join(right, cond, "left")
    if agg == "sum":
        value = F.coalesce(F.col(_BASE), F.lit(0)) + F.col(_RUN)
    else:
        pick = F.least if agg == "min" else F.greatest  # both skip NULLs
        value = pick(F.col(_BASE), F.col(_RUN))
    return (joined.withColumn(out, value)
                  .drop(_B, _RUN, _BASE, "__ob", *[f"__g{i}" for i in range(len(group_cols))]))


def group_index(df: DataFrame, group_cols, order_cols, out: str = "row_index",
                partitions: int | None = None) -> DataFrame:
    """0-based position of each row in its group, ordered by ``order_cols``
    (which must make the order total inside a group)."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    b, single = _bucketed(df, group_cols + order_cols, partitions)
    w = Window.partitionBy(_B, *group_cols).orderBy(*order_cols)
    local = b.withColumn(_RUN, F.row_number().over(w) - 1)
    if single:  # no earlier bucket: no offsets
        return local.withColumnRenamed(_RUN, out).drop(_B)
    stats = b.groupBy(_B, *group_cols).agg(F.count(F.lit(1)).alias(_N))
    return _with_offsets(local, stats, group_cols, out)


def group_prefix_sum(df: DataFrame, group_cols, order_cols, value: str | None, out: str,
                     partitions: int | None = None, inclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` (row count when None) inside each group in
    ``order_cols`` order; exclusive by default (an offset)."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    b, single = _bucketed(df, group_cols + order_cols, partitions)
    v = F.lit(1) if value is None else F.coalesce(F.col(value), F.lit(0))
    w = (Window.partitionBy(_B, *group_cols).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = b.withColumn(_RUN, F.coalesce(F.sum(v).over(w), F.lit(0)))
    if single:
        return local.withColumnRenamed(_RUN, out).drop(_B)
    stats = b.groupBy(_B, *group_cols).agg(F.sum(v).alias(_N))
    return _with_offsets(local, stats, group_cols, out)


def group_running(df: DataFrame, group_cols, order_cols, value: str, out: str, agg: str = "min",
                  partitions: int | None = None, inclusive: bool = False) -> DataFrame:
    """Running ``min`` / ``max`` of ``value`` inside each group in
    ``order_cols`` order; exclusive by default (NULL for a group's first row)."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    b, single = _bucketed(df, group_cols + order_cols, partitions)
    w = (Window.partitionBy(_B, *group_cols).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = b.withColumn(_RUN, _AGG[agg](value).over(w))
    if single:
        return local.withColumnRenamed(_RUN, out).drop(_B)
    stats = b.groupBy(_B, *group_cols).agg(_AGG[agg](value).alias(_N))
    return _with_offsets(local, stats, group_cols, out, agg)
