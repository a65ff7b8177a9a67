"""Vectors: masked mean pooling, cosine of pairs, ternary compression.

Vectors are ``ARRAY<FLOAT>`` columns. Pooling explodes (row, dim) values and
averages per (group, dim) - a hash aggregate with map-side partial sums, so
a hot group is combined before the shuffle; the pooled vector is reassembled
from its dimensions (a bounded group: one value per dimension).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The floor of the mask count, the norm floor of L2
# normalisation and the floor of the ternary scale.
MASK_FLOOR = 1e-9
NORM_FLOOR = 1e-12
SCALE_FLOOR = 1e-8
DIGITS = 9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    """Cosine of two vectors after L2 normalisation (norm floored at 1e-12)."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(NORM_FLOOR)) * F.greatest(l2_norm(b), F.lit(NORM_FLOOR)))


def mean_pool(df: DataFrame, group: str, vec: str, mask: str | None = None) -> DataFrame:
    """Masked mean of the vectors of each group, then unit length.

    ``mask``: optional 0/1 column per row (default 1). Denominator is the
    mask sum floored at 1e-9. Output: (group, pooled ARRAY<DOUBLE>); a group has as
    many dimensions as its longest vector.
    """
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    rows = df.where(F.size(vec) > 0).select(F.col(group), m.alias("__m"), F.col(vec).cast("array<double>").alias("__v"))
    # Place 0 carries a one, so its masked sum is the number of rows.
    places = rows.select(group, "__m", F.posexplode(F.concat(F.array(F.lit(1.0)), "__v")).alias("__at", "__x"))
    sums = places.groupBy(group, "__at").agg(F.sum(F.col("__x") * F.col("__m")).alias("__s"))
    pooled = (sums.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("__at", "__s"))).alias("__d"))
              .select(group, F.col("__d.__s").alias("__d")))
    weight = F.greatest(F.col("__d")[0], F.lit(MASK_FLOOR))
    pooled = pooled.select(group, F.transform(F.slice("__d", 2, F.size("__d") - 1), lambda x: x / weight).alias("means"))
    norm = F.greatest(l2_norm("means"), F.lit(NORM_FLOOR))
    return pooled.select(group, F.transform("means", lambda x: F.round(x / norm, DIGITS)).alias("pooled"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, left: str = "a", right: str = "b",
                    key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Cosine of each (left, right) pair: the pairs table joined twice to the
    vectors (equi-joins; no pair is formed that is not listed)."""
    va = vectors.select(F.col(key).alias(left), F.col(vec).alias("__va"))
    vb = vectors.select(F.col(key).alias(right), F.col(vec).alias("__vb"))
    joined = pairs.join(va, left).join(vb, right)
    return joined.select(left, right, F.round(cosine("__va", "__vb"), DIGITS).alias("cosine"))


def ternary_quantize(df: DataFrame, vec: str, key: str) -> DataFrame:
    """alpha = max(mean |w|, 1e-8) over every value of the column; codes =
    clamp(round-half-even(w / alpha), -1, 1); values = alpha * codes.

    alpha is one aggregate (partial sums per task) used as a scalar
    subquery. Output: (key, alpha, codes ARRAY<INT>, values ARRAY<DOUBLE>).
    """
    known = F.filter(vec, lambda w: w.isNotNull())
    row_sum = F.aggregate(known, F.lit(0.0), lambda acc, w: acc + F.abs(w.cast("double")))
    per_row = df.where(F.size(vec) > 0).select(row_sum.alias("__s"), F.size(known).alias("__n"))
    alpha = per_row.agg(F.greatest(F.sum("__s") / F.sum("__n"), F.lit(SCALE_FLOOR)).alias("alpha"))
    j = df.select(key, vec).withColumn("alpha", alpha.select("alpha").scalar())
    codes = F.transform(F.col(vec), lambda w: F.least(F.lit(1.0), F.greatest(F.lit(-1.0),
                                                      F.rint(w.cast("double") / F.col("alpha")))).cast("int"))
    j = j.withColumn("codes", codes)
    return j.select(key, F.round("alpha", DIGITS).alias("alpha"), "codes",
                    F.transform("codes", lambda c: F.round(c * F.col("alpha"), DIGITS)).alias("values"))
