"""Queries: pooled vectors per label, cosine of neighbouring vectors, ternary codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import vectors as V
from winnow.plans.registry import query
from winnow.sources.tables import read_table


@query("mean_pool", """
WITH ex AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v, CAST(vec_id % 3 > 0 AS INTEGER) AS m
            FROM embeddings),
pd AS (SELECT label, dim, sum(CAST(v AS DOUBLE) * m) / greatest(CAST(sum(m) AS DOUBLE), 1e-9)
              AS mean FROM ex GROUP BY label, dim),
pl AS (SELECT label, list(mean ORDER BY dim) AS means FROM pd GROUP BY label)
SELECT label, list_transform(means, lambda x: round(x / greatest(sqrt(list_sum(list_transform(means, lambda y: y * y))),
                                                                 1e-12), 9)) AS pooled
FROM pl""")
def q_mean_pool(spark, sf_dir):
    # Every third vector is masked out.
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    return V.mean_pool(vectors, "label", "embedding", "mask")


@query("pair_similarity", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b,
       round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))
             / (greatest(sqrt(list_sum(list_transform(a.v, lambda x: x * x))), 1e-12)
                * greatest(sqrt(list_sum(list_transform(b.v, lambda x: x * x))), 1e-12)), 9) AS cosine
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def q_pair_similarity(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    # Neighbouring ids form the pairs: a pairs table, never all pairs.
    pairs = emb.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return V.pair_similarity(pairs, emb)


@query("ternary_quantize", """
WITH al AS (SELECT greatest(avg(abs(CAST(v AS DOUBLE))), 1e-8) AS alpha
            FROM (SELECT unnest(embedding) AS v FROM embeddings)),
q AS (SELECT vec_id, alpha,
             list_transform(embedding, lambda w: CAST(least(1, greatest(-1, round_even(CAST(w AS DOUBLE) / alpha, 0)))
                                                      AS INTEGER)) AS codes
      FROM embeddings, al)
SELECT vec_id, round(alpha, 9) AS alpha, codes, list_transform(codes, lambda c: round(c * alpha, 9)) AS "values"
FROM q""")
def q_ternary_quantize(spark, sf_dir):
    return V.ternary_quantize(read_table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
