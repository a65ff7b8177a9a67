"""Compare a Spark result with its DuckDB oracle (order-insensitive)."""

from __future__ import annotations

import math

from winnow.sources.tables import TABLES, table_path


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def canonical_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str):
    """(same_columns, same_rows, n_spark, n_duck)."""
    s_cols, s_rows = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    same_cols = sorted(s_cols) == sorted(d_cols)
    same = same_cols and canonical_rows(s_cols, s_rows) == canonical_rows(d_cols, d_rows)
    return same_cols, same, len(s_rows), len(d_rows)
