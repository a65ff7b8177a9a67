"""Row identity and canonical sample text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The key separator (unit separator, code 31) and the text written
# for a missing field, as Python's str(None) prints it.
KEY_SEPARATOR = "\x1f"
NONE_TEXT = "None"
KEY_FIELDS = ("source_dataset", "config", "split", "row_index")


def example_key(source_dataset="source_dataset", config="config", split="split",
                row_index="row_index") -> Column:
    """``source \\x1f config \\x1f split \\x1f row_index``.

    ``concat_ws`` skips NULLs, so each part is first turned into text with
    ``None`` standing for NULL, which keeps four parts in every key.
    """
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                        F.lit(NONE_TEXT))
             for c in (source_dataset, config, split, row_index)]
    return F.concat_ws(KEY_SEPARATOR, *parts)


def _sorted_value(col: Column, dtype: T.DataType) -> Column:
    """Rebuild structs (also inside arrays) with fields in name order."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        return F.struct(*[_sorted_value(col.getField(f.name), f.dataType).alias(f.name)
                          for f in fields])
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda x: _sorted_value(x, dtype.elementType))
    return col


def canonical_sample(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON text per row: keys sorted, nulls written, non-ASCII kept.

    Spark's JSON writer puts no blanks after ``,`` and ``:`` (Python's
    ``json.dumps`` does); that formatting difference is documented.
    """
    names = sorted(columns or df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    packed = F.struct(*[_sorted_value(F.col(n), fields[n]).alias(n) for n in names])
    return F.to_json(packed, {"ignoreNullFields": "false"})
