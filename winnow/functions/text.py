"""Text expressions: sample JSON to plain text, Python-style strip, reply cleanup.

All of these are native Spark SQL expressions (VARIANT, higher-order array
functions, regexes), so they run inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields read from a non-chat sample object, in this order, after
# the message contents.
TEXT_FIELDS = ("text", "question", "answer", "prompt", "response", "instruction", "output", "input")

# The characters Python's str.strip() removes (str.isspace()),
# written as one regex class that Java and RE2 read alike.
PY_SPACE_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PY_STRIP_PATTERN = rf"\A{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\z"

# Fixed values for reply cleanup: the cut marker, the shortest kept reply and
# the placeholder for an empty one.
QUESTION_MARKER = "Frage:"
MIN_REPLY_CHARS = 3
EMPTY_REPLY = "..."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: removes every Unicode blank, plus \\x1c-\\x1f, at both ends."""
    return F.regexp_replace(_col(c), PY_STRIP_PATTERN, "")


def _py_str_sql(x: str) -> str:
    """SQL text for Python's ``str(value)`` of a VARIANT; NULL when absent.

    JSON null prints ``None``, booleans ``True``/``False``; strings as they are;
    numbers in Spark's spelling; nested values as JSON text (Python would
    print its repr - a documented difference).
    """
    return (f"CASE WHEN {x} IS NULL THEN NULL "
            f"WHEN is_variant_null({x}) THEN 'None' "
            f"WHEN schema_of_variant({x}) = 'BOOLEAN' THEN "
            f"IF(variant_get({x}, '$', 'boolean'), 'True', 'False') "
            f"ELSE cast({x} AS STRING) END")


def extract_text_sql(sample: str, parsed: str) -> str:
    """SQL for the plain text of a sample JSON string.

    ``sample`` is the raw text column, ``parsed`` its ``try_parse_json``.
    Rules: unparsable -> the input; object -> each ``messages[i].content``
    that exists, then the fields of TEXT_FIELDS that exist; list -> strings
    and string values of objects (key order); other -> ``str(value)``; parts
    joined by newline. NULL sample -> empty text.
    """
    content = "try_variant_get(m, '$.content', 'variant')"
    messages = (f"coalesce(transform(filter(try_variant_get({parsed}, '$.messages', 'array<variant>'), "
                f"m -> {content} IS NOT NULL), m -> {_py_str_sql(content)}), "
                f"cast(array() AS array<string>))")
    fields = ", ".join(_py_str_sql(f"try_variant_get({parsed}, '$.{k}', 'variant')")
                       for k in TEXT_FIELDS)
    obj_vals = "try_variant_get(item, '$', 'map<string,variant>')"
    items = (f"flatten(transform(try_variant_get({parsed}, '$', 'array<variant>'), item -> "
             f"CASE WHEN schema_of_variant(item) = 'STRING' THEN array(cast(item AS STRING)) "
             f"WHEN {obj_vals} IS NOT NULL THEN "
             f"transform(filter(map_values({obj_vals}), x -> schema_of_variant(x) = 'STRING'), "
             f"x -> cast(x AS STRING)) "
             f"ELSE cast(array() AS array<string>) END))")
    first = f"substr(trim(LEADING ' \\t\\n\\r' FROM {sample}), 1, 1)"
    return (f"CASE WHEN {sample} IS NULL THEN '' "
            f"WHEN {parsed} IS NULL THEN {sample} "
            f"WHEN {first} = '{{' THEN array_join(concat({messages}, array_compact(array({fields}))), '\\n') "
            f"WHEN {first} = '[' THEN array_join({items}, '\\n') "
            f"ELSE {_py_str_sql(parsed)} END")


def with_extracted_text(df, sample: str = "sample", out: str = "text"):
    """Add ``out`` = plain text of the JSON in ``sample`` (parsed once)."""
    parsed = "__parsed_sample"
    return (df.withColumn(parsed, F.expr(f"try_parse_json({sample})"))
              .withColumn(out, F.expr(extract_text_sql(sample, parsed)))
              .drop(parsed))


def clean_response(c, mode: str = "fewshot") -> Column:
    """Tidy a generated reply.

    ``fewshot``: cut at the first ``Frage:``, strip, under 3 characters ->
    ``...``. ``chat``: strip, empty -> ``...``.
    """
    text = py_strip(c)
    if mode == "chat":
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(EMPTY_REPLY)).otherwise(text)
    cut = F.when(F.instr(text, QUESTION_MARKER) > 0,
                 py_strip(F.split_part(text, F.lit(QUESTION_MARKER), F.lit(1)))).otherwise(text)
    return F.when(F.coalesce(F.length(cut), F.lit(0)) < MIN_REPLY_CHARS,
                  F.lit(EMPTY_REPLY)).otherwise(cut)
