"""Queries: pre-token counts, BPE vocabulary, BPE ids.

The SQL learns the same vocabulary one merge a step (a keyed recursion over the
distinct words), so it states the ids of every query that encodes with it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.tokens import SPECIAL_TOKENS, UNK_ID
from winnow.operators import bpe
from winnow.sources.tables import read_table
from winnow.plans.common import recursive_sql
from winnow.plans.registry import query

# DuckDB: the pre-tokens of a text. RE2 has no look-ahead, so the last blank of
# each run before other text is marked first (chr(1) never occurs in the tables);
# a run before a mark is a token of its own, the marked blank joins what follows
# when it is a space.
PRETOKENS_SQL = r"""list_transform(regexp_extract_all(regexp_replace(text, '(\s)([^\s])', chr(1) || '\1\2', 'g'),
    '\x27s|\x27t|\x27re|\x27ve|\x27m|\x27ll|\x27d|(?:\x01\x20)?\p{L}+|(?:\x01\x20)?\p{N}+'
    || '|(?:\x01\x20)?[^\s\p{L}\p{N}\x01]+|\s+|\x01\s'), lambda w: replace(w, chr(1), ''))"""
WORDS_SQL = f"""
SELECT word, count(*) AS n FROM (SELECT unnest({PRETOKENS_SQL}) AS word FROM conversations WHERE text <> '')
GROUP BY word"""


def learnt_sql(also: str | None = None) -> str:
    """CTEs ``bpe_run`` (one row per word with its symbols, one with the vocabulary
    and merges) and ``word_ids``. Words of ``also`` (SQL of a ``word`` column) are
    encoded but never counted."""
    words = WORDS_SQL if also is None else f"""
  SELECT word, sum(n) AS n FROM (({WORDS_SQL}) UNION ALL SELECT DISTINCT word, 0 FROM ({also})) GROUP BY word"""
    specials = ", ".join(f"'{t}'" for t in SPECIAL_TOKENS)
    return f"""
learnt AS MATERIALIZED ({words}),
byte_symbols AS (
  SELECT b, CASE WHEN shown THEN b ELSE 255 + row_number() OVER (PARTITION BY shown ORDER BY b) END AS symbol
  FROM (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS shown FROM range(256) r(b))),
spelt AS MATERIALIZED (
  SELECT word, n, pos, CAST('0x' || substr(hex(encode(word)), 2 * pos + 1, 2) AS INTEGER) AS b
  FROM (SELECT word, n, unnest(range(octet_length(encode(word)))) AS pos FROM learnt)),
alphabet AS MATERIALIZED (
  SELECT b, chr(CAST(symbol AS INTEGER)) AS symbol, {len(SPECIAL_TOKENS) - 1} + row_number() OVER (ORDER BY symbol) AS id
  FROM byte_symbols WHERE b IN (SELECT b FROM spelt WHERE n > 0)),
started AS (
  SELECT word, any_value(n) AS n,
         string_agg(chr(CAST({bpe.FIRST_SYMBOL} + coalesce(id, {UNK_ID}) AS INTEGER)), '' ORDER BY pos) AS s
  FROM spelt LEFT JOIN alphabet USING (b) GROUP BY word),
bpe_run(word, n, s, vocab, merges) USING KEY (word) AS (
  SELECT word, n, s, NULL::VARCHAR[], NULL::STRUCT(l VARCHAR, r VARCHAR)[] FROM started
  UNION ALL
  SELECT NULL, 0, '', [{specials}] || (SELECT list(symbol ORDER BY id) FROM alphabet), []
  UNION ALL
  (WITH pairs AS (
     SELECT p, sum(n) AS c
     FROM (SELECT n, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS p
           FROM recurring.bpe_run WHERE n > 0 AND length(s) > 1)
     GROUP BY p),
   best AS (SELECT p FROM pairs ORDER BY c DESC, p LIMIT 1),
   known AS (
     SELECT p, vocab, merges, vocab[unicode(p) - {bpe.FIRST_SYMBOL - 1}] AS l,
            vocab[unicode(substr(p, 2)) - {bpe.FIRST_SYMBOL - 1}] AS r
     FROM best, (SELECT vocab, merges FROM recurring.bpe_run WHERE word IS NULL) WHERE len(vocab) < {bpe.VOCAB_SIZE}),
   step AS (
     SELECT *, chr(CAST({bpe.FIRST_SYMBOL - 1} + coalesce(list_position(vocab, l || r), len(vocab) + 1) AS INTEGER)) AS new
     FROM known)
   SELECT word, n, replace(s, p, new), NULL, NULL FROM recurring.bpe_run, step WHERE contains(s, p)
   UNION ALL
   SELECT NULL, 0, '', CASE WHEN list_contains(vocab, l || r) THEN vocab ELSE list_append(vocab, l || r) END,
          list_append(merges, {{'l': l, 'r': r}}) FROM step)),
word_ids AS MATERIALIZED (
  SELECT word, list_transform(string_split(s, ''), lambda c: CAST(unicode(c) - {bpe.FIRST_SYMBOL} AS INTEGER)) AS ids
  FROM bpe_run WHERE word IS NOT NULL)"""


# DuckDB: the ids of every message.
ENCODED_SQL = f"""
texts AS MATERIALIZED (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations),
text_ids AS (
  SELECT r, flatten(list(ids ORDER BY pos)) AS ids
  FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos
        FROM (SELECT r, {PRETOKENS_SQL} AS words FROM texts WHERE text <> ''))
  JOIN word_ids USING (word) GROUP BY r),
encoded AS MATERIALIZED (
  SELECT conv_id, turn, role, text, coalesce(ids, CAST([] AS INTEGER[])) AS ids FROM texts LEFT JOIN text_ids USING (r))"""
MESSAGE_IDS_SQL = recursive_sql(learnt_sql(), ENCODED_SQL, body="""
SELECT concat_ws(':', conv_id, turn) AS msg_key, ids FROM encoded""")

_TRAINED: dict = {}


def _texts(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations")


def trained(spark, sf_dir):
    """(vocab, merges) of all conversation texts; trained once per application
    and folder. What is kept is the vocabulary itself (2,048 entries)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = bpe.bpe_train(spark, bpe.word_counts(_texts(spark, sf_dir), "text"), vocab_size=bpe.VOCAB_SIZE)
    return _TRAINED[key]


@query("word_counts", WORDS_SQL)
def q_word_counts(spark, sf_dir):
    return bpe.word_counts(_texts(spark, sf_dir), "text")


@query("bpe_train", recursive_sql(learnt_sql(), body="""
SELECT CAST(rank AS INTEGER) AS rank, merges[rank + 1].l AS "left", merges[rank + 1].r AS "right"
FROM (SELECT merges, unnest(range(len(merges))) AS rank FROM bpe_run WHERE word IS NULL)"""))
def q_bpe_train(spark, sf_dir):
    return trained(spark, sf_dir)[1]


@query("bpe_encode", MESSAGE_IDS_SQL)
def q_bpe_encode(spark, sf_dir):
    conv = _texts(spark, sf_dir).withColumn("msg_key", F.concat_ws(":", "conv_id", "turn"))
    return bpe.bpe_encode(conv, *trained(spark, sf_dir), "msg_key", "text")
