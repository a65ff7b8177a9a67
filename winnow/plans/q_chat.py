"""Queries: exchanges, history, few-shot and chat prompts, reply cleanup."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.text import PY_STRIP_PATTERN, clean_response
from winnow.operators import chat as H
from winnow.plans.common import with_sql
from winnow.plans.q_classify import sql_str
from winnow.plans.registry import query
from winnow.sources.tables import read_table

EX_SQL = """
numbered AS (
  SELECT conv_id, turn, role, text,
         CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
                                                                 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS exchange_no
  FROM conversations
),
ex AS (
  SELECT conv_id, exchange_no,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS "user",
         min(turn) FILTER (WHERE role = 'user') AS opened_at,
         arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant
  FROM numbered WHERE exchange_no > 0 GROUP BY conv_id, exchange_no
)"""


def hist_sql(n: int) -> str:
    return f"""
hist AS (
  SELECT e.conv_id, e.exchange_no, e."user", e.assistant, e.opened_at,
         coalesce(list(h."user" ORDER BY h.exchange_no) FILTER (WHERE h.conv_id IS NOT NULL), []::VARCHAR[])
           AS hist_user,
         coalesce(list(h.assistant ORDER BY h.exchange_no) FILTER (WHERE h.conv_id IS NOT NULL), []::VARCHAR[])
           AS hist_assistant,
         coalesce(string_agg({sql_str(H.QUESTION_LABEL)} || h."user" || {sql_str(chr(10) + H.ANSWER_LABEL + ' ')}
                             || h.assistant || {sql_str(chr(10) * 2)}, '' ORDER BY h.exchange_no)
                  FILTER (WHERE h.conv_id IS NOT NULL), '') AS hist_text,
         coalesce(flatten(list(['user', 'assistant'] ORDER BY h.exchange_no) FILTER (WHERE h.conv_id IS NOT NULL)),
                  []::VARCHAR[]) AS hist_roles,
         coalesce(flatten(list([h."user", h.assistant] ORDER BY h.exchange_no)
                          FILTER (WHERE h.conv_id IS NOT NULL)), []::VARCHAR[]) AS hist_contents
  FROM ex e
  LEFT JOIN ex h ON h.conv_id = e.conv_id AND h.assistant IS NOT NULL
                AND h.exchange_no BETWEEN e.exchange_no - {n} AND e.exchange_no - 1
  GROUP BY e.conv_id, e.exchange_no, e."user", e.assistant, e.opened_at
)"""


def _hist(spark, sf_dir, n):
    return H.history(H.exchanges(read_table(spark, sf_dir, "conversations")), n)


@query("history", with_sql(EX_SQL, hist_sql(H.CHAT_HISTORY), body="""
SELECT conv_id, exchange_no, "user", assistant, opened_at, hist_user, hist_assistant FROM hist"""))
def q_history(spark, sf_dir):
    return _hist(spark, sf_dir, H.CHAT_HISTORY)


@query("fewshot_prompt", with_sql(EX_SQL, hist_sql(H.FEWSHOT_HISTORY), body=f"""
SELECT conv_id, exchange_no,
       {sql_str(H.FEW_SHOT)} || hist_text || {sql_str(H.QUESTION_LABEL)} || "user" || {sql_str(chr(10) + H.ANSWER_LABEL)}
         AS prompt
FROM hist"""))
def q_fewshot_prompt(spark, sf_dir):
    h = _hist(spark, sf_dir, H.FEWSHOT_HISTORY)
    return h.select("conv_id", "exchange_no", H.fewshot_prompt().alias("prompt"))


@query("chat_messages", with_sql(EX_SQL, hist_sql(H.CHAT_HISTORY), body="""
SELECT conv_id, exchange_no, list_concat(hist_roles, ['user']) AS roles,
       list_concat(hist_contents, ["user"]) AS contents
FROM hist"""))
def q_chat_messages(spark, sf_dir):
    h = _hist(spark, sf_dir, H.CHAT_HISTORY)
    m = H.chat_messages()
    return h.select("conv_id", "exchange_no", m["roles"].alias("roles"), m["contents"].alias("contents"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '{PY_STRIP_PATTERN}', '', 'g')"


_S = _strip_sql("text")
_CUT = f"CASE WHEN contains({_S}, 'Frage:') THEN {_strip_sql(f'split_part({_S}, ' + chr(39) + 'Frage:' + chr(39) + ', 1)')} ELSE {_S} END"


@query("clean_response", f"""
SELECT conv_id, turn,
       CASE WHEN length({_CUT}) < 3 THEN '...' ELSE {_CUT} END AS fewshot_clean,
       CASE WHEN {_S} = '' THEN '...' ELSE {_S} END AS chat_clean
FROM conversations WHERE role = 'assistant'""")
def q_clean_response(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return conv.select("conv_id", "turn", clean_response("text", "fewshot").alias("fewshot_clean"),
                       clean_response("text", "chat").alias("chat_clean"))
