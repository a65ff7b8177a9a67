"""Chat history and prompt assembly over a table of turns.

Turns (conv, turn, role, text) become exchanges: a user turn opens exchange
k (k = running count of user turns), the first assistant turn after it is
its reply; system turns are not part of the history. For every exchange the
previous ``n`` complete exchanges form its history.

Scale: the running count is the skew-safe prefix sum; the history is built
without a window over the conversation - each complete exchange is copied to
the ``n`` exchanges that follow it and the copies meet in a group per
(conversation, exchange), at most ``n + 1`` rows, so a very long
conversation still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.operators.index import group_prefix_sum

# The few-shot preamble, the turn labels and the history
# lengths (chat 4 exchanges, few-shot 2).
FEW_SHOT = (
    "Frage: Hallo, wie geht es dir?\n"
    "Antwort: Mir geht es gut! Wie kann ich dir helfen?\n\n"
    "Frage: Was ist die Hauptstadt von Deutschland?\n"
    "Antwort: Die Hauptstadt von Deutschland ist Berlin.\n\n"
)
QUESTION_LABEL = "Frage: "
ANSWER_LABEL = "Antwort:"
CHAT_HISTORY = 4
FEWSHOT_HISTORY = 2


def exchanges(turns: DataFrame, key: str = "conv_id", pos: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(key, exchange_no, user, assistant, opened_at): one row per user turn;
    ``assistant`` is NULL when no reply follows before the next user turn."""
    flagged = turns.select(key, pos, role, text,
                           F.when(F.col(role) == "user", 1).otherwise(0).alias("__u"))
    numbered = group_prefix_sum(flagged, [key], [pos], "__u", "exchange_no", inclusive=True)
    numbered = numbered.where(F.col("exchange_no") > 0)  # turns before the first user turn
    grouped = numbered.groupBy(key, "exchange_no").agg(
        F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(pos)))
         .alias("user"),
        F.min(F.when(F.col(role) == "user", F.col(pos))).alias("opened_at"),
        F.min_by(F.when(F.col(role) == "assistant", F.col(text)),
                 F.when(F.col(role) == "assistant", F.col(pos))).alias("assistant"))
    return grouped


def history(ex: DataFrame, n: int, key: str = "conv_id") -> DataFrame:
    """Each exchange with the previous ``n`` complete exchanges, oldest first:
    ``hist_user``, ``hist_assistant`` (arrays of equal length)."""
    own = ex.select(key, "exchange_no", "user", "assistant", "opened_at",
                    F.lit(None).cast("struct<no:long,user:string,assistant:string>").alias("__h"))
    done = ex.where(F.col("assistant").isNotNull())
    copies = done.select(key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("__k"),
                         F.struct(F.col("exchange_no").alias("no"), "user", "assistant").alias("__h"),
                         "exchange_no")
    copies = copies.select(key, (F.col("exchange_no") + F.col("__k")).alias("exchange_no"),
                           F.lit(None).cast("string").alias("user"), F.lit(None).cast("string").alias("assistant"),
                           F.lit(None).cast("long").alias("opened_at"), "__h")
    both = own.unionByName(copies)
    g = both.groupBy(key, "exchange_no").agg(
        F.max(F.struct(F.col("__h").isNull().alias("o"), "user", "assistant", "opened_at")).alias("__own"),
        F.sort_array(F.collect_list("__h")).alias("__hist"))
    g = g.where(F.col("__own.o"))  # copies past the last exchange find no owner
    return g.select(key, "exchange_no", F.col("__own.user").alias("user"),
                    F.col("__own.assistant").alias("assistant"), F.col("__own.opened_at").alias("opened_at"),
                    F.col("__hist.user").alias("hist_user"), F.col("__hist.assistant").alias("hist_assistant"))


def fewshot_prompt(hist_user="hist_user", hist_assistant="hist_assistant", question="user") -> Column:
    """Preamble + ``Frage: u\\nAntwort: a\\n\\n`` per history exchange +
    ``Frage: q\\nAntwort:``."""
    pairs = F.zip_with(F.col(hist_user), F.col(hist_assistant),
                       lambda u, a: F.concat(F.lit(QUESTION_LABEL), u, F.lit("\n" + ANSWER_LABEL + " "), a,
                                             F.lit("\n\n")))
    return F.concat(F.lit(FEW_SHOT), F.array_join(pairs, ""), F.lit(QUESTION_LABEL), F.col(question),
                    F.lit("\n" + ANSWER_LABEL))


def chat_messages(hist_user="hist_user", hist_assistant="hist_assistant", question="user") -> Column:
    """Struct(roles, contents): user/assistant per history exchange, then the
    new user turn."""
    roles = F.concat(F.transform(F.array_repeat(F.lit(0), F.size(F.col(hist_user))),
                                 lambda _: F.array(F.lit("user"), F.lit("assistant"))),
                     F.array(F.array(F.lit("user"))))
    contents = F.concat(F.zip_with(F.col(hist_user), F.col(hist_assistant), lambda u, a: F.array(u, a)),
                        F.array(F.array(F.col(question))))
    return F.struct(F.flatten(roles).alias("roles"), F.flatten(contents).alias("contents"))
