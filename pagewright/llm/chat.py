"""Chat formatting by relational expressions only.

Turns are collected as structs and sorted, neighbours of one role are merged by array functions, and the
conversation is written as one string:

    [INST]role\\ntext<t>text[/INST]     for a run of turns whose role isn't trained on
    <s>role\\ntext<t>text</s>           for a run of turns whose role is (the loss mask: the texts within)

Control strings inside texts and roles get a backslash after their first character, and those that have
backslashes there get one more; reading takes one away, so every text comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTROL = r"(<|\[)(\\*)(/?s>|t>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(/?s>|t>|/?INST\])"
_END = r"\[/INST\]|</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """(conv_id, formatted): one string for each conversation.

    Turns go by (turn, role, text); nulls come first. Equal turn numbers are thus kept apart and in a fixed
    order, repeated rows stay repeated. A null role or text is empty; rows of a null conv_id are one
    conversation. A very long text is formatted whole. An empty table gives none. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # One conversation is one output row, so its turns meet anyway.
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = listed.withColumn("starts", starts)

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(
            F.get("turns", start)["role"].alias("role"),
            F.transform(F.slice("turns", start + 1, end - start), lambda t: escape(t["text"])).alias("texts"),
        )

    merged = cut.select("conv_id", F.transform("starts", run).alias("runs"))

    def shown(r: Column) -> Column:
        loss = r["role"].isin(*trained)
        return F.concat(
            F.when(loss, "<s>").otherwise("[INST]"), _escape_role(r["role"]), F.lit("\n"), F.array_join(r["texts"], "<t>"), F.when(loss, "</s>").otherwise("[/INST]")
        )

    return merged.select("conv_id", F.array_join(F.transform("runs", shown), "").alias("formatted"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns read back from the string, in order, with their loss flag."""
    pieces = F.split("formatted", _END)
    cut = formatted.select("conv_id", "formatted", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))

    def turns(piece: Column) -> Column:
        loss = piece.startswith("<s>")
        rest = F.when(loss, F.substring(piece, 4, 2**31 - 1)).otherwise(F.substring(piece, 7, 2**31 - 1))
        role = F.substring_index(rest, "\n", 1)
        body = F.substr(rest, F.length(role) + 2)
        return F.transform(
            F.split(body, "<t>"), lambda x: F.struct(_unescape_role(role).alias("role"), unescape(x).alias("text"), loss.alias("loss"))
        )

    return cut.select("conv_id", "formatted", F.flatten(F.transform("pieces", turns)).alias("turns"))


def digests(read: DataFrame) -> DataFrame:
    """What the read turns amount to, conversation by conversation."""
    masked = read.withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
    return masked.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_EXTRA = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and -7, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(read_conversations(format_conversations(rows.unionByName(spark.sql(_EXTRA)))))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         regexp_replace(text, '(<|\[)(\\*)(/?s>|t>|/?INST\])', '\1\\\2\3', 'g') AS shown,
         replace(replace(regexp_replace(role, '(<|\[)(\\*)(/?s>|t>|/?INST\])', '\1\\\2\3', 'g'), '\', '\b'), chr(10), '\n') AS called
  FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown) + CASE WHEN before IS NOT DISTINCT FROM role THEN 3
                                ELSE length(called) + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
