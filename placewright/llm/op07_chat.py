"""Chat formatting.

A finite-state machine over roles checks the order of turns. A declarative template turns each turn into segments, of which
some are under the loss mask. Control strings of the template that occur in texts are escaped: a backslash goes in after
their first character, and where there are backslashes already one more, so that reading back takes exactly one out.

Defined results: null roles and texts are empty; roles without a template get the general one; a null conv_id is a
conversation of its own; turns with equal numbers are ordered by role and text, repeated rows are turns of their own;
conversations in a wrong order are formatted like others and flagged; empty tables give empty tables; other columns
of the input aren't read. A conversation is one text and so is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Segments by role: a text, or {text} or {role}, and whether it is under the loss mask.
TEMPLATE = {
    "system": [("<<SYS>>\n", False), ("{text}", False), ("\n<</SYS>>\n\n", False)],
    "user": [("<s>[INST] ", False), ("{text}", False), (" [/INST]", False)],
    "assistant": [(" ", False), ("{text}", True), (" </s>", False)],
}
GENERAL = [("[ROLE]", False), ("{role}", False), ("[/ROLE] ", False), ("{text}", False), (" </s>", False)]
#: What follows the first character of a control string.
_CONTROL = r"(/?s>|/?INST\]|</?SYS>>|/?ROLE\])"
#: State and role to the next state; a conversation is valid if it ends in a state of DONE.
MACHINE = {"start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"}
DONE = ("assistant",)
#: A turn as it stands in the output, in the order of the template above.
_TURN = r"(?s)<<SYS>>\n.*?\n<</SYS>>\n\n|<s>\[INST\] .*? \[/INST\]|\[ROLE\].*?\[/ROLE\] .*? </s>| .*? </s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def valid(roles: Column) -> Column:
    """Whether the machine takes this array of roles."""
    machine = F.create_map(*[F.lit(x) for pair in MACHINE.items() for x in pair])
    step = lambda state, role: F.coalesce(F.try_element_at(machine, F.concat(state, F.lit(">"), role)), F.lit("wrong"))
    return F.aggregate(roles, F.lit("start"), step).isin(*DONE)


def segments(turn: Column) -> Column:
    """The segments of a turn: an array of (text, loss)."""

    def filled(parts: list[tuple[str, bool]]) -> Column:
        fields = {"{text}": escaped(turn["text"]), "{role}": escaped(turn["role"])}
        return F.array(*[F.struct(fields.get(p, F.lit(p)).alias("text"), F.lit(loss).alias("loss")) for p, loss in parts])

    out = None
    for role, parts in TEMPLATE.items():
        out = (F if out is None else out).when(turn["role"] == role, filled(parts))
    return out.otherwise(filled(GENERAL))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, valid, segments and formatted of a table of conv_id, turn, role and text."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_turn"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    chats = chats.withColumn("valid", valid(F.transform("_turns", lambda t: t["role"]))).withColumn("segments", F.flatten(F.transform("_turns", segments))).drop("_turns")
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""

    def inner(piece: Column, parts: list[tuple[str, bool]]) -> Column:
        before, after = len(parts[0][0]), len(parts[-1][0])
        return piece.substr(F.lit(before + 1), F.length(piece) - (before + after))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "[/ROLE] ")
        out = F.when(piece.startswith("[ROLE]"), F.struct(unescaped(piece.substr(F.lit(7), at - 7)).alias("role"), unescaped(piece.substr(at + 8, F.length(piece) - at - 12)).alias("text")))
        for role in ("system", "user"):
            parts = TEMPLATE[role]
            out = out.when(piece.startswith(parts[0][0]), F.struct(F.lit(role).alias("role"), unescaped(inner(piece, parts)).alias("text")))
        return out.otherwise(F.struct(F.lit("assistant").alias("role"), unescaped(inner(piece, TEMPLATE["assistant"])).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = format_chats(rows).withColumn("turns", read_turns(F.col("formatted")))
    out = out.withColumn("learned", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|</?SYS>>|/?ROLE\])'))
    + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\]|</?SYS>>|/?ROLE\])')) END AS chars,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS last FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END) AND bool_or(last AND role = 'assistant') AS valid
FROM e GROUP BY conv_id
"""
