"""Chat rendering from every participant's point of view, in DataFrame operations only.

For each participant of a conversation the whole dialogue is rendered with that
speaker as the assistant, all others as named users and system turns as they
are. The rendering is kept as rows, one for each turn, with its place in the
whole and the span to learn from; places come from a running sum in two levels
(blocks of turns, turns), so a conversation of any length is no single task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

END = "<|end|>\n"
#: Turns of one block of the running sum.
BLOCK = 256


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, speaker, turn, role, segment, start, end, learn_from, learn_to) per conversation, participant and turn.

    ``segment`` is a header and the text up to an end mark; joined in order of
    ``start`` the segments are the dialogue as ``speaker``, characters ``start``
    to ``end`` each. ``learn_from`` to ``learn_to`` is what the assistant says,
    end mark included; in other turns it is empty, at ``end``. Markup inside a
    text or role is broken up, and line ends in a role become spaces, so that
    neither can pass for a header. Null text is empty, a null role is the
    participant ``unknown``, null turns come first; turns that tie stand in
    order of role and text; repeated rows are spoken twice. A conversation with
    system turns only has no participant and no rows. Other columns are ignored.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    t = t.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    speakers = t.where(F.col("role") != system).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    name = F.translate(F.replace(F.replace(F.col("role"), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), "\r\n", "  ")
    header = F.when(F.col("role") == system, F.lit("<|system|>\n")).when(F.col("role") == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user "), name, F.lit("|>\n")))
    t = t.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumn("header", header)
    t = t.withColumn("size", (F.length("header") + F.length("body") + len(END)).cast("long"))
    blocks = t.groupBy("conv_id", "speaker", "block").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("b")))
    inside = W.partitionBy("conv_id", "speaker", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "body").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("base") + F.sum("size").over(inside)
    t = t.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    own = F.col("role") == F.col("speaker")
    return t.select("conv_id", "speaker", "turn", "role", F.concat("header", "body", F.lit(END)).alias("segment"), "start", "end", F.when(own, F.col("start") + F.length("header")).otherwise(F.col("end")).alias("learn_from"), F.col("end").alias("learn_to"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
h AS (SELECT t.*, speaker, CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user ' || translate(replace(replace(role, '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') || '|>' || chr(10) END AS header
    FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, sum(length(header) + length(body) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM h)
SELECT conv_id, speaker, turn, role, header || body || '<|end|>' || chr(10) AS segment, "end" - length(header) - length(body) - 8 AS start, "end",
    CASE WHEN role = speaker THEN "end" - length(body) - 8 ELSE "end" END AS learn_from, "end" AS learn_to
FROM p
"""
