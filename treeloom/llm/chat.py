"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns (same role, same text) is rendered once as the prompt; what
follows on either side is its completion. A completion's mask names the spans of characters, as
start-end pairs in code points of the completion, that count for the loss: the content and end mark
of assistant turns.

Only DataFrame functions are used; a pair is gathered once, by its id. Nulls: a null role is
rendered as `unknown`, a null text is empty; a null turn number sorts first; rows with a null
pair id form one pair. Turns with equal numbers follow role and text; repeated rows are repeated
turns. A side without turns gives an empty completion, and if one conversation is the beginning of
the other, its completion is empty. Template marks inside texts are broken up by a space. Very long texts are
rendered whole. Rows with a null side belong to neither. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a turn is BEGIN role NEWLINE text END NEWLINE.
BEGIN, END = "<|turn|>", "<|end|>"


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), _clean(F.coalesce(turn["role"], F.lit("unknown"))), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_clean(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    """Turns as text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column, role: str = "assistant") -> Column:
    """Spans of the rendered text that count for the loss."""
    sized = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("h"), F.length(_body(t)).alias("b"), F.coalesce(t["role"] == role, F.lit(False)).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        a = acc["at"] + t["h"]
        span = F.concat_ws("-", a.cast("string"), (a + t["b"]).cast("string"))
        return F.struct((a + t["b"] + 1).alias("at"), F.when(t["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(sized, start, step, lambda acc: acc["spans"]), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree in role and text."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean: which side), turn, role, text. A row per pair."""
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    sides = turns.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), turn))).alias("a"), F.array_sort(F.collect_list(F.when(~F.col("chosen"), turn))).alias("b")
    )
    cut = sides.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    cut = cut.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"), mask(F.col("a")).alias("chosen_mask"), render(F.col("b")).alias("rejected"), mask(F.col("b")).alias("rejected_mask"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """The stand-in for judged pairs: conversation 2k is chosen over 2k + 1. Turns without a conversation have no neighbour and are left out."""
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
                  '<|turn|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) AS head,
                  replace(coalesce(text, ''), '<|', '< |') || '<|end|>' AS body FROM conversations),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
             a.k IS NOT NULL AND b.k IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
      FROM (FROM t WHERE side = 0) a FULL JOIN (FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k),
n AS (SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n FROM m GROUP BY pair_id),
r AS (SELECT t.*, n.n, t.k <= n.n AS shared,
             coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY t.pair_id, side, t.k <= n.n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM t JOIN n USING (pair_id))
SELECT pair_id, n AS n_prompt_turns,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (shared AND side = 0), '') AS prompt,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (NOT shared AND side = 0), '') AS chosen,
       coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR, ',' ORDER BY k) FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (NOT shared AND side = 1), '') AS rejected,
       coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR, ',' ORDER BY k) FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM r GROUP BY pair_id, n"""
