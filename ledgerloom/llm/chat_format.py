"""Preference pairs from conversations: one prompt and two masked completions, by DataFrame functions only.

The longest prefix of turns that the chosen and the rejected conversation have in common (same role, same text) is
rendered once as the prompt; what is left of each becomes a completion. A completion's mask says character by character
what is learnt: the text of assistant turns and the mark after it, not headers and not what others say. It is written as runs,
such as "0*14 1*120".

Turns of a conversation are ordered by turn, ties by role and text; repeated rows are kept as turns of their own. Null
roles and texts count as empty when rendered and are equal to each other only. If one side is missing, its completion is
empty, the prompt as well, and `complete` is false. If one side is a prefix of the other or equal to it, its completion
is empty. Turns without a conversation belong to none and are left out. Texts may hold any length and the marks
themselves; they are not changed. One shuffle, by pair; a pair's turns meet in one row, as they make one example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _mask(turn: Column) -> Column:
    learnt = F.when(turn["role"] == "assistant", F.lit(" 1*")).otherwise(F.lit(" 0*"))
    return F.concat(F.lit("0*"), F.length(_header(turn)).cast("string"), learnt, F.length(_body(turn)).cast("string"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns(pair_id, chosen boolean, turn, role, text) -> pair_id, n_common, complete, prompt, chosen, rejected,
    chosen_mask, rejected_mask."""
    rows = turns.select(F.col("pair_id").alias("pair_id"), F.col("chosen").alias("side"), F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")).alias("t"))
    rows = rows.filter("pair_id is not null and side is not null")
    sides = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), shorter), F.slice("b", F.lit(1), shorter), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first_other = F.array_position(same, False)
    sides = sides.withColumn("n_common", F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("long"))
    rest = {s: F.slice(s, F.col("n_common").cast("int") + 1, F.size(s)) for s in ("a", "b")}
    return sides.select(
        "pair_id",
        "n_common",
        ((F.size("a") > 0) & (F.size("b") > 0)).alias("complete"),
        _rendered(F.slice("a", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        _rendered(rest["a"]).alias("chosen"),
        _rendered(rest["b"]).alias("rejected"),
        F.array_join(F.transform(rest["a"], _mask), " ").alias("chosen_mask"),
        F.array_join(F.transform(rest["b"], _mask), " ").alias("rejected_mask"),
    )


def against_echoes(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> turns of pairs: a conversation up to its last assistant turn is chosen over
    the same one in which that turn only repeats the turn before it (and says nothing where there is none). A conversation
    without an assistant turn makes no pair."""
    turns = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", "role", "text", F.row_number().over(turns).alias("place"), F.lag("text").over(turns).alias("before"))
    rows = rows.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("place"))).over(W.partitionBy("conv_id"))).filter("place <= last")
    rows = rows.withColumn("chosen", F.explode(F.array(F.lit(True), F.lit(False))))
    text = F.when(F.col("chosen") | (F.col("place") < F.col("last")), F.col("text")).otherwise(F.coalesce("before", F.lit("")))
    return rows.select(F.col("conv_id").alias("pair_id"), "chosen", "turn", "role", text.alias("text"))


_RENDER = "array_to_string(list_transform({0}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '')"
_MASKS = "array_to_string(list_transform({0}, lambda t: '0*' || CAST(length(coalesce(t.role, '')) + 5 AS VARCHAR) || CASE WHEN t.role = 'assistant' THEN ' 1*' ELSE ' 0*' END || CAST(length(coalesce(t.text, '')) + 8 AS VARCHAR)), ' ')"
ORACLE = f"""
WITH p AS (SELECT *, row_number() OVER w AS place, lag(text) OVER w AS before FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
l AS (SELECT *, max(place) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM p),
t AS (SELECT conv_id AS pair_id, side, turn, role, CASE WHEN side = 0 OR place < last THEN text ELSE coalesce(before, '') END AS text FROM l, (VALUES (0), (1)) v(side) WHERE place <= last),
s AS (SELECT pair_id,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (side = 0), []) AS a,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (side <> 0), []) AS b FROM t GROUP BY pair_id),
n AS (SELECT *, CAST(coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, least(len(a), len(b))) AS BIGINT) AS n_common FROM s)
SELECT pair_id, n_common, len(a) > 0 AND len(b) > 0 AS complete,
  {_RENDER.format('a[1:n_common]')} AS prompt, {_RENDER.format('a[n_common + 1:]')} AS chosen, {_RENDER.format('b[n_common + 1:]')} AS rejected,
  {_MASKS.format('a[n_common + 1:]')} AS chosen_mask, {_MASKS.format('b[n_common + 1:]')} AS rejected_mask FROM n
"""
