"""Preference pairs as one prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation becomes the prompt and is
rendered once; what follows on either side is a completion, of which only the assistant's own words and
their end mark are trained on.

Turns meet by (pair, turn), so a long conversation is compared in many tasks. A pair is one training sample
and one row, whatever its length: its turns are gathered once, where that row is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import pick, small, stored

# Marks of the chat format.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Text in which no mark of the format can stand: a bar after '<' gets a backslash in front, also where
    backslashes stand between them already, so taking one away gives the text back."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """The text that :func:`escaped` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), escaped(role), F.lit("\n"))


def _piece(turn: Column) -> Column:
    return F.concat(_head(turn["role"]), escaped(turn["text"]), F.lit(END + "\n"))


def _spans(turns: Column) -> Column:
    """[start, end) of the trained characters of rendered turns: assistants' texts with their end mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(
        "cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def step(state, turn):
        size = F.length(_piece(turn)).cast("bigint")
        span = F.struct((state["at"] + F.length(_head(turn["role"]))).alias("start"),
                        (state["at"] + size - 1).alias("end"))
        return F.struct((state["at"] + size).alias("at"), F.when(
            turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair: conv_id, prefix_turns, prompt, chosen, rejected, chosen_spans and rejected_spans.

    Both tables have conv_id, turn, role and text. A turn is common if role and text are equal (null equals
    null) and all turns before it are; a turn that one side lacks is not. Spans are character positions in the
    completion. Conversations that one side lacks give no row, nor do null conv_ids and turns. Null roles and texts are rendered
    empty. Of several rows for one turn the least (role, text) counts, nulls first. Equal conversations give
    empty completions. Other columns are ignored; empty tables give an empty result.
    """
    sides = None
    for name, df in (("c", chosen), ("r", rejected)):
        one = pick(df, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
        said = F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        one = one.select("conv_id", "turn", *[(said if name == side else F.lit(None).cast(
            "struct<role: string, text: string>")).alias(side) for side in "cr"])
        sides = one if sides is None else sides.unionByName(one)
    turns, _ = stored(sides.groupBy("conv_id", "turn").agg(F.min("c").alias("c"), F.min("r").alias("r")), "turns")
    ends, seen = stored(turns.groupBy("conv_id").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("cut"),
        F.max(F.col("c").isNotNull()).alias("has_c"), F.max(F.col("r").isNotNull()).alias("has_r"))
        .where("has_c AND has_r").select("conv_id", "cut"), "ends")
    placed = turns.join(small(ends, seen["rows"]), "conv_id").withColumn(
        "common", F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "common", "c", "r"))).alias("turns"))

    def of(side: str, common: bool) -> Column:
        kept = F.filter("turns", lambda t: (t["common"] == common) & t[side].isNotNull())
        return F.transform(kept, lambda t: t[side])

    def text(turns: Column) -> Column:
        return F.array_join(F.transform(turns, _piece), "")

    return rows.select(
        "conv_id", F.size(of("c", True)).alias("prefix_turns"), text(of("c", True)).alias("prompt"),
        text(of("c", False)).alias("chosen"), text(of("r", False)).alias("rejected"),
        _spans(of("c", False)).alias("chosen_spans"), _spans(of("r", False)).alias("rejected_spans"))
