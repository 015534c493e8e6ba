"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as the assistant and all others as named users; a mask holds the
character spans to train on (the assistant's turns up to their end mark).

A dialogue comes in parts of ``part_turns`` turns, numbered from 0, so that one
with any number of turns is never gathered in one task; nearly all have one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.ordering import ranked_within

#: Marks of the rendered dialogue.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, NOBODY = "system", "unknown"


def _escaped(text: Column) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame, part_turns: int = 64) -> DataFrame:
    """(conv_id, speaker, part, n_turns, rendered, mask) for every participant of every dialogue.

    Turns stand in order of ``turn`` (null last), then role, then text, so ties
    and repeated rows have one result.  Participants are the distinct roles; a
    blank or null role speaks as user "unknown" and has no perspective, nor has
    "system", which stays system in all of them.  A null text is empty.  A
    dialogue without participants gives no row; a null ``conv_id`` is a
    dialogue of its own; an empty table gives an empty result.  ``mask`` lists
    spans "start-end" of the rendered part, end not included, comma-joined.
    """
    role = F.trim(F.col("role").cast("string"))
    turns = conversations.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_conv"), F.col("turn").cast("long").alias("_turn"),
        F.when(role.isNull() | (role == ""), NOBODY).otherwise(role).alias("_who"), _escaped(F.col("text").cast("string")).alias("_text"))
    keys = ["_none", "_conv"]
    placed = ranked_within(turns, keys, [F.col("_turn").asc_nulls_last(), F.col("_who"), F.col("_text")], into="_at")
    parts = placed.groupBy(*keys, F.floor(F.col("_at") / part_turns).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "_who", "_text"))).alias("_turns"))  # at most part_turns turns
    people = placed.filter(~F.col("_who").isin(SYSTEM, NOBODY)).select(*keys, F.col("_who").alias("speaker")).distinct()
    views = parts.join(people, keys)

    def head(t: Column) -> Column:
        mine, system = t["_who"] == F.col("speaker"), t["_who"] == SYSTEM
        return F.when(mine, f"{OPEN}assistant\n").when(system, f"{OPEN}system\n").otherwise(F.concat(F.lit(f"{OPEN}user name="), _escaped(t["_who"]), F.lit("\n")))

    rendered = F.array_join(F.transform("_turns", lambda t: F.concat(head(t), t["_text"], F.lit(f"{CLOSE}\n"))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(head(t))
        end = begin + F.length(t["_text"]) + len(CLOSE)
        span = F.when(t["_who"] == F.col("speaker"), F.array(F.concat_ws("-", begin, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], span).alias("spans"))

    mask = F.array_join(F.aggregate("_turns", start, step, lambda state: state["spans"]), ",")
    return views.select(
        F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), "speaker", "part", F.size("_turns").cast("long").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))
