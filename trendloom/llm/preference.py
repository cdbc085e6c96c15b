"""Preference formatting: shared turn prefix as prompt, paired completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans (start, stop) in code points of the rendered turns that the loss covers: text and end mark of one role."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(acc, turn):
        head = acc["at"] + F.length(turn["role"]) + len(OPEN) + len(MIDDLE)
        stop = head + F.length(turn["text"]) + len(CLOSE)
        mine = F.when(turn["role"] == trained, F.array(F.struct(head.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], mine).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def even_and_odd(conversation: Column) -> tuple[Column, Column]:
    """Key and side of conversations 2k (chosen) and 2k + 1 (rejected), in whole numbers of any size; null for a null."""
    number = conversation.cast("long")
    return F.shiftright(number, 1), F.when(number.bitwiseAND(F.lit(1)) == 0, "chosen").when(number.isNotNull(), "rejected")


def gather_turns(turns: DataFrame, key: Column, side: Column) -> DataFrame:
    """(pair_id, chosen, rejected): turn arrays in order of turn, role and text; null roles and texts are empty.

    Turns without a key belong to no known pair: each is a row of its own with a null pair_id and no side, and they aren't
    gathered. Rows that are repeated whole are one turn; different rows of one turn number all stay, by role and text.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(key.alias("pair_id"), side.alias("side"), turn.alias("t"), F.when(key.isNull(), F.monotonically_increasing_id()).alias("alone"))
    pick = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("t"))))
    return rows.groupBy("pair_id", "alone").agg(pick("chosen").alias("chosen"), pick("rejected").alias("rejected")).drop("alone")


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """pairs(pair_id, chosen, rejected) with arrays of (turn, role, text) -> the pairs as training text.

    prefix_turns: turns from the start that are equal in role and text on both sides. prompt: those, rendered once.
    chosen / rejected: the rest of each side, rendered. *_mask: spans of those texts that the loss covers. A side without
    turns of its own (equal conversations, a missing or null side) gives an empty completion and an empty mask. Turn
    numbers play no part once turns are in order.
    """
    pairs = pairs.select("pair_id", F.coalesce(F.col("chosen").cast(TURN), F.array().cast(TURN)).alias("c"), F.coalesce(F.col("rejected").cast(TURN), F.array().cast(TURN)).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    n = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(n > 0, n - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side), F.lit(0)))
    return pairs.select(
        "pair_id", F.col("n").cast("long").alias("prefix_turns"), _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"), _render(rest("r")).alias("rejected"),
        _mask(rest("c"), trained).alias("chosen_mask"), _mask(rest("r"), trained).alias("rejected_mask"),
    )
