"""Conversation windows: the last turns as messages and as a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int, answer_chars: int) -> DataFrame:
    """(conv_id, turn, question, answer): the last n turns of each conversation, answers cut to ``answer_chars``. Rank below the shuffle bounds each group."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    rows = turns.withColumn("_place", place).where(F.col("_place") <= n)
    return rows.select("conv_id", "turn", "question", F.left(F.coalesce("answer", F.lit("")), F.lit(answer_chars)).alias("answer"))


def history_before(turns: DataFrame, n: int, answer_chars: int) -> DataFrame:
    """(conv_id, turn, history array<struct<question, answer>>): for every turn the n turns before it, oldest first."""
    one = F.struct("question", F.left(F.coalesce("answer", F.lit("")), F.lit(answer_chars)).alias("answer"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.select("conv_id", "turn", F.collect_list(one).over(before).alias("history"))


def transcripts(turns: DataFrame, n: int = 2, answer_chars: int = 300) -> DataFrame:
    """(conv_id, transcript): the last turns as lines "Q: ..." and "A: ..."."""
    rows = last_turns(turns, n, answer_chars).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("t"))
    lines = F.transform("t", lambda x: F.concat(F.lit("Q: "), F.coalesce(x.question, F.lit("")), F.lit("\nA: "), x.answer))
    return rows.select("conv_id", F.array_join(lines, "\n").alias("transcript"))


def messages(turns: DataFrame, n: int = 3, answer_chars: int = 600) -> DataFrame:
    """(conv_id, place, role, content): the last turns as user and assistant messages."""
    rows = last_turns(turns, n, answer_chars)
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    both = rows.select("conv_id", "turn", F.posexplode(pair).alias("k", "m"))
    return both.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")).alias("place"), "m.role", "m.content")
