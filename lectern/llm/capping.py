"""Problem 1: nested caps on the records of each contributor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranking import SMALL, latest_by, place_within, rank_within


@dataclass(frozen=True)
class Level:
    """One level of a nested cap: at most ``cap`` records (a number or a column name), or a ``share``
    of the records that come in, for each value of ``keys``. The keys of an outer level are a subset
    of those of the inner one, which makes the caps a laminar family."""

    keys: Sequence[str]
    cap: int | str | None = None
    share: float | None = None


def best_first(score: str, ties: Sequence[str]) -> list[Column]:
    """Higher score first; NULL and NaN after all numbers and equal to each other; then ``ties`` ascending."""
    number = F.when(~F.isnan(F.col(score)), F.col(score))
    return [number.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]


def cap_nested(df: DataFrame, levels: Sequence[Level], score: str, ties: Sequence[str], salts: int = 32) -> DataFrame:
    """Adds ``stays boolean`` and ``cut_at int`` (the level, from 1, whose cap cut the row; NULL if it stays).

    The caps form a laminar matroid, for which the greedy choice by score is optimal and equals
    taking the best of each innermost group, then of those the best of each next group, and so on:
    one ranked pass a level, inner first. A record cut at one level no longer counts at the next.
    A contributor with a third of all rows is ranked in many tasks: passes of small caps, and of caps in a column, are
    salted (``rank_within``), as at most salts times the cap survive; shares and caps beyond SMALL, which whole groups may survive,
    place rows by ranges of the score (``place_within``). A cap that is NULL or below 1 is no cap. A share is of the rows with the level's outer
    keys (all rows at the outermost level), rounded down but at least 1; its counts are aggregated
    before they are joined. Equal rows are told apart by nothing and either may stay; NULL keys form a
    group. An empty table gives an empty table; columns named ``stays`` or ``cut_at`` are replaced,
    and other extra columns stay as they are."""
    order, spread = best_first(score, ties), F.struct(*[F.col(c) for c in dict.fromkeys([*ties, score])])
    df = df.withColumn("cut_at", F.lit(None).cast("int"))
    for n, level in enumerate(levels, 1):
        outer = list(levels[n].keys) if n < len(levels) else []
        if level.share is not None:
            name = f"__cap_{n}"
            if outer:
                totals = df.groupBy(*[F.col(c).alias(f"__cap_of_{c}") for c in outer]).agg(F.count(F.lit(1)).alias("__cap_n"))
                df = df.join(totals, [F.col(c).eqNullSafe(F.col(f"__cap_of_{c}")) for c in outer], "left").drop(*[f"__cap_of_{c}" for c in outer])
            else:
                df = df.withColumn("__cap_n", df.agg(F.count(F.lit(1))).scalar())
            df = df.withColumn(name, F.greatest(F.lit(1), F.floor(F.col("__cap_n") * F.lit(level.share))).cast("int")).drop("__cap_n")
            cap = F.col(name)
        else:
            cap = F.lit(level.cap).cast("int") if not isinstance(level.cap, str) else F.col(level.cap)
            cap = F.when(cap >= 1, cap)
        # rows cut before stand aside under a group of their own and use up no place
        df = df.withColumn("__cap_aside", F.when(F.col("cut_at").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")))
        if level.share is not None or isinstance(level.cap, int) and level.cap > SMALL:
            df = place_within(df, [*level.keys, "__cap_aside"], order, "__cap_at").withColumn("__cap_in", cap.isNull() | (F.col("__cap_at") <= cap)).drop("__cap_at")
        else:
            df = rank_within(df, [*level.keys, "__cap_aside"], order, cap, spread, "__cap_in", salts)
        df = df.withColumn("cut_at", F.when(F.col("cut_at").isNull() & ~F.col("__cap_in"), F.lit(n)).otherwise(F.col("cut_at"))).drop("__cap_aside", "__cap_in", f"__cap_{n}")
    return df.withColumn("stays", F.col("cut_at").isNull())


def capped_hits(retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """The retrieved chunks of the answers that have a cap, as ``cap_nested`` leaves them.

    ``doc_id`` is compared in lower case without spaces around it. Of a chunk logged more than once
    the row with the latest ``logged_at`` counts (ties: the better score, then the smaller rank); of an
    answer delivered more than once the latest. Rows without key, and answers that are not there, drop out."""
    hits = retrieved.select("answer_id", F.lower(F.trim("doc_id")).alias("doc_id"), "chunk_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), (-F.col("rank")).alias("back"), "logged_at").where("answer_id is not null and doc_id is not null and chunk_id is not null")
    hits = latest_by(hits, ["answer_id", "doc_id", "chunk_id"], "logged_at", ["score", "back"]).drop("back", "logged_at")
    caps = latest_by(answers.select("answer_id", "max_per_document", "answered_at"), ["answer_id"], "answered_at", ["max_per_document"]).where("max_per_document >= 1").drop("answered_at")
    return cap_nested(hits.join(caps, "answer_id"), [Level(("answer_id", "doc_id"), cap="max_per_document")], "score", ["chunk_id"])
