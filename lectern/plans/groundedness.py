"""Groundedness of answers: claims, verdicts, citations and their means, over many answers at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evaluation

CLAIMS, ANSWER_CHARS, CONTEXT_CHARS = 8, 4000, 9000


def _call(model: Callable[..., str], fallback: str):
    @F.pandas_udf("string")
    def call(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> str:
            try:
                return model(x, y)
            except Exception:
                return fallback

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return call


def evaluate(answers: DataFrame, claim_model: Callable[[str, str], str], judge_model: Callable[[str, str], str]) -> DataFrame:
    """(id, claims, verdicts, total, valid, supplied, distinct_valid, faithfulness, contradiction_rate, validity, utilisation) of
    (id, answer, context, n_supplied).

    ``claim_model(answer, "")`` lists claims a line, at most CLAIMS of which are judged by ``judge_model(claim, context)``. A failing claim
    model gives no claims, a failing judge UNSUPPORTED; ratios that do not apply are NULL. One row a claim travels, so a long answer
    is judged by many tasks."""
    rows = answers.withColumn("claims", F.slice(F.when(T.strip("answer") == "", F.array().cast("array<string>")).otherwise(T.claims(_call(claim_model, "NONE")(F.substring("answer", 1, ANSWER_CHARS), F.lit("")))), 1, CLAIMS))
    rows = rows.select("id", "answer", "context", "n_supplied", F.coalesce("claims", F.array().cast("array<string>")).alias("claims"))
    judged = rows.select("id", "context", F.posexplode("claims").alias("k", "claim")).withColumn("v", T.verdict(_call(judge_model, "UNSUPPORTED")("claim", F.substring("context", 1, CONTEXT_CHARS))))
    verdicts = judged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("v")).select("id", F.transform("v", lambda x: x.v).alias("verdicts"))
    out = rows.join(verdicts, "id", "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast("array<string>")))
    out = out.select("id", "claims", "verdicts", evaluation.citation_counts(F.col("answer"), F.col("n_supplied")).alias("c"), evaluation.verdict_ratios(F.col("verdicts")).alias("r"))
    return out.select("id", "claims", "verdicts", "c.*", "r.*").withColumn("validity", evaluation.ratio(F.col("valid"), F.col("total"))).withColumn("utilisation", evaluation.ratio(F.col("distinct_valid"), F.col("supplied")))


def summary(reports: DataFrame) -> DataFrame:
    """Macro means over the answers to which a ratio applies, and the number of claims."""
    means = [F.round(F.avg(c), 4).alias(c) for c in ("faithfulness", "contradiction_rate", "validity", "utilisation")]
    return reports.agg(*means, F.sum(F.size("claims")).alias("n_claims"), F.count(F.lit(1)).alias("n_answers"))
