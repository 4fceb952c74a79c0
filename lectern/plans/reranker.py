"""A re-ranker that is fitted here: logistic regression over features of a question and a passage, tuned on one split and read once on another."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evaluation

Scorer = Callable[[Column, Column], Column]


def pair_features(question: Column, text: Column) -> list[Column]:
    """What a score is made of, in the JVM: the share of the question's tokens that the text has, how many they are, how much of the text
    they are, how often pairs of neighbouring tokens of the question stand in it, and the text's length. NULL text is empty."""
    q, t = T.tokens(question), T.tokens(text)
    common = F.size(F.array_intersect(q, t)).cast("double")
    neighbours = lambda x: F.array_distinct(F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    pairs = F.size(F.array_intersect(neighbours(q), neighbours(t))).cast("double")
    size = F.size(t).cast("double")
    return [T.lexical_overlap(question, text), F.log1p(common), common / F.greatest(size, F.lit(1.0)), F.log1p(pairs), F.log1p(size)]


def fit(examples: DataFrame, penalty: float = 0.01) -> Scorer:
    """A scorer for ``rerank`` from (question, positive, negatives), a column expression of the learned weights. The fit is distributed; what
    comes back is a weight a feature."""
    pair = F.explode(F.concat(F.array(F.struct(F.col("positive").alias("text"), F.lit(1.0).alias("label"))), F.transform("negatives", lambda n: F.struct(n.alias("text"), F.lit(0.0).alias("label")))))
    rows = examples.select("question", pair.alias("p")).select("question", "p.*")
    named = [f.alias(f"f{i}") for i, f in enumerate(pair_features(F.col("question"), F.col("text")))]
    rows = VectorAssembler(inputCols=[f"f{i}" for i in range(len(named))], outputCol="features").transform(rows.select("label", *named))
    weights = [float(w) for w in LogisticRegression(regParam=penalty, maxIter=50).fit(rows).coefficients]

    def scorer(question: Column, text: Column) -> Column:
        parts = [F.lit(w) * f for w, f in zip(weights, pair_features(question, text))]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    return scorer


def tune(examples: DataFrame, stage: DataFrame, validation: DataFrame, test: DataFrame, chunks: DataFrame, titles: DataFrame, penalties: Sequence[float] = (0.001, 0.01, 0.1), pools: Sequence[int] = (10, 30), k: int = 5) -> tuple[Scorer, DataFrame, DataFrame]:
    """(scorer, metrics on validation, metrics on test): fitted for every penalty, the best penalty and pool chosen on the validation queries by
    hit rate, then MRR, and the test queries read once with those. ``stage`` holds the shared first stage of both."""
    fitted = {f"penalty {p:g}": fit(examples, p) for p in penalties}
    grid = evaluation.model_sweep(stage, validation, chunks, titles, fitted, pools, k)
    order = F.row_number().over(evaluation.Window.orderBy("model", "pool"))  # a row a configuration
    grid = grid.withColumn("config_no", order)
    best = evaluation.best_config(grid).first()
    return fitted[best.model], grid, evaluation.model_sweep(stage, test, chunks, titles, {best.model: fitted[best.model]}, [best.pool], k)
