"""Rank fusion, document quotas and the retrieval modes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.dense import embed, knn, vectors_of
from lectern.operators.lexical import KEY, bm25, top
from lectern.runtime import settle

RANK_CONSTANT, POOL = 60, 30
MODES = ("dense", "bm25", "hybrid", "hybrid+rerank")


def fuse(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """(query_id, key, fused, best_rank, first_score, rank): weighted reciprocal rank fusion of ranked lists.

    The sum of weight / (60 + rank) over the lists; ties by best rank, then key. ``first_score`` is the largest first-stage score.
    As many weights as lists are needed."""
    weights = list(weights) if weights is not None else [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError(f"{len(lists)} lists but {len(weights)} weights")
    parts = [x.select("query_id", *key, "rank", "score", F.lit(float(w)).alias("w")) for x, w in zip(lists, weights)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    fused = every.repartition("query_id").groupBy("query_id", *key).agg(F.round(F.sum(F.col("w") / (RANK_CONSTANT + F.col("rank"))), 12).alias("fused"), F.min("rank").alias("best_rank"), F.max("score").alias("first_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "best_rank", *key))
    return fused.withColumn("rank", place)


def diversify(ranked: DataFrame, k: int, quota: Column | int | None) -> DataFrame:
    """The k hits of each query under a quota of hits a document, re-ranked from 1: those within the quota in rank order, then, if they
    are too few, the others in rank order. A quota that is NULL or below 1 is none."""
    limit = F.lit(quota).cast("int") if quota is None or isinstance(quota, int) else quota
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    over = F.coalesce((place > limit) & (limit >= 1), F.lit(False))
    rows = ranked.withColumn("_over", over)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("_over", "rank"))
    return rows.withColumn("_place", final).where(F.col("_place") <= k).drop("rank", "_over").withColumnRenamed("_place", "rank")


def auto_quota(question: Column, quota: Column, n_documents: Column, k: int) -> Column:
    """The quota, or, of a comparative question without one over several documents, half of k."""
    return F.when(quota.isNull() & (n_documents > 1) & T.looks_comparative(question), F.greatest(F.lit(1), F.floor(F.lit(k) / 2)).cast("int")).otherwise(quota)


def overlap_scorer(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's tokens that the text has."""
    return T.lexical_overlap(question, text)


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], Iterable[float]]], batch: int = 16):
    """A function (question, text) -> score for ``scorer`` arguments around a model of the caller's: ``load`` gives, once a worker, a function
    of a list of pairs, called with ``batch`` pairs at a time."""
    made: list = []

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if not made:
            made.append(load())
        for questions, texts in batches:
            pairs = [(q or "", t or "") for q, t in zip(questions, texts)]
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in made[0](pairs[i : i + batch])], dtype="float64")

    return lambda question, text: run(question, text)


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, scorer=overlap_scorer, key: Sequence[str] = KEY) -> DataFrame:
    """Candidates ordered anew by ``scorer(question, text)``; equal scores keep the order they had. Texts are joined last, for candidates only.

    Where an index holds the tokens the stand-in scorer reads these, a chunk's as one string between blanks, which is shorter to send than an array, and a question's taken once."""
    if scorer is overlap_scorer and "tokens" in chunks.columns:
        asked = queries.select("query_id", F.array_distinct(T.tokens("question")).alias("_asked"))
        told = chunks.select(*key, F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).alias("_told"))
        had = F.size(F.filter("_asked", lambda t: F.contains(F.col("_told"), F.concat(F.lit(" "), t, F.lit(" ")))))
        score = F.when(F.size("_asked") == 0, 1.0).otherwise(had / F.size("_asked"))
    else:
        asked, told, score = queries.select("query_id", F.col("question").alias("_asked")), chunks.select(*key, F.col("text").alias("_told")), scorer(F.col("_asked"), F.col("_told"))
    rows = candidates.join(asked, "query_id").join(told, list(key)).withColumn("score", F.round(score, 9)).drop("_asked", "_told")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank")))
    return rows.withColumn("_place", place).drop("rank").withColumnRenamed("_place", "rank")


def first_stage(chunks: DataFrame, queries: DataFrame, depth: int = POOL, weights: Sequence[float] | None = None, embedder=embed) -> DataFrame:
    """(query_id, doc_id, chunk_id, rank, score): the fused candidates of both arms, settled, for re-rankers to share between models and runs."""
    dense = knn(vectors_of(chunks, embedder), queries.select("query_id", embedder("question").alias("embedding")), depth)
    return settle(fuse([dense, bm25(chunks, queries, depth)], weights).where(F.col("rank") <= depth).select("query_id", *KEY, "rank", F.col("fused").alias("score")))


def retrieve(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid+rerank", k: int = 5, quota: Column | int | None = None, pool: int = POOL, weights: Sequence[float] | None = None, scope: DataFrame | None = None, scorer=overlap_scorer, embedder=embed) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, rank): the k passages of every question in one plan.

    ``chunks`` has the key and text, ``queries`` query_id and question. Modes with two arms take max(pool, k) candidates from each and fuse
    them into a pool; single modes take as many when a quota is set, else k. An unknown mode is an error; an empty library gives no rows."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    single = mode in ("dense", "bm25")
    depth = k if single and quota is None else max(pool, k)

    def dense() -> DataFrame:
        return knn(vectors_of(chunks, embedder), queries.select("query_id", embedder("question").alias("embedding")), depth, scope=scope)

    def lexical() -> DataFrame:
        return bm25(chunks, queries, depth, scope=scope)

    if single:
        ranked = dense() if mode == "dense" else lexical()
    else:
        ranked = fuse([dense(), lexical()], weights).where(F.col("rank") <= max(pool, k)).withColumn("score", F.col("fused"))
        if mode == "hybrid+rerank":
            ranked = rerank(ranked, queries, chunks, scorer)
    return diversify(ranked, k, quota).select("query_id", *KEY, "score", "rank")
