"""Building a benchmark and training examples from the library."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evaluation, lexical

MOST_OVERLAP, PASSAGE_CHARS = 0.45, 1500


def build(chunks: DataFrame, splits: DataFrame, model: Callable[[str], str], per_paper: int = 4, least_words: int = 70, seed: int = 7) -> DataFrame:
    """(id, lexical_overlap, split, doc_id, question, must_contain, source_chunk): questions generated from sampled chunks.

    Kept are usable questions that share at most 45 % of their terms with their chunk, with one or two evidence terms (the rarest of the chunk
    that the question lacks and another chunk has), which a chunk of the paper must be seen to hold. ``splits`` has doc_id and split; papers without one are left out."""
    pool = chunks.where(F.size(T.words("text")) >= least_words).join(splits, "doc_id")
    picked = evaluation.sample_by(pool, ["doc_id"], ["doc_id", "chunk_id"], per_paper, seed)

    @F.pandas_udf("string")
    def ask(passages: pd.Series) -> pd.Series:
        return pd.Series([model(p) for p in passages], dtype=object)

    asked = picked.withColumn("question", T.generated_question(ask(F.substring("text", 1, PASSAGE_CHARS)))).where(T.usable_question("question"))
    asked = asked.withColumn("lexical_overlap", T.lexical_overlap("question", "text")).where(F.col("lexical_overlap") <= MOST_OVERLAP)
    asked = asked.withColumn("id", F.concat_ws("-", "doc_id", "chunk_id"))
    terms = lexical.evidence(chunks, asked).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    made = asked.join(terms, "id").select("id", "lexical_overlap", "split", "doc_id", "question", F.transform("t", lambda x: x.term).alias("must_contain"), F.col("chunk_id").alias("source_chunk"))
    return verified(made, chunks)


def verified(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The questions that a chunk of their paper answers: one whose text holds all of must_contain. A test that nothing can pass is none."""
    texts = chunks.select("doc_id", F.lower("text").alias("_text")).where("_text is not null")
    hits = questions.select("id", "doc_id", "must_contain").join(texts, "doc_id").where(F.forall("must_contain", lambda p: F.contains(F.col("_text"), p)))
    return questions.join(hits.select("id").distinct(), "id", "left_semi")


def training_examples(benchmark: DataFrame, chunks: DataFrame, negatives: int = 3, pool: int = 10) -> DataFrame:
    """(question, positive, negatives, doc_id, chunk_index): each question's chunk and its hardest other chunks by BM25."""
    asked = benchmark.select(F.col("id").alias("query_id"), "question", "doc_id", F.col("source_chunk").alias("chunk_id"))
    hard = evaluation.hard_negatives(lexical.bm25(chunks, asked.select("query_id", "question"), pool), asked, negatives)
    texts = hard.join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("n"))
    rows = asked.join(chunks.select("doc_id", "chunk_id", F.col("text").alias("positive")), ["doc_id", "chunk_id"]).join(texts, "query_id")
    return rows.select("question", "positive", F.transform("n", lambda x: x.text).alias("negatives"), "doc_id", F.col("chunk_id").alias("chunk_index"))
