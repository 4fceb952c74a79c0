"""The ask path as one plan over many questions: gate, retrieve, assemble."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import conversation, fusion

SYSTEM = "You answer questions about research papers from the excerpts you are given, and from nothing else. Cite the excerpt of every claim. Say so if the excerpts do not hold the answer."
INSTRUCTION = "Rely on these excerpts alone. After each statement of fact name the excerpt it comes from, in the form [Excerpt 1]."
REFUSAL = "There is nothing in the library that answers this question."


def context_of(hits: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, n_excerpts, context): the ranked passages of each question, labelled and joined in order.

    Texts are joined last, for hits only; a question's group is its k hits."""
    cited = T.citation(F.col("title"), F.col("page_start"), F.col("page_end"), F.col("section"))
    rows = hits.join(chunks, ["doc_id", "chunk_id"]).join(titles, "doc_id", "left")
    block = F.concat(T.excerpt_label(F.col("rank"), cited), F.lit("\n"), F.coalesce("text", F.lit("")))
    blocks = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return blocks.select("query_id", F.size("b").alias("n_excerpts"), F.array_join(F.transform("b", lambda x: x.block), "\n\n").alias("context"))


def prompts(questions: DataFrame, hits: DataFrame, chunks: DataFrame, titles: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(query_id, question, context, n_excerpts, messages): system, history and user messages of each question.

    ``questions`` has query_id and question, and conv_id if ``turns`` are given. A question without passages has a NULL context."""
    rows = questions.join(context_of(hits, chunks, titles), "query_id", "left")
    user = F.concat(F.lit("Context excerpts:\n\n"), "context", F.lit("\n\nQuestion: "), "question", F.lit("\n\n" + INSTRUCTION))
    first = F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content"))
    last = F.struct(F.lit("user").alias("role"), user.alias("content"))
    history = F.array().cast("array<struct<role:string,content:string>>")
    if turns is not None:
        said = conversation.messages(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "content"))).alias("said"))
        rows = rows.join(said, "conv_id", "left")
        history = F.coalesce(F.transform("said", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))), history)
    return rows.select("query_id", "question", "context", "n_excerpts", F.concat(F.array(first), history, F.array(last)).alias("messages"))


def generate(prompted: DataFrame, model: Callable[[list[dict[str, str]]], str]) -> DataFrame:
    """(query_id, answer): the one stage that leaves the JVM. ``model`` maps messages to text; it is called in the tasks, and not for
    questions without passages, which are answered with a fixed refusal. Its failure fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [REFUSAL if c is None else model([{"role": m["role"], "content": m["content"]} for m in ms]) for c, ms in zip(batch["context"], batch["messages"])]
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": said})

    kind = prompted.schema["query_id"].dataType.simpleString()
    return prompted.select("query_id", "context", "messages").mapInPandas(run, f"query_id {kind}, answer string")


def standalone(questions: DataFrame, turns: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """Adds ``retrieval_question``: questions that lean on their conversation are rewritten by ``model`` from its transcript; a missing or
    failing model leaves them as they are. The retriever sees the rewrite, the generator the question."""
    rows = questions.join(conversation.transcripts(turns), "conv_id", "left")
    if model is None:
        return rows.withColumn("retrieval_question", F.col("question")).drop("transcript")

    @F.pandas_udf("string")
    def rewrite(transcript: pd.Series, question: pd.Series) -> pd.Series:
        def one(t: str, q: str) -> str | None:
            try:
                return model(f"{t}\nFollow-up: {q}\n\nStandalone question:")
            except Exception:
                return None

        return pd.Series([one(t, q) for t, q in zip(transcript, question)], dtype=object)

    asks = F.col("transcript").isNotNull() & ~T.looks_self_contained("question")
    plain = rows.where(~asks).withColumn("retrieval_question", F.col("question"))
    led = rows.where(asks).withColumn("retrieval_question", T.accept_rewrite(F.col("question"), rewrite("transcript", "question")))
    return plain.unionByName(led).drop("transcript")


def wire(hits: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, excerpt, doc_id, title, citation, page_start, page_end, section, score, text): the rows that a service sends for the hits
    of each question, numbered by rank. Texts and titles are joined last, for hits only; a paper without a title has a NULL one."""
    rows = hits.select("query_id", "doc_id", "chunk_id", "score", F.col("rank").alias("excerpt")).join(chunks.select("doc_id", "chunk_id", "text", "page_start", "page_end", "section"), ["doc_id", "chunk_id"]).join(titles.select("doc_id", "title"), "doc_id", "left")
    cited = T.citation(F.col("title"), F.col("page_start"), F.col("page_end"), F.col("section"))
    return rows.select("query_id", "excerpt", "doc_id", "title", cited.alias("citation"), "page_start", "page_end", "section", "score", "text")


def stream(prompted: DataFrame, model: Callable[[list[dict[str, str]]], Iterable[str]]) -> Iterator[tuple]:
    """(query_id, fragment) as ``model`` gives them, empty fragments left out; the fixed refusal for a question without passages.

    For a reader who waits for one answer: prompts come to the driver one by one and their passages can be shown before."""
    for row in prompted.select("query_id", "context", "messages").toLocalIterator():
        pieces = [REFUSAL] if row.context is None else model([{"role": m.role, "content": m.content} for m in row.messages])
        yield from ((row.query_id, p) for p in pieces if p)


def ask(questions: DataFrame, chunks: DataFrame, titles: DataFrame, mode: str = "hybrid+rerank", k: int = 5, quota: int | None = None, turns: DataFrame | None = None, rewriter: Callable[[str], str] | None = None, scope: DataFrame | None = None, **options) -> DataFrame:
    """Prompts for all questions at once, from the conversation to the messages.

    With ``turns`` (conv_id, turn, question, answer), questions that lean on their conversation (conv_id) are rewritten by ``rewriter``
    for the search, and the prompt has the last turns and the question as it was asked. Comparative questions get half of k a
    paper unless a quota is set, if more than one paper is searched: those of ``scope`` (doc_id), else all. A k of 0 is the usual 5."""
    k = k or 5
    rows = standalone(questions, turns, rewriter) if turns is not None and "retrieval_question" not in questions.columns else questions
    searched = rows.select("query_id", F.col("retrieval_question" if "retrieval_question" in rows.columns else "question").alias("question"))
    n = (scope if scope is not None else titles).agg(F.countDistinct("doc_id")).scalar()
    limits = searched.select("query_id", fusion.auto_quota(F.col("question"), F.lit(quota).cast("int"), n, k).alias("_quota"))
    ranked = fusion.retrieve(chunks, searched, mode, max(k, fusion.POOL), None, scope=scope, **options)
    hits = fusion.diversify(ranked.join(limits, "query_id"), k, F.col("_quota"))
    return prompts(questions, hits.select("query_id", "doc_id", "chunk_id", "rank"), chunks, titles, turns)
