"""Measuring retrieval and answers: relevance, hit rates, groundedness, splits, sweeps, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.lexical import KEY
from lectern.operators.ranking import place_within


#: Most fragments of a split specification, which a person writes, and of those that are sent to the tasks at once.
SPEC = 10_000


def is_relevant(paper: Column, title: Column, phrases: Column, text: Column) -> Column:
    """A passage is relevant if it is of the query's paper (any, if none is named) and holds all phrases."""
    of_paper = paper.isNull() | (paper == "") | F.coalesce(F.contains(F.lower(title), F.lower(paper)), F.lit(False))
    body = T.unmarked(text)
    return of_paper & F.forall(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.contains(body, T.unmarked(p)))


def named_titles(fragments: DataFrame, titles: DataFrame) -> DataFrame:
    """(fragment, doc_id) of every title that holds a fragment, ignoring case; empty and NULL fragments give no row.

    The distinct fragments are sent to the tasks in passes of at most SPEC, as one automaton that reads each title once, so nothing
    is compared pair by pair. A title without text holds nothing."""
    spark = fragments.sparkSession
    spec = fragments.select("fragment").where("fragment <> ''").distinct()
    n = spec.count()
    passes = n // SPEC + 1
    kind = titles.schema["doc_id"].dataType.simpleString()
    rows = titles.where("title is not null and doc_id is not null").select("doc_id", "title")
    found = []
    for p in range(passes if n else 0):
        part = spec.where(F.pmod(F.xxhash64("fragment"), F.lit(passes)) == p) if passes > 1 else spec
        shared = spark.sparkContext.broadcast([r.fragment for r in part.collect()])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            by: dict[str, list[str]] = {}
            for f in shared.value:
                by.setdefault(f.lower(), []).append(f)
            machine = ahocorasick.Automaton()
            for low, all_ in by.items():
                machine.add_word(low, all_)
            machine.make_automaton()
            for batch in batches:
                out = [(f, d) for d, t in zip(batch["doc_id"], batch["title"]) for f in {f for _, fs in machine.iter(t.lower()) for f in fs}]
                yield pd.DataFrame(out, columns=["fragment", "doc_id"])

        found.append(rows.mapInPandas(run, f"fragment string, doc_id {kind}"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"fragment string, doc_id {kind}")


def answerable(queries: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, n_chunks, unanswerable): how many chunks are relevant to each of (query_id, paper, must_contain).

    The papers that queries name are matched with titles first, few with few; then queries meet the chunks of those papers by
    equi-join. The few queries that name no paper meet all chunks and are sent to the tasks, in passes of at most SPEC."""
    q = queries.select("query_id", "paper", "must_contain").distinct()
    named = q.where("paper <> ''")
    rows = named.join(named_titles(named.select(F.col("paper").alias("fragment")), titles).withColumnRenamed("fragment", "paper"), "paper").join(chunks.select(*KEY, "text"), "doc_id")
    free = q.where("paper is null or paper = ''")
    n = free.count()
    for p in range(n // SPEC + 1 if n else 0):
        part = free.where(F.pmod(F.xxhash64("query_id"), F.lit(n // SPEC + 1)) == p)
        rows = rows.unionByName(chunks.select(*KEY, "text").join(F.broadcast(part), F.lit(True)).select(*rows.columns))
    body = T.unmarked("text")
    holds = F.forall(F.coalesce("must_contain", F.array().cast("array<string>")), lambda x: F.contains(body, T.unmarked(x)))
    found = rows.where("text is not null").where(holds).groupBy("query_id").agg(F.countDistinct(F.struct(*KEY)).alias("n_chunks"))
    return q.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("n_chunks").isNull().alias("unanswerable"))


def pick_queries(queries: DataFrame, split: str = "all", papers: Sequence[str] = (), titles: DataFrame | None = None, held_out: Sequence[str] = (), limit: int | None = None, order: Sequence[str] = ("query_id",)) -> DataFrame:
    """The queries of a run: of one ``split``, of papers whose name holds one of ``papers``, the first ``limit`` of them by ``order``.

    A split that is neither "all", "heldout" nor "trained" is one of the label in the column ``split``, which all queries must have.
    Held out are queries whose paper is part of a title of ``titles`` that holds one of the fragments ``held_out``; "trained" is the rest."""
    if split in ("heldout", "trained"):
        low = F.lower("title")
        marked = titles.where(F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(f.lower())) for f in held_out], F.lit(False)), F.lit(False))).select("doc_id", "title")
        hit = named_titles(queries.select(F.col("paper").alias("fragment")), marked).select(F.col("fragment").alias("paper")).distinct()
        queries = queries.join(hit, "paper", "left_semi" if split == "heldout" else "left_anti")
    elif split != "all":
        if "split" not in queries.columns or not queries.where("split is null").isEmpty():
            raise ValueError("queries without split labels cannot be restricted to a split")
        queries = queries.where(F.col("split") == split)
    if papers:
        low = F.lower(F.coalesce("paper", F.lit("")))
        queries = queries.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in papers]))
    return queries if limit is None else queries.orderBy(*order).limit(limit)


def judged(hits: DataFrame, queries: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """The hits with ``relevant``. A column and no filter: Spark 4.1 may infer a filter on the phrases from one over these joins and put it below
    the join that brings the text, which then cannot be run."""
    rows = hits.join(queries.select("query_id", "paper", "must_contain"), "query_id").join(chunks.select(*KEY, "text"), list(KEY)).join(titles.select("doc_id", "title"), "doc_id", "left")
    relevant = F.coalesce(is_relevant(F.col("paper"), F.coalesce("title", F.lit("")), F.col("must_contain"), F.col("text")), F.lit(False))
    return rows.select(*hits.columns, relevant.alias("relevant"))


def first_ranks(hits: DataFrame, queries: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, first_rank, n_relevant) of every query; NULL and 0 where nothing relevant was found."""
    found = judged(hits, queries, chunks, titles).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.count_if("relevant").alias("n_relevant"))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))


def retrieval_metrics(firsts: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_queries, hit_rate, mrr, precision): misses count as 0, precision is out of k."""
    return firsts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.col("first_rank").isNotNull().cast("double")).alias("hit_rate"),
        F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
        F.avg(F.col("n_relevant") / k).alias("precision"),
    )


def citation_counts(answer: Column, n_supplied: Column) -> Column:
    """struct<total, valid, supplied, distinct_valid> of an answer's excerpt numbers."""
    n = T.cited_excerpts(answer)
    good = F.filter(n, lambda x: (x >= 1) & (x <= n_supplied))
    return F.struct(F.size(n).alias("total"), F.size(good).alias("valid"), n_supplied.alias("supplied"), F.size(F.array_distinct(good)).alias("distinct_valid"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where there is nothing to count."""
    return F.when(b > 0, a / b)


def verdict_ratios(verdicts: Column) -> Column:
    """struct<faithfulness, contradiction_rate>, NULL without verdicts."""
    n = F.size(verdicts)
    part = lambda v: ratio(F.size(F.filter(verdicts, lambda x: x == v)), n)
    return F.struct(part("SUPPORTED").alias("faithfulness"), part("CONTRADICTED").alias("contradiction_rate"))


def resolve_splits(fragments: DataFrame, titles: DataFrame) -> DataFrame:
    """(cluster, split, fragment, n_titles, title, problem): the one title that each fragment names; an equal title wins over those that hold it.

    Problems: "no match", "several matches", "two splits" (the title is named by another split too); NULL if there is none.
    The specification is a small file and is what is broadcast, after a check of its size; titles stay where they are."""
    n = fragments.count()
    if n > SPEC:
        raise ValueError(f"a split specification of {n} fragments; at most {SPEC} are sent to the tasks")
    f, t = F.lower(F.trim("fragment")), F.lower(F.trim("title"))
    spec = fragments.select("cluster", "split", "fragment").distinct()
    found = titles.select("title").distinct().join(F.broadcast(spec), F.contains(t, f)).withColumn("exact", t == f)
    pairs = spec.join(found, ["cluster", "split", "fragment"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    best = pairs.withColumn("any_exact", F.max("exact").over(Window.partitionBy("cluster", "split", "fragment"))).where("exact or not any_exact")
    one = best.groupBy("cluster", "split", "fragment").agg(F.count("title").alias("n_titles"), F.min("title").alias("title"))
    splits = F.size(F.collect_set(F.when(F.col("n_titles") == 1, F.col("split"))).over(Window.partitionBy("title")))
    problem = F.when(F.col("n_titles") == 0, "no match").when(F.col("n_titles") > 1, "several matches").when(splits > 1, "two splits")
    return one.withColumn("problem", problem)


def unassigned(titles: DataFrame, resolved: DataFrame) -> DataFrame:
    """Titles that no fragment names."""
    return titles.select("title").distinct().join(resolved.where("n_titles = 1").select("title"), "title", "left_anti")


def require_resolved(resolved: DataFrame, titles: DataFrame, most: int = 100) -> DataFrame:
    """``resolved`` if every fragment names one title, no title is in two splits and every title is named; else an error that lists all
    problems together, at most ``most`` of each kind by name and the number of the rest."""
    wrong = resolved.where("problem is not null").select(F.concat_ws(": ", F.concat_ws("/", "cluster", "split"), F.concat(F.lit("'"), "fragment", F.lit("'")), "problem").alias("what"))
    left = unassigned(titles, resolved).select(F.concat(F.lit("no split: '"), "title", F.lit("'")).alias("what"))
    said = []
    for rows in (wrong, left):
        n = rows.count()
        said += [r.what for r in rows.orderBy("what").limit(most).collect()] + ([f"and {n - most} more"] if n > most else [])
    if said:
        raise ValueError("; ".join(said))
    return resolved


def split_table(rows: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(cluster, a column a split, total): counts by cluster with a TOTAL row, from one pass over a rollup."""
    counts = [F.count(F.when(F.col("split") == s, 1)).alias(s) for s in splits]
    table = rows.rollup("cluster").agg(*counts, F.count(F.lit(1)).alias("total"), F.grouping("cluster").alias("_all"))
    return table.withColumn("cluster", F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col("cluster"))).drop("_all")


def sample_by(df: DataFrame, group: Sequence[str], key: Sequence[str], n: int, seed: int = 7) -> DataFrame:
    """n rows of each group in the order of a seeded MD5 of the key: a sample that any engine can repeat."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(order, *key))).where(F.col("_place") <= n).drop("_place")


def hard_negatives(candidates: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """The n best candidates of each query that are not its positive chunk, ranked from 1."""
    rest = candidates.join(positives.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return rest.withColumn("place", place).where(F.col("place") <= n)


def model_sweep(stage: DataFrame, queries: DataFrame, chunks: DataFrame, titles: DataFrame, scorers: Mapping[str, Callable[[Column, Column], Column]], pools: Sequence[int], k: int) -> DataFrame:
    """(model, pool, n_queries, hit_rate, mrr, precision): every re-ranker over every pool of one first stage (query_id, key, rank).

    Texts are joined once, each model scores a candidate once, and a pool is a limit on the first stage's ranks."""
    q = queries.select("query_id", "question", "paper", "must_contain").distinct()
    rows = stage.select("query_id", *KEY, "rank").join(q, "query_id").join(chunks.select(*KEY, "text"), list(KEY)).join(titles.select("doc_id", "title"), "doc_id", "left")
    relevant = F.coalesce(is_relevant(F.col("paper"), F.coalesce("title", F.lit("")), F.col("must_contain"), F.col("text")), F.lit(False))
    scores = F.array(*[F.struct(F.lit(n).alias("model"), F.round(f(F.col("question"), F.col("text")), 9).alias("s")) for n, f in scorers.items()])
    rows = rows.select("query_id", *KEY, "rank", relevant.alias("relevant"), F.explode(scores).alias("m")).select("query_id", *KEY, "rank", "relevant", "m.*")
    rows = rows.withColumn("pool", F.explode(F.array(*[F.lit(p) for p in pools]))).where(F.col("rank") <= F.col("pool"))
    place = F.row_number().over(Window.partitionBy("model", "pool", "query_id").orderBy(F.col("s").desc(), "rank"))
    hits = rows.withColumn("place", place).where((F.col("place") <= k) & F.col("relevant"))
    found = hits.groupBy("model", "pool", "query_id").agg(F.min("place").alias("first_rank"), F.count(F.lit(1)).alias("n_relevant"))
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(p).alias("pool")) for n in scorers for p in pools]))
    every = q.select("query_id").distinct().select("query_id", grid.alias("g")).select("query_id", "g.*")
    return retrieval_metrics(every.join(found, ["model", "pool", "query_id"], "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))), k, ["model", "pool"])


def balanced(df: DataFrame, positive: str, key: Sequence[str], times: int = 3, seed: int = 7) -> DataFrame:
    """All rows with ``positive``, and of the others at most ``times`` as many, the first in the order of a seeded MD5 of the key.

    The others are placed by ``place_within``, over as many tasks as they need. Rows with a NULL ``positive`` drop out."""
    most = df.agg(F.lit(times) * F.count(F.when(F.col(positive), 1))).scalar()
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    others = place_within(df.where(~F.col(positive)), [], [order, *[F.col(c) for c in key]], "_place")
    return df.where(F.col(positive)).unionByName(others.where(F.col("_place") <= most).drop("_place"))


def best_config(metrics: DataFrame) -> DataFrame:
    """The configuration with the best hit rate, then MRR; the first of equals by ``config_no``."""
    return metrics.orderBy(F.round("hit_rate", 9).desc(), F.round("mrr", 9).desc(), "config_no").limit(1)
