import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import dense, evaluation, fusion, lexical, topk
from lectern.operators.topk import TopK
from lectern.plans import queries

CHUNK = "doc_id string, chunk_id int, text string"


def corpus(spark, texts):
    return spark.createDataFrame([(f"d{i % 3}", i, t) for i, t in enumerate(texts)], CHUNK)


def test_bm25_equals_the_formula(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 25))) for _ in range(40)]
    query = ["w1", "w2", "w2", "w29"]
    toks = [t.split() for t in texts]
    mean = sum(map(len, toks)) / len(toks)
    want = {}
    for i, t in enumerate(toks):
        s = 0.0
        for q in query:
            tf, df = t.count(q), sum(q in x for x in toks)
            if tf:
                s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
        if s:
            want[i] = round(s, 6)
    q = spark.createDataFrame([(1, " ".join(query)), (2, "the of")], "query_id int, question string")
    got = lexical.bm25(corpus(spark, texts), q, 100).collect()
    assert {r.chunk_id: round(r.score, 6) for r in got} == want and {r.query_id for r in got} == {1}
    assert lexical.bm25(corpus(spark, texts).limit(0), q, 5).count() == 0


def test_knn_is_exact_with_ties_and_scope(spark):
    rng = random.Random(2)
    vecs = [[rng.choice([0.0, 1.0]) for _ in range(4)] for _ in range(200)]
    v = spark.createDataFrame([(f"d{i % 2}", i, x) for i, x in enumerate(vecs)] + [("d0", 999, None)], "doc_id string, chunk_id int, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(1, vecs[0]), (2, vecs[1])], "query_id int, embedding array<double>")
    got = {(r.query_id, r.rank): r.chunk_id for r in dense.knn(v, q, 7).collect()}
    for n in (1, 2):
        order = sorted(range(200), key=lambda i: (-sum(a * b for a, b in zip(vecs[i], vecs[n - 1])), f"d{i % 2}", i))[:7]
        assert [got[n, k] for k in range(1, 8)] == order
    only = dense.knn(v, q, 3, scope=spark.createDataFrame([("d1",)], "doc_id string"))
    assert {r.doc_id for r in only.collect()} == {"d1"}
    assert dense.knn(v, q.limit(0), 3).count() == 0 and dense.knn(v.limit(0), q, 3).count() == 0


@pytest.mark.parametrize("cells", [1, 8_000_000])
def test_kept_rows_equal_brute_force_over_many_blocks(monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)  # one common term, or all, held for every chunk
    rng = np.random.default_rng(3)
    n, asked, words, k = 3_000, 40, 120, 7
    tokens = [rng.zipf(1.3, 30) % words for _ in range(n)]
    tokens[100:200] = [tokens[0]] * 100  # ties
    asks = sorted((q, t) for q in range(asked) for t in set((rng.zipf(1.2, 6) % words).tolist()))
    owner, slot = (np.array(x) for x in zip(*asks))
    weight = rng.uniform(0.1, 5, words)[slot]
    room = 1.5 * (0.25 + 0.75 * rng.uniform(0.5, 2, n))
    room[100:200] = room[0]
    want = np.zeros((asked, n))
    for c, t in enumerate(tokens):
        tf = np.bincount(t, minlength=words)
        np.add.at(want[:, c], owner, weight * (tf * 2.5 / (tf + room[c]))[slot])
    ids, names = pa.array(range(asked)), pa.table({"doc": range(n)})

    def best(scores, positive):
        rows = ((q, c, round(float(scores[q, c]), 9)) for q in range(asked) for c in sorted(range(n), key=lambda c: (-round(float(scores[q, c]), 9), c))[:k])
        return [r for r in rows if r[2] > 0 or not positive]

    def kept(top):
        return sorted(((r["query_id"], r["doc"], r["score"]) for b in top.found(ids) for r in b.to_pylist()), key=lambda r: (r[0], -r[2], r[1]))

    found, near = TopK(k, asked, 0.0), TopK(k, asked)
    v = rng.integers(0, 3, (n, 8)) * rng.choice([-1.0, 1.0, 1e3], (n, 1))
    q = rng.integers(0, 3, (asked, 8)).astype(float)
    q[0] = 0
    for i in [0, 50, *range(300, n, 450)]:
        to = min(n, {0: 50, 50: 300}.get(i, i + 450))
        block = tokens[i:to]
        lexical._score(np.full(to - i, 30), np.concatenate(block), words, room[i:to], 1.5, owner, slot, weight, found, found.block(names.slice(i, to - i)))
        dense._score(q, v[i:to], near, near.block(names.slice(i, to - i)))
    for got, expected in ((kept(found), best(want, True)), (kept(near), best(q @ v.T, False))):
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected] and np.allclose([x[2] for x in got], [x[2] for x in expected], atol=2e-9)


def test_questions_are_scored_together_and_cut_seldom(monkeypatch):
    rng = np.random.default_rng(4)
    n, asked, words, blocks = 200, 90, 40, 30
    owner, slot = np.repeat(np.arange(asked), 3), np.concatenate([rng.choice(words, 3, replace=False) for _ in range(asked)])
    calls = []

    class Counted(TopK):
        def add(self, *x):
            calls.append("add")
            super().add(*x)

        def cut(self):
            calls.append("cut")
            super().cut()

    found = Counted(5, asked, 0.0)
    for _ in range(blocks):
        lexical._score(np.full(n, 12), rng.integers(0, words, 12 * n), words, np.full(n, 1.5), 1.5, owner, slot, np.ones(len(slot)), found, found.block(pa.table({"doc": range(n)})))
    assert calls.count("add") <= blocks
    calls.clear()
    near, q = Counted(5, asked), rng.normal(size=(asked, 8))
    for _ in range(blocks):
        dense._score(q, rng.normal(size=(n, 8)), near, near.block(pa.table({"doc": range(n)})))
    assert calls.count("cut") <= blocks / 2


@pytest.mark.parametrize("scores", [[0.5, -0.25, 0.5, 1e-9, 0.0, -0.0, 0.5], [1e9, 1e9 + 1, 5.0, 5.000000001, 1e9, 0.0, 2.0], [np.nan, 1.0, np.inf, -np.inf, 1.0, 0.5, 1.0]])
def test_candidates_in_order_of_query_score_and_row(scores):
    q, s = np.array([1, 0] * 7), np.repeat(scores, 2)
    assert topk._order(q, s).tolist() == np.lexsort((np.arange(14), -s, q)).tolist() and topk._order(q[:0], s[:0]).tolist() == []


@pytest.mark.parametrize("groups", [1, 7])
def test_bm25_of_many_questions_equals_sums_in_double(monkeypatch, groups):
    monkeypatch.setattr(lexical, "ASKED", groups)
    rng = np.random.default_rng(5)
    n, asked, words, k = 400, 25, 60, 6
    tokens = [np.r_[rng.integers(0, words, 20), np.zeros(c % 50, int)] for c in range(n)]
    tokens[10:20] = [np.empty(0, int)] * 10
    owner, slot = np.repeat(np.arange(asked), 8), np.concatenate([rng.choice(words + 5, 8, replace=False) for _ in range(asked)])  # some are of no chunk
    weight, lens = rng.uniform(1e-6, 9, len(slot)), np.array([len(t) for t in tokens])
    room = 1.5 * (0.25 + 0.75 * lens / lens.mean())
    tf = np.array([np.bincount(t, minlength=words + 5) for t in tokens])
    want = np.zeros((asked, n))
    np.add.at(want, owner, weight[:, None] * (tf * 2.5 / (tf + room[:, None])).T[slot])
    want = np.round(want, 9)
    found = TopK(k, asked, 0.0)
    for i in range(0, n, 100):
        lexical._score(lens[i : i + 100], np.concatenate(tokens[i : i + 100]), words + 5, room[i : i + 100], 1.5, owner, slot, weight, found, found.block(pa.table({"doc": range(i, i + 100)})))
    found.cut()
    q, row, s = found.best
    for a in range(asked):
        best = sorted(range(n), key=lambda c: (-want[a, c], c))[:k]
        assert row[q == a].tolist() == best and np.allclose(s[q == a], want[a, best], atol=2e-9)


def test_a_task_a_core_returns_its_best(spark):
    """No more than k rows a question and core are shuffled, in however many parts the chunks lie."""
    chunks = corpus(spark, [f"jet w{i % 7}" for i in range(64)]).repartition(64)
    asked = spark.createDataFrame([(1, "jet w3")], "query_id int, question string")
    vectors = chunks.select("doc_id", "chunk_id", F.array(F.lit(1.0), F.col("chunk_id").cast("double")).alias("embedding"))
    for hits in (lexical.bm25(chunks, asked, 2), dense.knn(vectors, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>"), 2)):
        tasks = hits.select(F.spark_partition_id()).count() and "Coalesce 4" in hits._jdf.queryExecution().toString()
        assert tasks and hits.count() == 2


def test_rerank_reads_tokens_of_an_index(spark):
    chunks = corpus(spark, ["Jet speed, kzz-2 model", "jets", "", None, "speed of the JET_s"]).withColumn("tokens", T.tokens("text"))
    asked = spark.createDataFrame([(1, "jet speed of kzz"), (2, "the of"), (3, None), (4, "kzz-2 2 jet jet")], "query_id int, question string")
    every = asked.crossJoin(chunks).select("query_id", "doc_id", "chunk_id", F.col("chunk_id").alias("rank"))
    rows = lambda x: sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in fusion.rerank(every, asked, x).collect())
    assert rows(chunks) == rows(chunks.drop("tokens")) and rows(chunks.drop("text")) == rows(chunks)


def test_fusion_and_quota(spark):
    kind = "query_id int, doc_id string, chunk_id int, score double, rank int"
    a = spark.createDataFrame([(1, "a", 1, 9.0, 1), (1, "a", 7, 8.0, 2), (1, "b", 2, 7.0, 3)], kind)
    b = spark.createDataFrame([(1, "b", 4, 5.0, 1), (1, "a", 7, 4.0, 2), (1, "c", 3, 3.0, 3)], kind)
    assert fusion.fuse([a, b]).where("rank = 1").first().chunk_id == 7
    assert fusion.fuse([a, b], [1, 3]).where("rank = 1").first().chunk_id in (4, 7)
    with pytest.raises(ValueError):
        fusion.fuse([a, b], [1.0])
    hits = spark.createDataFrame([(1, d, i, 1.0, i + 1) for i, d in enumerate("aaab")], kind)
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert order(fusion.diversify(hits, 3, 2)) == [0, 1, 3] and order(fusion.diversify(hits, 3, None)) == [0, 1, 2] and order(fusion.diversify(hits, 4, 1)) == [0, 3, 1, 2] and order(fusion.diversify(hits, 3, 0)) == [0, 1, 2]


@pytest.mark.parametrize("mode", fusion.MODES)
def test_modes(spark, mode):
    chunks = corpus(spark, ["atmosphere kzz model", "atmosphere study of dust", "jet speed near poles", "", None])
    q = spark.createDataFrame([(1, "kzz atmosphere"), (2, "zzz")], "query_id int, question string")
    got = fusion.retrieve(chunks, q, mode, 2).orderBy("query_id", "rank").collect()
    assert got[0].chunk_id == 0 and all(r.rank <= 2 for r in got)
    with pytest.raises(ValueError):
        fusion.retrieve(chunks, q, "magic")


def test_metrics_count_misses(spark):
    q = spark.createDataFrame([(1, "haze", ["thick haze"]), (2, None, ["no such"]), (3, "", [])], "query_id int, paper string, must_contain array<string>")
    chunks = spark.createDataFrame([("a", 0, "Thick haze here"), ("b", 1, "nothing")], CHUNK)
    titles = spark.createDataFrame([("a", "On Haze layers"), ("b", "Other")], "doc_id string, title string")
    hits = spark.createDataFrame([(1, "b", 1, 1), (1, "a", 0, 2), (2, "a", 0, 1), (3, "b", 1, 1)], "query_id int, doc_id string, chunk_id int, rank int")
    m = evaluation.retrieval_metrics(evaluation.first_ranks(hits, q, chunks, titles), 2).first()
    assert (m.n_queries, round(m.hit_rate, 4), round(m.mrr, 4), m.precision) == (3, 0.6667, 0.5, 1 / 3)


def test_bm25_metrics_as_the_first_query_of_a_session():
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("queries", e.queries()["a08_w05_bm25_metrics"](spark, "/root/testdata/sf0.001").first().n_queries)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300)
    assert "queries 8" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("name", ["r20_sweep", "k06_best_config"])
def test_no_shuffle_of_a_row_a_configuration_and_candidate(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*)\), [A-Z]", plan)
    assert keys and not [x for x in keys if "doc_id#" in x and re.search(r"\bg#", x)] and not [x for x in keys if "gq#" in x]


def test_ratios_are_null_where_nothing_counts(spark):
    rows = spark.createDataFrame([(["SUPPORTED", "SUPPORTED", "UNSUPPORTED", "CONTRADICTED"],), ([],)], "v array<string>")
    got = [tuple(r[0]) for r in rows.select(evaluation.verdict_ratios(F.col("v"))).collect()]
    assert got == [(0.5, 0.25), (None, None)]


def test_splits_resolve(spark):
    f = spark.createDataFrame([("c", "train", "haze"), ("c", "test", "Dust"), ("c", "val", "none"), ("c", "val", "o")], "cluster string, split string, fragment string")
    t = spark.createDataFrame([("Haze",), ("Haze on Titan",), ("Dust storms",), ("Left over",)], "title string")
    got = {r.fragment: (r.n_titles, r.title, r.problem) for r in evaluation.resolve_splits(f, t).collect()}
    assert got["haze"][:2] == (1, "Haze") and got["Dust"] == (1, "Dust storms", None) and got["none"][2] == "no match" and got["o"][2] == "several matches"
    with pytest.raises(ValueError, match="no match.*several matches.*no split: 'Haze on Titan'; no split: 'Left over'"):
        evaluation.require_resolved(evaluation.resolve_splits(f, t), t)
    good = evaluation.resolve_splits(f.where("fragment in ('haze', 'Dust')"), t.where("title in ('Haze', 'Dust storms')"))
    assert evaluation.require_resolved(good, t.where("title in ('Haze', 'Dust storms')")).count() == 2
    assert [r.title for r in evaluation.unassigned(t, evaluation.resolve_splits(f, t)).orderBy("title").collect()] == ["Haze on Titan", "Left over"]


def test_answerable_over_all_papers_that_a_title_names(spark):
    q = spark.createDataFrame([(1, "haze", ["thick"]), (2, "Haze layers", ["THICK", "sl^ow"]), (3, None, ["slow"]), (4, "", []), (5, "no such", []), (6, "haze", None), (1, "haze", ["thick"])], "query_id int, paper string, must_contain array<string>")
    chunks = spark.createDataFrame([("a", 0, "Thick and slow"), ("a", 1, None), ("b", 0, "thick"), ("c", 0, "slow")], CHUNK)
    titles = spark.createDataFrame([("a", "On HAZE layers"), ("b", "Haze"), ("c", "Other"), ("d", None)], "doc_id string, title string")
    got = {r.query_id: (r.n_chunks, r.unanswerable) for r in evaluation.answerable(q, chunks, titles).collect()}
    assert got == {1: (2, False), 2: (1, False), 3: (2, False), 4: (3, False), 5: (0, True), 6: (2, False)}
    assert evaluation.answerable(q.limit(0), chunks, titles).count() == 0 and evaluation.answerable(q, chunks.limit(0), titles.limit(0)).where("unanswerable").count() == 6


def test_balanced_negatives(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, F.col("id") % 9 == 0).alias("good"))
    got = evaluation.balanced(rows, "good", ["id"], 2)
    assert got.where("good").count() == 10 and got.where("not good").count() == 20
    assert evaluation.balanced(rows.limit(0), "good", ["id"]).count() == 0


def test_queries_of_a_run(spark):
    q = spark.createDataFrame([(1, "haze", "val"), (2, "Dust", "test"), (3, None, "val")], "query_id int, paper string, split string")
    titles = spark.createDataFrame([("a", "On Haze layers"), ("b", "Dust storms")], "doc_id string, title string")
    ids = lambda df: sorted(r.query_id for r in df.collect())
    assert ids(evaluation.pick_queries(q)) == [1, 2, 3] and ids(evaluation.pick_queries(q, "val")) == [1, 3] and ids(evaluation.pick_queries(q, limit=2)) == [1, 2]
    assert ids(evaluation.pick_queries(q, papers=["du", "zz"])) == [2]
    assert ids(evaluation.pick_queries(q, "heldout", titles=titles, held_out=["HAZE"])) == [1] and ids(evaluation.pick_queries(q, "trained", titles=titles, held_out=["haze"])) == [2, 3]
    with pytest.raises(ValueError):
        evaluation.pick_queries(q.withColumn("split", F.lit(None).cast("string")), "val")


def test_models_run_in_batches(spark):
    sizes = []

    def load():
        return lambda texts: [[3.0, 4.0] if t == "jet" else [0.0, 0.0] for t in texts]

    df = spark.createDataFrame([("jet",), (None,)], "x string")
    assert [list(r[0]) for r in df.select(dense.model_embedder(load, 1)("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]] and sizes == []
    scorer = fusion.model_scorer(lambda: lambda pairs: [len(t) for _, t in pairs], 2)
    hits = fusion.retrieve(corpus(spark, ["jet", "the jet speed", "jets"]), spark.createDataFrame([(1, "jet speed")], "query_id int, question string"), "hybrid+rerank", 2, scorer=scorer)
    assert [r.score for r in hits.orderBy("rank").collect()] == [13.0, 4.0]


def test_a_reranker_is_fitted_tuned_and_read_once(spark):
    from lectern.plans import reranker

    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    chunks = corpus(spark, texts)
    asks = [(i, " ".join(texts[i].split()[5:9]), f"d{i % 3}", [" ".join(texts[i].split()[5:7])]) for i in range(40)]
    examples = spark.createDataFrame([(q, texts[i], [texts[(i + 7) % 40], None]) for i, q, _, _ in asks[:20]], "question string, positive string, negatives array<string>")
    q = spark.createDataFrame([(i, question, None, must) for i, question, _, must in asks], "query_id int, question string, paper string, must_contain array<string>")
    titles = spark.createDataFrame([("d0", "A")], "doc_id string, title string")
    scorer, grid, test = reranker.tune(examples, fusion.first_stage(chunks, q, 10), q.where("query_id between 20 and 29"), q.where("query_id >= 30"), chunks, titles, (0.01, 1.0), (5, 10), 1)
    assert grid.count() == 4 and test.count() == 1 and test.first().hit_rate >= 0.9 and test.first().n_queries == 10
    r = spark.createDataFrame([("w1 w2", "w1 w2 w3", "w4 w5 w6")], "q string, a string, b string").select(scorer(F.col("q"), F.col("a")) > scorer(F.col("q"), F.col("b"))).first()
    assert r[0]
