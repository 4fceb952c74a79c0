import pytest

import random

from pyspark.sql import functions as F

from lectern.llm import cutoff
from lectern.llm.cutoff import WordTrie, cut_share, ending, endings, length_limits, trie_nodes, word_counts

COUNTS = {w: 500 for w in "the upper layer of haze is thick and mean speed jet rises with height in condensation".split()}
KIND = "doc_id long, text string, source string"


@pytest.mark.parametrize("text, how", [
    ("The upper layer of the haze is thick.", "closed"), ("The upper layer of the haze is thick and", "open"), ("The upper layer of the haze is thi", "open"), ("The upper layer of the haze is thick and the…", "mark"),
    ("The upper layer of the haze [...]", "mark"), ("The upper layer of the haze is thick. The mean of Smith et al.", "open"), ("The upper layer of the haze is thick.\nKeywords: jet, haze", "row"), ("The upper layer of the haze is thick.\na | b | 3 m", "row"),
    ("The upper layer of the haze is thick．", "closed"), ("0", "none"), ("", "none"), ("xxxx" * 100, "none"), ("a | b\nc | d", "none"), ("The upper layer of the haze is thick.\n2 Results", "row"),
])
def test_endings(text, how):
    assert ending(text, WordTrie(COUNTS))[0] == how


def test_trie():
    t = WordTrie({**COUNTS, "cond": 2, "hay": 400})
    assert t.cut_word("condens") and t.cut_word("cond") and not t.cut_word("haze") and not t.cut_word("zzz") and not t.cut_word("condensation")


def test_documents(spark):
    whole = "The upper layer of the haze is thick and the mean speed of the jet rises with the height in the layer. " * 3
    rows = [(i, whole, "s") for i in range(50)] + [(100, whole + "The upper lay", "s"), (101, None, "s"), (102, "", None), (103, whole + "The jet is", None), (104, whole * 3000, None)]
    rows += [(200 + i, (whole + f"\nx{i:03d} y | jet | 3").ljust(400, "7")[:400], "t") for i in range(9)]
    df = spark.createDataFrame(rows, KIND)
    got = {r.doc_id for r in endings(df).where("is_cut").collect()}
    assert got == {100, 103, *range(200, 209)}
    share = {r.source: (r.n_documents, r.n_cut) for r in cut_share(df).collect()}
    assert share == {"s": (51, 1), "t": (9, 9), "": (2, 1)}
    assert endings(df.limit(0)).count() == 0


def test_the_table_is_the_trie(spark):
    texts = ["The haze is thick. The hazel is thin. Hazy haze", "condensation condenses. Cond"]
    counts = word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    have = {r.w: (r.n, r.e) for r in counts.collect()}
    assert have["haze"] == (1, 0) and have["thick"] == (1, 1) and have["thin"] == (1, 1) and "cond" not in have
    trie = WordTrie({w: n for w, (n, _) in have.items()})
    nodes = {r.prefix: (r.own, r.longer) for r in trie_nodes(counts).collect()}
    for p in {w[:k] for w in have for k in range(1, len(w) + 1)}:
        lo, hi = trie.node(p)
        own = trie.known.get(p, 0)
        assert nodes[p] == (own, max((n for w, n in zip(trie.words[lo:hi], trie.counts[lo:hi]) if w != p), default=0))


def test_a_limit_is_found_in_small_and_large_sources(spark):
    rng = random.Random(1)
    for n, share in ((300, 0.05), (20_000, 0.01)):
        sizes = [(s, s, i) for i in range(n) for s in [200 if rng.random() < share else rng.randint(60, 3000)]]
        df = spark.createDataFrame([("s", *x) for x in sizes] + [(None, 500, 500, 7)] * 50, "source string, chars int, bytes int, digest long")
        assert {(r.source, r.measure, r.size) for r in length_limits(df).collect()} == {("s", "chars", 200), ("s", "bytes", 200)}


def test_copies_change_nothing_and_the_trie_decides(spark, data, monkeypatch):
    docs = spark.read.parquet(data + "/documents.parquet").select("doc_id", "text", "source")
    cut = lambda df: {(r.doc_id, r.is_cut) for r in endings(df).where("doc_id < 1000000").collect()}
    once = cut(docs)
    assert cut(docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select((F.col("doc_id") + F.col("k") * 1000000).alias("doc_id"), "text", "source")) == once
    monkeypatch.setattr(cutoff, "trie_nodes", lambda counts: trie_nodes(counts).limit(0))
    found, bare = ({i for i, c in rows if c} for rows in (once, cut(docs)))
    assert bare < found and len(bare) < 0.9 * len(found)


def test_planted_cuts(spark, data):
    docs = spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet").where("lang = 'en' and length(text) > 400").select("doc_id", "text", "source")
    whole = docs.where("rtrim(text) rlike '[a-z][.]$'")
    at = F.col("doc_id") % 180 + 180
    planted = whole.select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.left("text", at.cast("int")).alias("text"), "source").where(~F.col("text").rlike("[.!?]\\s*$"))
    rows = endings(docs.unionByName(planted)).join(planted.select("doc_id", F.lit(True).alias("cut")), "doc_id", "left").join(whole.select("doc_id", F.lit(True).alias("whole")), "doc_id", "left")
    r = rows.agg(F.count("cut").alias("n"), F.count(F.when(F.col("is_cut"), F.col("cut"))).alias("hit"), F.count(F.when(F.col("is_cut"), F.col("whole"))).alias("false"), F.count("whole").alias("w")).first()
    by_trie = rows.where("cut and is_cut and (broken or goes_on)").count()
    assert r.hit > 0.95 * r.n and r.false < 0.02 * r.w and by_trie > 0.7 * r.hit
