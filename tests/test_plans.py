import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators.ranking import carried, latest_by, place_within, rank_within
from lectern.operators import lexical
from lectern.plans import ask, benchmark, groundedness, service
from lectern.plans.index import index_pages
from lectern.sources import readers
from lectern.sources.store import Library
from lectern.streaming.ingest import current_chunks, ingest

CHUNK = "doc_id string, chunk_id int, text string, page_start int, page_end int, section string"


def test_entry(spark):
    assert len(entry.entry(spark).schema.fields) == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), "id").unionByName(spark.range(3).select(F.lit("b").alias("g"), "id"))
    got = rank_within(df, ["g"], [F.col("id").desc()], F.lit(4), F.col("id"), "top").where("top").groupBy("g").agg(F.sort_array(F.collect_list("id")).alias("x")).collect()
    assert {r.g: r.x for r in got} == {"a": [4996, 4997, 4998, 4999], "b": [0, 1, 2]}


def test_places_in_a_group_of_many_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 == 0, "b").alias("g"), "id", F.lit(0).alias("_n"))
    got = place_within(df, ["g"], [F.col("id").desc()], "place", 7).collect()
    want = {}
    for r in sorted(got, key=lambda r: -r.id):
        want[r.g] = want.get(r.g, 0) + 1
        assert r.place == want[r.g]
    assert len(got) == 5000 and place_within(df.limit(0), ["g"], [F.col("id")], "place").count() == 0
    # no window holds a whole key: the places are counted by key and range
    plan = place_within(df, ["g"], [F.col("id")], "place", 7)._jdf.queryExecution().toString()
    assert "_place_part" in plan


def test_what_is_carried_over_blocks_equals_plain_windows(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, None, "x", "y"]), rng.choice([None, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v string, n int").repartition(5)
    got = carried(df, ["k"], F.floor(F.col("i") / 50), ["i"], sums={"s": F.col("n")}, lasts={"l": F.col("v")}, before={"b": F.struct("v")})
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum(F.coalesce("n", F.lit(0))).over(upto)).withColumn("l", F.last("v", True).over(upto)).withColumn("b", F.lag(F.struct("v")).over(w))
    assert sorted(map(tuple, got.select("i", "s", "l", "b").collect())) == sorted(map(tuple, want.select("i", "s", "l", "b").collect()))
    # every window over rows is by block too
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert windows and all("_block" in x for x in windows)
    assert carried(df.limit(0), ["k"], F.col("i"), ["i"], sums={"s": F.col("n")}).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lectern.runtime import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_latest_prefers_values_over_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 3, "y"), (1, 3, "z"), (None, None, "n")], "k int, at int, v string")
    assert {(r.k, r.v) for r in latest_by(df, ["k"], "at", ["v"]).collect()} == {(1, "z"), (None, "n")}


def test_prompts_and_generation(spark):
    chunks = spark.createDataFrame([("a", 0, "The jet is fast.", 1, 1, "Results"), ("b", 0, "The haze is thick.", 2, 3, None)], CHUNK)
    titles = spark.createDataFrame([("a", "Jets")], "doc_id string, title string")
    q = spark.createDataFrame([(1, "How fast is the jet?"), (2, "zzz?")], "query_id int, question string")
    p = ask.ask(q, chunks, titles, "bm25", 2)
    got = {r.query_id: r for r in p.collect()}
    assert "[Excerpt 1] (Jets, p. 1, Section Results)\nThe jet is fast." in got[1].context and got[2].context is None
    said = {r.query_id: r.answer for r in ask.generate(p, lambda m: m[-1]["content"][-5:]).collect()}
    assert said[2] == ask.REFUSAL and len(said[1]) == 5
    turns = spark.createDataFrame([(7, 0, "Tell me of jets", "Fast.")], "conv_id int, turn int, question string, answer string")
    led = ask.standalone(spark.createDataFrame([(1, 7, "Why is it so?"), (2, 8, "Why?")], "query_id int, conv_id int, question string"), turns, lambda t: "Why are jets fast?")
    assert {r.query_id: r.retrieval_question for r in led.collect()} == {1: "Why are jets fast?", 2: "Why?"}
    # the whole path: searched by the rewrite, asked as it was said, with what was said before
    one = spark.createDataFrame([(1, 7, "Why is it so?")], "query_id int, conv_id int, question string")
    r = ask.ask(one, chunks, titles, "bm25", 2, turns=turns, rewriter=lambda t: "Is the jet fast?").first()
    assert "The jet is fast." in r.context and [m.role for m in r.messages] == ["system", "user", "assistant", "user"] and "Why is it so?" in r.messages[-1].content
    both = spark.createDataFrame([("a", i, f"jet speed {i}", 1, 1, "R") for i in range(4)] + [("b", 0, "the jet speed", 1, 1, "R")], CHUNK)
    two = spark.createDataFrame([("a", "A"), ("b", "B")], "doc_id string, title string")
    ids = lambda scope: sorted(ask.ask(spark.createDataFrame([(1, "compare jet speed")], "query_id int, question string"), both, two, "bm25", 2, scope=scope).first().context.count(x) for x in ("(A", "(B"))
    assert ids(None) == [1, 1] and ids(two.where("doc_id = 'a'")) == [0, 2]  # the quota holds where several papers are searched
    rows = ask.wire(spark.createDataFrame([(1, "a", 0, 0.5, 1)], "query_id int, doc_id string, chunk_id int, score double, rank int"), chunks, titles).first()
    assert (rows.excerpt, rows.title, rows.citation, rows.score) == (1, "Jets", "Jets, p. 1, Section Results", 0.5)
    assert list(ask.stream(p.orderBy("query_id"), lambda m: ["a", "", "b"])) == [(1, "a"), (1, "b"), (2, ask.REFUSAL)]


def test_groundedness(spark):
    a = spark.createDataFrame([(1, "The jet is fast [Excerpt 1].", "jet fast", 2), (2, "", "c", 0)], "id int, answer string, context string, n_supplied int")

    def judge(claim, context):
        if "slow" in claim:
            raise RuntimeError
        return "supported"

    r = groundedness.evaluate(a, lambda x, _: "The jet is really fast\nThe jet is never slow", judge)
    got = {x.id: x for x in r.collect()}
    assert got[1].faithfulness == 0.5 and got[1].utilisation == 0.5 and got[2].faithfulness is None and got[2].claims == []
    assert groundedness.summary(r).first().n_claims == 2


def test_benchmark_builder(spark):
    texts = [("a", i, "alpha beta common term%d shared%d " % (i, i % 2) + "filler words " * 40) for i in range(4)]
    chunks = spark.createDataFrame(texts, "doc_id string, chunk_id int, text string")
    b = benchmark.build(chunks, spark.createDataFrame([("a", "test")], "doc_id string, split string"), lambda p: "Question: What quantity limits the speed of jets?", 2)
    rows = b.collect()
    assert len(rows) == 2 and all(r.split == "test" and 1 <= len(r.must_contain) <= 2 for r in rows)
    assert benchmark.verified(b, chunks).count() == 2 and benchmark.verified(b.withColumn("must_contain", F.array(F.lit("no such"))), chunks).count() == 0
    b2 = spark.createDataFrame([("q", 0.1, "test", "a", "alpha shared0?", ["x"], 0)], b.schema)
    assert benchmark.training_examples(b2, chunks).first().positive == texts[0][2]


def test_library_round_trip(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.load()[0].count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first_paper.txt").write_text("Introduction\n" + "The jet is fast here. " * 40 + "\f" + "It goes on. " * 30)
    (tmp_path / "in" / "empty.txt").write_text("  ")
    pages, rejects = readers.read_documents(spark, str(tmp_path / "in"))
    assert rejects.count() == 1
    docs, chunks = index_pages(pages.drop("path"), pages.select("doc_id", "path"))
    lib.add(docs, chunks)
    d, c = lib.load()
    assert d.first().title == "first paper" and c.count() == d.first().n_chunks > 0
    with pytest.raises(ValueError):
        lib.add(docs, chunks)
    assert c.first().tokens[:2] == ["introduction", "jet"]
    more = docs.withColumn("doc_id", F.lit("other")), chunks.withColumn("doc_id", F.lit("other"))
    lib.add(*more, spark.createDataFrame([("other", "a.pdf", bytearray(b"x"))], "doc_id string, path string, content binary"))
    assert lib.load()[0].count() == 2 and lib.originals().first().path == "a.pdf"
    m = lib._manifest()
    assert sorted(set(m["live"].values())) == [1, 2]  # the second change wrote one bucket only
    with pytest.raises(ValueError, match="another writer"):
        lib._commit(m)
    with pytest.raises(ValueError, match="vectors"):
        lib.add(docs.withColumn("doc_id", F.lit("third")), chunks.withColumn("doc_id", F.lit("third")).withColumn("embedding", F.array(F.lit(1.0))))
    asked = spark.createDataFrame([(1, "How fast is the jet?")], "query_id int, question string")
    have = [x for _, x in zip(range(2), lib.load())][1]
    assert {(r.query_id, r.chunk_id) for r in lexical.bm25(have.drop("text"), asked, 50).collect()} == {(r.query_id, r.chunk_id) for r in lexical.bm25(have.drop("tokens"), asked, 50).collect()}
    assert not lib.remove("none") and lib.remove(d.first().doc_id, "other") and lib.load()[0].count() == 0 and lib.originals().count() == 0


def test_layouts_become_pages_and_titles(spark, tmp_path):
    span = lambda text, size=10.0, flags=0, y=100.0: {"text": text, "size": size, "flags": flags, "y": y}
    line = lambda y, *spans: {"spans": list(spans), "x0": 0.0, "y0": y, "x1": 50.0, "y1": y + 10}
    page = {"page_number": 1, "title": "Haze layers of the polar cap", "blocks": [{"lines": [line(50, span("The rate g", flags=16), span("2", 6.0, y=96.0)), line(60)]}, {"lines": [line(100, span("1 m")), line(300, span("\ue000 "))]}], "grids": [{"x0": 0.0, "y0": 90.0, "x1": 100.0, "y1": 120.0, "rows": [["x", "y"], [None, " "], ["1", "m"]]}]}
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parser(content):
        if content == b"bad":
            raise ValueError
        yield page

    spark.conf.set("lectern.enable_table_extraction", "yes")
    spark.conf.set("lectern.enable_script_markers", "1")
    pages, names = readers.read_layouts(spark, str(tmp_path), parser)
    r = pages.first()
    assert (r.text, r.tables, [(x.size, x.bold, x.y) for x in r.lines]) == ("The rate g^2", ["x | y\n1 | m"], [(10.0, True, 50.0)])
    assert names.count() == 1
    docs, _ = index_pages(pages.withColumn("text", F.lit("Results\n" + "The jet is fast here. " * 40)).withColumn("lines", F.lit(None).cast("array<struct<text:string,size:double,bold:boolean,y:double>>")), names)
    assert docs.first().title == "Haze layers of the polar cap"
    for name in ("enable_table_extraction", "enable_script_markers"):
        spark.conf.unset(f"lectern.{name}")
    r = readers.read_layouts(spark, str(tmp_path), parser)[0].first()
    assert r.text == "The rate g2\n1 m" and r.tables == []


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "1", "paper": "P", "question": "q?", "must_contain": ["a"], "type": "t"}]}))
    (tmp_path / "s.json").write_text(json.dumps({"c": {"train": ["x", "y"], "test": ["z"]}}))
    assert readers.read_queries(spark, str(tmp_path / "q.json")).first().must_contain == ["a"]
    assert readers.read_split_spec(spark, str(tmp_path / "s.json")).count() == 3
    readers.write_split_record(spark.createDataFrame([("a", "train"), ("b", "test"), ("c", None)], "doc_id string, split string"), str(tmp_path / "h"), "s.json")
    assert spark.read.json(str(tmp_path / "h")).first().asDict() == {"train": ["a"], "held_out": ["b", "c"], "source": "s.json"}
    readers.write_report(spark.range(2), spark.range(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "per_question")).count() == 2


def test_requests(spark):
    docs = spark.createDataFrame([("a",)], "doc_id string")
    assert service.check(service.Ask("q", doc_ids=["a"]), docs)
    for bad, status in ((service.Ask("q", mode="x"), 422), (service.Ask("q", top_k=21), 422), (service.Ask("q", max_per_document=0), 422), (service.Ask(""), 422), (service.Ask("q", doc_ids=["z"]), 404)):
        with pytest.raises(service.Refused) as e:
            service.check(bad, docs)
        assert e.value.status == status
    with pytest.raises(service.Refused) as e:
        service.check(service.Ask("q"), docs.limit(0))
    assert e.value.status == 409 and service.chosen_scope(["a", "b"], ["a"], ["a", "b"]) == ["a"] and service.chosen_scope(["a"], ["a"], ["a"]) is None


def test_stream_is_idempotent(spark, tmp_path):
    seg = "doc_id string, seg_no int, text string, page_number int, section string, is_table boolean, ingested_at timestamp"
    row = lambda d: (d, 0, "The jet is fast here. " * 20, 1, "S", False, None)
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for docs in (["a"], ["b", "c"]):
        spark.createDataFrame([row(d) for d in docs], seg).withColumn("ingested_at", F.current_timestamp()).write.mode("append").parquet(src)
        ingest(spark, src, out, cp).awaitTermination()
    ingest(spark, src, out, cp).awaitTermination()
    assert {r.doc_id: r["count"] for r in current_chunks(spark, out).groupBy("doc_id").count().collect()} == {"a": 1, "b": 1, "c": 1}
    assert spark.read.parquet(out + "/postings").where("term = 'jet'").count() == 3
