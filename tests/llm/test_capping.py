import random

from lectern.llm.capping import Level, cap_nested, capped_hits

HIT = "answer_id long, rank int, doc_id string, chunk_id int, score double, logged_at timestamp_ntz"
ANS = "answer_id long, max_per_document int, answered_at timestamp_ntz"


def greedy(rows, levels):
    """The matroid's greedy choice: best first, kept if every group it is in has room."""
    room, kept = {}, set()
    for r in sorted(rows, key=lambda r: (-r["s"], r["id"])):
        groups = [(n, tuple(r[k] for k in keys), cap) for n, (keys, cap) in enumerate(levels)]
        if all(room.get(g[:2], 0) < g[2] for g in groups):
            kept.add(r["id"])
            for g in groups:
                room[g[:2]] = room.get(g[:2], 0) + 1
    return kept


def test_nested_caps_equal_the_greedy_choice(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        domain = 0 if rng.random() < 0.4 else rng.randint(1, 5)
        rows.append({"id": i, "org": domain % 2, "dom": domain, "author": rng.randint(0, 3), "s": float(rng.randint(0, 20))})
    df = spark.createDataFrame(rows, "id long, org long, dom long, author long, s double").repartition(5)
    levels = [(("org", "dom", "author"), 30), (("org", "dom"), 50), (("org",), 70)]
    got = cap_nested(df, [Level(k, cap=c) for k, c in levels], "s", ["id"], salts=4)
    # among equal scores the smaller id goes first, in the passes as in the greedy choice
    assert {r.id for r in got.where("stays").collect()} == greedy(rows, levels)
    assert got.where("stays = (cut_at is not null)").count() == 0


def test_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b", float(i)) for i in range(100)], "id int, src string, s double")
    got = cap_nested(df, [Level(("src",), share=0.2)], "s", ["id"]).where("stays").groupBy("src").count().collect()
    assert {r.src: r["count"] for r in got} == {"a": 20, "b": 10}


def test_odd_rows(spark):
    nan = float("nan")
    hits = spark.createDataFrame(
        [(1, 1, " A ", 1, None, None), (1, 2, "a", 2, nan, None), (1, 3, "a", 3, 0.5, None), (1, 4, "b", 1, 0.1, None), (None, 1, "a", 1, 1.0, None), (2, 1, "a", 1, 1.0, None), (2, 2, "a", 2, 1.0, None), (3, 1, None, 1, 1.0, None)], HIT)
    answers = spark.createDataFrame([(1, 2, None), (1, 2, None), (2, None, None), (3, 1, None)], ANS)
    got = {(r.answer_id, r.doc_id, r.chunk_id): r.stays for r in capped_hits(hits, answers).collect()}
    assert got == {(1, "a", 3): True, (1, "a", 1): True, (1, "a", 2): False, (1, "b", 1): True}
    assert capped_hits(hits.limit(0), answers).count() == 0


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5, 6, 7)], "id int, k string, s double, stays int, cut_at int, _n int")
    assert cap_nested(df, [Level(("k",), cap=1)], "s", ["id"]).first().stays is True
    assert cap_nested(df.limit(0), [Level(("k",), share=0.5)], "s", ["id"]).count() == 0


def test_latest_log_counts(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    hits = spark.createDataFrame([(1, 1, "a", 1, 9.0, t(1)), (1, 1, "a", 1, 0.1, t(2)), (1, 2, "a", 2, 0.5, t(1)), (1, 2, "a", 2, 0.5, t(1))], HIT)
    got = {r.chunk_id: r.stays for r in capped_hits(hits, spark.createDataFrame([(1, 1, None)], ANS)).collect()}
    assert got == {1: False, 2: True}


def test_a_large_cap_and_a_share_equal_the_greedy_choice(spark):
    rng = random.Random(6)
    rows = [{"id": i, "org": 0, "dom": 0 if rng.random() < 0.5 else rng.randint(1, 40), "s": rng.choice([None, float("nan"), float(rng.randint(0, 50))])} for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, org long, dom long, s double").repartition(6)
    score = {r["id"]: -1.0 if r["s"] is None or r["s"] != r["s"] else r["s"] for r in rows}
    plain = [{**r, "s": score[r["id"]]} for r in rows]
    got = cap_nested(df, [Level(("org", "dom"), cap=1500), Level(("org",), share=0.4)], "s", ["id"])
    assert {r.id for r in got.where("stays").collect()} == greedy(plain, [(("org", "dom"), 1500), (("org",), 2400)])
    assert {r.cut_at for r in got.select("cut_at").distinct().collect()} == {None, 1, 2}
