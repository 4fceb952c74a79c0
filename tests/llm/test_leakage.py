import random

import numpy as np

from lectern.llm.leakage import HeldOut, SuffixArray, aligned, leaked_items, leaks, passages, without_leaks, words

DOC, HELD = "doc_id long, text string, item_id int", "item_id int, split string, paper string, text string"


def text(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}x" for _ in range(n))


def test_suffix_array_finds_all():
    rng = random.Random(1)
    ids = np.array([rng.randint(0, 5) for _ in range(2000)], np.int64)
    a = SuffixArray(ids, 8)
    tests = np.array([ids[i : i + 4] for i in range(0, 1900, 37)] + [[9, 9, 9, 9]])
    lo, hi = a.bound(tests, False), a.bound(tests, True)
    for t, x, y in zip(tests, lo, hi):
        assert sorted(a.order[x:y]) == [i for i in range(len(ids) - 3) if (ids[i : i + 4] == t).all()]


def test_alignment_counts():
    item, doc = np.arange(2, 42), np.concatenate((np.full(5, 1), np.arange(2, 20), [99], np.arange(21, 42)))
    span, wrong, good = aligned([(item, doc, np.zeros(40, bool))])[0]
    assert (span, wrong, good) == (40, 1, 39)
    assert words("Tide-\nlocked, 33.52 m/s Ｘ​y") == ["tidelocked", "3352", "ms", "xy"]


def test_passages(spark):
    rng = random.Random(2)
    items = {i: text(rng, 90) for i in range(8)}
    w = {i: t.split() for i, t in items.items()}
    noisy = w[1][10:50]
    noisy[8], noisy[20] = "changed", "other"
    del noisy[30]
    docs = [
        (1, text(rng, 50) + " " + " ".join(w[0][5:40]) + " " + text(rng, 30), 0),
        (2, text(rng, 20) + ". " + ", ".join(noisy).upper(), 0),
        (3, text(rng, 60) + " ".join(w[2][:12]) + text(rng, 60), 0),
        (4, None, 0), (5, "", 0), (6, "   ", 0),
        (7, " ".join(w[3]) + "\n" + " ".join(w[4][30:60]), 0), (7, " ".join(w[3]) + "\n" + " ".join(w[4][30:60]), 0),
        (8, text(rng, 200_000) + " " + " ".join(w[5][:30]), 0),
    ]
    d = spark.createDataFrame(docs, DOC)
    h = spark.createDataFrame([(i, "test", "p", t) for i, t in items.items()] + [(99, None, None, None), (98, None, None, "short")], HELD)
    got = {(r.doc_id, r.item_id) for r in leaks(d.select("doc_id", "text"), h).collect()}
    assert got == {(1, 0), (2, 1), (7, 3), (7, 4), (8, 5)}
    assert {r.item_id for r in leaked_items(d, h).collect()} == {0, 1, 3, 4, 5} and {r.doc_id for r in without_leaks(d, h).collect()} == {3, 4, 5, 6}
    assert leaks(d.limit(0), h).count() == 0 and leaks(d, h.limit(0)).count() == 0


def test_three_differences_in_a_short_passage(spark):
    rng = random.Random(3)
    items = {i: text(rng, 90) for i in range(4)}
    w = {i: t.split() for i, t in items.items()}
    short = {i: w[i][10:35] for i in items}
    for k in (5, 11, 17):
        short[0][k] = "changed"  # runs of 5, 5, 5 and 7
        short[1][24 - k] = "changed"
    short[2] = short[2][:12]
    for k in (3, 8, 13, 18):
        short[3][k] = "changed"
    d = spark.createDataFrame([(i, text(rng, 40) + " " + " ".join(x) + " " + text(rng, 40), 0) for i, x in short.items()], DOC)
    h = spark.createDataFrame([(i, "test", "p", t) for i, t in items.items()], HELD)
    assert {(r.doc_id, r.item_id) for r in leaks(d, h).collect()} == {(0, 0), (1, 1)}


def test_stock_phrases_are_counted_over_all_passes(spark, monkeypatch):
    rng = random.Random(4)
    stock = text(rng, 30)
    items = [(i, "test", "p", text(rng, 30) + " " + stock + " " + text(rng, 30)) for i in range(6)]
    d, h = spark.createDataFrame([(1, text(rng, 30) + " " + stock, 0), (2, items[3][3], 0)], DOC), spark.createDataFrame(items, HELD)
    for size in (8_000_000, 1000):
        monkeypatch.setattr("lectern.llm.leakage.PASS", size)
        assert {(r.doc_id, r.item_id) for r in leaks(d, h).collect()} == {(2, 3)}


def test_an_item_held_out_many_times_is_still_found(spark, monkeypatch):
    rng = random.Random(5)
    whole, other = text(rng, 60), text(rng, 60)
    w = whole.split()
    for n in (4, 5, 50):
        alike = [" ".join("new" + x if k == 3 + i % 50 else x for k, x in enumerate(w)) for i in range(n)]  # copies but for a word
        rows = [(i, "test", "p", whole.upper() if i % 2 else whole + ".") for i in range(n)] + [(1000 + i, "test", "p", t) for i, t in enumerate(alike)] + [(999, "test", "p", other)]
        d, h = spark.createDataFrame([(1, text(rng, 30) + " " + whole, 0), (2, text(rng, 80), 0)], DOC), spark.createDataFrame(rows, HELD)
        for size in (8_000_000, 700):
            monkeypatch.setattr("lectern.llm.leakage.PASS", size)
            got = {(r.doc_id, r.item_id) for r in leaks(d, h).collect()}
            assert got == {(1, r[0]) for r in rows if r[0] != 999}


def test_locations_and_long_items(spark):
    rng = random.Random(7)
    w = text(rng, 3000).split()
    part = w[1700:1760]
    part[30] = "changed"
    lead = text(rng, 100)
    d = spark.createDataFrame([(1, lead + " " + " ".join(w[:1200]), 0), (2, lead + " " + " ".join(part), 0), (3, " ".join(w[5:20]), 0)], DOC)
    h = spark.createDataFrame([(7, "test", "p", " ".join(w))], HELD)
    assert sorted(map(tuple, passages(d, h).collect())) == [(1, 7, 100, 0, 1200), (2, 7, 100, 1700, 30)]
    assert leaked_items(d, h).first().longest == 1200
