import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.splitting import PARAGRAPH, SENTENCE, RangeMax, boundary_strengths, cut_points, long_items, split_items


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!é́", min_size=0, max_size=4000))
def test_pieces_cover_and_overlap(text):
    p = cut_points(text, 300, (20, 40), 120)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(b - a <= 300 for a, b in p)
    assert all(20 <= b - a2 <= 40 and b2 > b for (_, b), (a2, b2) in zip(p, p[1:]))


def test_range_max_equals_a_scan():
    rng = random.Random(1)
    s = np.array([rng.randint(0, 7) for _ in range(500)], np.int8)
    index = RangeMax(s, 128)
    for _ in range(300):
        lo = rng.randint(0, 400)
        hi = min(499, lo + rng.randint(0, 120))
        best = max(s[lo : hi + 1])
        assert index.best(lo, hi) == (best, max(i for i in range(lo, hi + 1) if s[i] == best))


def test_cuts_at_the_strongest_boundary():
    text = "Aa bb. " * 150 + "\n\n" + "Cc dd. " * 200
    (a, b), *_ = cut_points(text)
    assert boundary_strengths(text)[b] == PARAGRAPH and b == len(("Aa bb. " * 150).rstrip())
    plain = "One two three four. " * 200
    assert all(boundary_strengths(plain)[b] == SENTENCE for _, b in cut_points(plain)[:-1])


@pytest.mark.parametrize("text", ["x" * 5000, "é́" * 3000, "ab" * 100_000 + " " + "c d " * 200_000, " " * 4000, "a\n" * 3000])
def test_texts_without_good_places(text):
    p = cut_points(text)
    assert p[-1][1] == len(text) and all(b - a <= 1600 for a, b in p)
    assert not any(text[b : b + 1] == "́" for _, b in p)


def test_split_items(spark):
    df = spark.createDataFrame([(1, "x " * 2000, 9), (2, None, 9), (3, "", 9), (3, "", 9)], "id int, text string, piece_no int")
    got = split_items(df).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got}[3] == 2 and 2 not in {r.id for r in got} and {r.id: r["count"] for r in got}[1] >= 3
    assert split_items(df.limit(0)).count() == 0


def test_long_items_take_the_latest(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    seg = spark.createDataFrame([("a", 0, "x" * 2000, "S", t(1)), ("a", 0, "short", "S", t(2)), ("b", 0, "y" * 1601, None, t(1)), ("c", 0, None, None, None), (None, 0, "z" * 2000, None, None)], "doc_id string, seg_no int, text string, section string, ingested_at timestamp_ntz")
    ch = spark.createDataFrame([("a", 5, "é" * 1601, "S"), ("a", 5, "é" * 1601, "S"), ("a", 6, "é" * 1600, "S")], "doc_id string, chunk_id int, text string, section string")
    assert sorted((r.item_kind, r.doc_id, r.item_no) for r in long_items(seg, ch).collect()) == [("chunk", "a", 5), ("segment", "b", 0)]
