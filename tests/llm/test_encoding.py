import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.encoding import PairIndexEncoder, encode_corpus, tokenizer_file

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer_file()), reason="no public vocabularies here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizer_file())
    theirs.encode_special_tokens = True
    return PairIndexEncoder(tokenizer_file()), theirs


@settings(max_examples=200, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.lists(st.text(max_size=60), max_size=5))
def test_equals_the_public_encoder(both, texts):
    ours, theirs = both
    assert ours.encode(texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(both):
    ours, theirs = both
    rng = random.Random(3)
    texts = ["a" * 5000, "aaa " * 3000, "<|endoftext|>", "\r\n\t  x", "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(3000)), "日本語" * 500, " don't we'll "]
    assert ours.encode(texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert ours.encode([None, ""]) == [[], []]


def test_corpus(spark):
    df = spark.createDataFrame([(1, "The jet"), (2, None), (3, ""), (4, "The jet"), (4, "The jet")], "doc_id long, text string")
    got = encode_corpus(df).collect()
    assert {r.doc_id: r.ids for r in got}[1] == {r.doc_id: r.ids for r in got}[4] != [] and {r.doc_id: r.ids for r in got}[2] == [] and len(got) == 5
    assert encode_corpus(df.limit(0)).count() == 0
