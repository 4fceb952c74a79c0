import pytest

from lectern.llm.lookalikes import LatticeDecoder, canonical_texts, bigram_model, phrase_hits, plain

CHUNKS = [("d", 0, "The upper haze layer of Titan and the mean jet speed"), ("d", 1, "Thе uрpеr hаzе lаyеr"), ("d", 2, "The up​per ｈａｚｅ layer"), ("d", 3, "𝑇ℎ𝑒 upper haze‑layer ﬁeld"), ("d", 4, None), ("d", 5, ""), ("d", 1, "Thе uрpеr hаzе lаyеr")]
KIND = "doc_id string, chunk_id int, text string"


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, KIND)


def test_plain():
    assert plain("ａ​b­ ﬁ é") == "ab fi é" and plain("a – b ’") == "a - b '"


def test_words_are_read_in_one_script(chunks):
    m = LatticeDecoder(bigram_model(chunks))
    assert m.text("uрpеr hаzе") == "upper haze"
    assert m.text("вода") == "вода"  # another script's own word stays
    assert m.text("the symbol λ") == "the symbol λ"


def test_canonical_keeps_null_and_rows(spark, chunks):
    got = canonical_texts(chunks).collect()
    assert len(got) == len(CHUNKS) and {r.text for r in got if r.chunk_id in (4, 5)} == {None, ""}
    assert all("upper haze" in r.text for r in got if r.chunk_id in (0, 1, 2, 3))
    assert canonical_texts(chunks.limit(0)).count() == 0


def test_phrases(spark, chunks):
    q = spark.createDataFrame([("q", "d", ["upper haze", None, "​"]), ("q", "d", ["upper haze", None, "​"]), ("n", None, ["upper"]), ("m", "d", None)], "id string, doc_id string, must_contain array<string>")
    got = {(r.phrase_no, r.chunk_id): r.stored for r in phrase_hits(q, chunks).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): False, (1, 3): True}


def test_very_long_text(spark, chunks):
    long = "Thе hаzе " * 200_000
    df = spark.createDataFrame([("d", 9, long)], KIND)
    assert len(canonical_texts(df).first().text) == len(long.strip())


def test_words_of_another_script_stay(spark, data):
    chunks = spark.read.parquet(data.replace("0.001", "0.01") + "/chunks.parquet").where("text is not null")
    m = LatticeDecoder(bigram_model(chunks))
    for w in ("оса", "рос", "роса", "орех", "οι", "вода"):
        assert m.word(w) == w and m.text(w) == w
    assert m.text("оса и роса в саду near the pole") == "оса и роса в саду near the pole"
    assert m.text("а haze layer") == "a haze layer" and m.text("А trаnsiеnt hаze") == "A transient haze"  # nothing else here is of that script
    for seen, read in (("ѕcоре", "scope"), ("Ꭺtmosphere", "Atmosphere"), ("ꓐroad", "Broad"), ("ⲟzone", "ozone")):
        assert m.text(seen) == read


def test_phrases_in_several_passes(spark, chunks, monkeypatch):
    q = spark.createDataFrame([("q", "d", ["upper haze", "haze layer"]), ("r", "d", ["HAZE", "no such"]), ("s", "x", ["haze"])], "id string, doc_id string, must_contain array<string>")
    want = {tuple(r) for r in phrase_hits(q, chunks).collect()}
    monkeypatch.setattr("lectern.llm.lookalikes.PASS", 8)
    assert {tuple(r) for r in phrase_hits(q, chunks).collect()} == want and len(want) == 11
    assert phrase_hits(q.limit(0), chunks).count() == 0 and phrase_hits(q, chunks.limit(0)).count() == 0
