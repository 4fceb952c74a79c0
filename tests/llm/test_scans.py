import pytest

from pyspark.sql import functions as F

from lectern.llm.scans import Repairer, fold, numeral, page_noise, page_value, paragraphs

KIND = "doc_id string, page_number int, text string, scanned_at timestamp_ntz"
WORDS = {"spectrum": 500, "upper": 900, "which": 400, "local": 300, "retrieval": 200, "near": 90, "infrared": 80, "near-infrared": 60, "the": 5000, "close": 300, "m/s": 100}


@pytest.mark.parametrize("line, value", [("Page 3 of 9", 3), ("- 12 -", 12), ("– 67l –", 671), ("[l]", 1), ("xiv", 14), ("~ lO ~", 10), ("4 Results", None), ("In Table 3", None), ("", None)])
def test_page_numbers(line, value):
    assert page_value(line) == value


def test_words():
    r = Repairer(WORDS)
    assert r.token("spectrurn") == "spectrum" and r.token("uppcr,") == "upper" and r.token("vvhich") == "which" and r.token("lo¢al") == "local" and r.token("dose") == "close"
    assert r.token("spectrum") is None and r.token("1e9") is None and r.token("cm2/s") is None and r.token("Jiosin-3") is None and r.token("20l4") == "2014"
    assert r.broken("retri-", "eval") and not r.broken("near-", "infrared") and r.broken("retri¬", "eval.") and not r.broken("Jiosin-", "3")
    assert fold("L0NG-LIVFD") == fold("long-livtd") and numeral("mmxx") == 2020


def test_frequent_misreadings_count_at_any_size():
    for times in (1, 10, 100):
        r = Repairer({"with": 6446 * times, "witb": 23 * times, "upper": 900 * times, "uppcr": 22 * times})
        assert r.token("witb") == "with" and r.token("Uppcr,") == "upper" and r.token("with") is None and r.token("upper") is None


@pytest.fixture
def pages(spark):
    body = "the retrieval of the spectrum near the upper layer is local and close"
    rows = []
    for d in range(6):
        for p in range(1, 5):
            lines = [f"Running head of paper {d}" if p != 2 else f"Running hcad of paper {d}", body, f"of the upper lay-" if p == 1 else body, body + ".", f"Page {p}"]
            if p == 2:
                lines[1] = "ers " + body
            rows.append((f"d{d}", p, "\n".join(lines), None))
    rows += [rows[0], ("e", 1, "", None), ("f", 1, None, None), (None, 1, "x", None), ("layers", 1, "layers " * 60, None), ("g", 1, "w " * 300_000, None)]
    return spark.createDataFrame(rows, KIND)


def test_noise(pages):
    got = {(r.page_number, r.line_no, r.noise) for r in page_noise(pages).where("doc_id = 'd1'").collect()}
    assert {(p, 5, "page_no") for p in range(1, 5)} <= got and {(p, 1, "running") for p in range(1, 5)} <= got and (1, 3, "hyphen") in got


def test_paragraphs(spark, pages):
    rows = paragraphs(pages).where("doc_id = 'd0'").collect()
    text = " ".join(r.text for r in rows)
    assert "lay-" not in text and "upper layers the retrieval" in text
    assert "Running" not in text and "Page" not in text and "layers" in text
    assert paragraphs(spark.createDataFrame([], KIND)).count() == 0 and page_noise(spark.createDataFrame([], KIND)).count() == 0


def found(pages):
    return {tuple(r) for r in page_noise(pages).collect()}


def test_copies_change_nothing(spark, data):
    pages = spark.read.parquet(data.replace("0.001", "0.01") + "/raw_pages.parquet")
    ten = pages.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("doc_id", F.concat("doc_id", F.lit("/"), "k")).drop("k")
    once = found(pages)
    assert {(d.split("/")[0], *rest) for d, *rest in found(ten) if d.endswith("/7")} == once and len(once) > 50


def test_rare_words_are_looked_up_where_few_are_sent(spark, data, monkeypatch):
    pages = spark.read.parquet(data.replace("0.001", "0.01") + "/raw_pages.parquet")
    want = found(pages)
    for most in (20_000, 1_000):  # words that stand 6, and 120 times and less, are not sent
        monkeypatch.setattr("lectern.llm.scans.WORDS", most)
        assert found(pages) == want


def test_one_page_repeats_nothing(spark):
    page = [("d", 1, "Smith et al.\nTHE FIRST LINE OF A PAGE IN CAPITALS\nthe upper layer is local and close\nof the layer", None)]
    assert found(spark.createDataFrame(page, KIND)) == set()
