import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.typography import render_spans


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("The rate of the reaction", ["rate", "reaction"]), ("Kzz of 1e7 cm2 at 70km", ["kzz", "1e7", "cm2", "70km"]), ("3.14", ["3.14"]), ("g^2 v_t", ["g2", "vt"]), ("", []), (None, [])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens, text) == want


@pytest.mark.parametrize("text, want", [("Smith et al. Model runs. Then it stops.", ["Smith et al. Model runs.", "Then it stops."]), ("See Fig. 3 for it.", ["See Fig. 3 for it."]), ("  ", []), ("One. été two.", ["One. été two."])])
def test_sentences(spark, text, want):
    assert one(spark, T.sentences, text) == want


def test_cleaning(spark):
    assert one(spark, T.clean_text, " atmo-\nspheric  run\nof air ") == "atmospheric run of air"
    assert one(spark, T.strip_icon_glyphs, " a \t b") == "a b"
    assert one(spark, T.restore_truncated_math, "푖") == "i"
    assert one(spark, T.restore_truncated_math, "푖 가") == "푖 가"


def test_titles(spark):
    assert one(spark, T.is_banner, "Research  Article") and not one(spark, T.is_banner, "Haze on Titan")
    assert one(spark, T.is_plausible_title, "Haze layers of Titan") and not one(spark, T.is_plausible_title, "haze layers of Titan")
    assert not one(spark, T.is_legible, "~~tL-~;=::::~4~=")
    assert one(spark, T.metadata_title, "<b>Haze layers</b> of Titan") == "Haze layers of Titan"
    assert one(spark, T.metadata_title, "microsoft word") is None and one(spark, T.metadata_title, None) is None
    assert one(spark, T.filename_title, "haze_layers__of titan.v2.pdf") == "haze layers of titan.v2"
    assert len(one(spark, T.short_title, "x" * 71)) == 70


def test_citation_parts(spark):
    rows = spark.createDataFrame([("T", 4, 5, "2 M"), (None, 3, 3, None), (None, 0, 0, ""), ("T", None, None, "S")], "t string, a int, b int, s string")
    got = [r[0] for r in rows.select(T.citation(F.col("t"), F.col("a"), F.col("b"), F.col("s"))).collect()]
    assert got == ["T, p. 4-5, Section 2 M", "p. 3", "source unknown", "T, Section S"]


def test_questions(spark):
    assert one(spark, T.looks_comparative, "Compare both papers") and not one(spark, T.looks_comparative, "compared with what?") and not one(spark, T.looks_comparative, None)
    assert one(spark, T.looks_self_contained, "What limits the jet speed near poles?") and not one(spark, T.looks_self_contained, "Why is the jet fast near poles?")
    rows = spark.createDataFrame([("q?", "Question: \"What limits the jet?\"\nmore"), ("q?", "no mark"), ("q?", None)], "q string, r string")
    assert [r[0] for r in rows.select(T.accept_rewrite("q", "r")).collect()] == ["What limits the jet?", "q?", "q?"]


def test_replies(spark):
    assert one(spark, T.verdict, "It is unsupported.") == "UNSUPPORTED" and one(spark, T.verdict, "contradicted, not supported") == "CONTRADICTED" and one(spark, T.verdict, None) == "UNSUPPORTED"
    assert one(spark, T.claims, "- The jet is fast in winter. [Excerpt 1]\n2) short\nThe haze is thick at the pole.") == ["The jet is fast in winter.", "The haze is thick at the pole."]
    assert one(spark, T.claims, "none found") == [] and one(spark, T.cited_excerpts, "a [Excerpt 1] b [excerpt  12]") == [1, 12]


def test_spans(spark):
    kind = "array<struct<text:string,size:double,y:double>>"
    spans = [("g", 10.0, 100.0), ("2", 6.8, 96.5), (" and v", 10.0, 100.0), ("max", 6.5, 103.0)]
    assert one(spark, lambda x: render_spans(x, True), spans, kind) == "g^2 and v_{max}"
    assert one(spark, render_spans, spans, kind) == "g2 and vmax" and one(spark, lambda x: render_spans(x, True), [], kind) == ""
