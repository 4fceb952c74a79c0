import pytest

from lectern.llm import pairs

KIND = "record_kind string, record_id long, question string, text string, at timestamp_ntz"
EN = "The upper layer of the haze is thick and the mean speed of the jet rises with the height of the layer. "
DE = "Die obere Schicht des Dunstes ist dick und die mittlere Geschwindigkeit der Strömung steigt mit der Höhe. "
Q = "How does the mean speed of the jet change with the height of the upper layer?"


@pytest.fixture(scope="module")
def model():
    return pairs.LanguageModel.fit([("en", EN), ("de", DE), ("en", "What limits the speed of the jet near the pole and why is it so?"), ("de", "Warum ist die Schicht so dick und wie groß ist die Geschwindigkeit?")])


@pytest.mark.parametrize("text, empty", [(None, True), ("", True), ("​ ", True), ("[no answer]", True), ("N/A", True), ("Answer:", True), ("…", True), ("[Excerpt 1]", True), ("No.", False), ("None of them.", False), ("235 Pa", False), ("N = 3", False)])
def test_empty(text, empty):
    assert pairs.is_empty(text) == empty


@pytest.mark.parametrize("text, copy", [(Q, True), ("> " + Q, True), ("You asked: " + Q, True), (Q.upper(), True), (Q + " " + Q, True), (Q.replace("o", "о"), True), (Q + " " + EN, False), ("Jet", False), (EN, False)])
def test_copy(text, copy):
    assert pairs.is_copy(Q, text) == copy


@pytest.mark.parametrize("text, refuses", [("I'm sorry, but I can't help with that request.", True), ("Nothing in the excerpts addresses the question, so no answer can be given. Is there anything else?", True), ("Diese Frage kann ich nicht beantworten.", True), ("No puedo responder a esta pregunta.", True), ("Je ne peux pas répondre à cette question.", True), ("The excerpts do not state it directly, but the layer is 3 km thick.", False), ("The jet cannot resolve the layer.", False), ("No.", False)])
def test_refusal(text, refuses):
    assert pairs.is_refusal(text) == refuses


def test_language(model):
    assert pairs.language_defect(model, Q, DE) and not pairs.language_defect(model, Q, EN)
    assert not pairs.language_defect(model, "Warum ist die Schicht so dick? Bitte auf Englisch antworten.", EN)
    assert not pairs.language_defect(model, Q, f'The note titled "{DE}" gives it: {EN}')


def test_defects(spark, model):
    good = [("turn", i, Q, EN.strip(), None) for i in range(60)]
    rows = good + [("turn", 100, Q, "The upper layer of the haze is thick and the mean spe", None), ("turn", 101, Q, EN.strip() + " The upper layer of (see", None), ("answer", 100, None, "The upper layer of the haze is", None), ("answer", 1, None, None, None), ("turn", 102, Q, "- grid: 3 km\n- size: 9 km", None), ("turn", None, Q, "", None), ("turn", 100, Q, "The upper layer of the haze is thick and the mean spe", None), ("turn", 103, Q, EN * 20000, None)]
    df = spark.createDataFrame(rows, KIND)
    got = {(r.record_kind, r.record_id): r.defect for r in pairs.defects(df, model).collect()}
    assert got == {("turn", 100): "truncated", ("turn", 101): "truncated", ("answer", 100): "truncated", ("answer", 1): "empty"}
    assert pairs.defects(df.limit(0), model).count() == 0


def test_a_model_of_nothing_judges_no_language(spark):
    m = pairs.fit_language_model(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert not pairs.language_defect(m, Q, DE)


def test_held_out_languages(spark, data):
    docs = spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet")
    m = pairs.fit_language_model(docs, 300)
    rows = docs.where("lang in ('en', 'de', 'fr', 'es') and length(text) > 200").select("lang", "text").collect()
    assert sum(m.language(r.text) in (r.lang, None) for r in rows) >= 0.9 * len(rows)


def test_padding_hides_nothing():
    pad = " " * 300
    assert pairs.is_empty("N/A" + pad) and pairs.is_empty("Answer:" + pad) and pairs.is_copy("Why?" + Q, Q + pad * 4)
    assert pairs.is_refusal("I'm sorry, but I can't help" + pad * 4 + " with that request.")


def test_labelled_texts_teach_whole_and_contexts_have_four_words(spark):
    lead = "1 2 3 " * 200
    docs = spark.createDataFrame([(i, lead + t, lang) for i in range(20) for t, lang in ((EN, "en"), (DE, " DE"))], "doc_id long, text string, lang string")
    m = pairs.fit_language_model(docs)
    assert m.names == ["de", "en"] and m.language(EN) == "en" and m.language(DE) == "de"
    whole = pairs.LanguageModel.fit([(lang, lead + t) for t, lang in ((EN, "en"), (DE, "de")) for _ in range(20)])
    assert (m.table == whole.table).all()
    assert pairs.end_contexts("of the thick upper haze layer")[-1] == "S|thick upper haze layer"


@pytest.mark.parametrize("text, refuses", [("As of 2023, I cannot answer this question.", True), ("I'm afraid that's beyond me.", True), ("Sorry, no can do.", True), ("I'm sorry. " * 100 + "I can't help with that.", True), ("I cannot give the exact value, but the layer is 3 km thick.", False), ("I cannot say. The speed is 12 m/s.", False), ("I am unable to answer this; I do not know.", True), ("I cannot be sure; however, the upper layer of the haze rises with the mean height of the jet in all of the runs.", False)])
def test_refusals_of_any_length_and_with_numbers(text, refuses):
    assert pairs.is_refusal(text) == refuses


def test_copies_of_any_length():
    assert pairs.is_copy(Q, (Q + " ") * 40) and pairs.is_copy(Q, "\n".join([Q.upper()] * 7)) and not pairs.is_copy(Q, (Q + " " + EN) * 20)


def test_short_answers_in_another_language(model):
    assert pairs.language_defect(model, Q, "Wegen der Strömung.") and not pairs.language_defect(model, Q, "3.5 km") and not pairs.language_defect(model, Q, "Kreshax")


def test_a_row_takes_its_forms_once(model):
    pairs.plain.cache_clear()
    assert pairs._judge(model, Q, EN.strip()) == ("", None) and pairs.plain.cache_info().misses <= 2


DECLINED = """I can't say|we cannot|I could n't|I am unable to|I won’t|I must decline|I refrain|I don’t have the context|it is not possible|there is no way of|no answer can be given|outside my|beyond me|no can do|As an AI
the text doesn't provide enough|nothing in the text answers|ich kann es nicht|ich muss ablehnen|keine Auskunft|nicht in der Lage|je ne peux pas|nous ne sommes pas|ne contient pas assez|impossible d'répondre|je dois décliner
no puedo|no es posible|no contiene información|no hay respuesta|debo rechazar|debo declinar|ı am unable|thiſ text does not contain information""".replace("\n", "|").split("|")


@pytest.mark.parametrize("change", [str, str.upper, lambda t: t.replace("i", "\u0130").replace("k", "\u212a"), lambda t: t.replace("i", "\u0131").replace("s", "\u017f")])
def test_what_is_looked_up_first_hides_no_match(change, monkeypatch):
    texts = [change(t) for t in DECLINED]
    assert all(pairs._may(t, pairs.DECLINING_WORDS) for t in texts if pairs.DECLINES.search(t)) and sum(bool(pairs.DECLINES.search(t)) for t in texts) > 20
    asked = [change(x) for v in pairs.ASKED.values() for x in v[5:-3].split("|")]
    assert len(asked) > 12 and all(pairs._may(t, pairs.ASKED_WORDS) for t in asked)
    found = [pairs.is_refusal(t + ".") for t in [*texts, EN, DE]]
    monkeypatch.setattr(pairs, "_may", lambda *_: True)
    assert found == [pairs.is_refusal(t + ".") for t in [*texts, EN, DE]]


def test_contexts_begin_with_their_sentence():
    assert pairs.end_contexts("It ends here. Then the") == ["S|the", "S|then the", "S|^ then the"] and pairs.end_contexts("- it ends. then the") == ["L|the", "L|then the", "L|ends then the", "L|it ends then the"]
