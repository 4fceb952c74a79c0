import random

from lectern.llm.overlap import bags, misspellings, one_edit, overlap_counts, overlaps, parsed, records_of, rewordings

BENCH = "id string, lexical_overlap double, split string, paper string, doc_id string, question string, must_contain array<string>, source_chunk int, created_at timestamp_ntz"
CQ = "id string, paper string, question string, must_contain array<string>, type string, doc_id string"


def b(id, split, question, paper="On the jets of Fisukufi", doc="x"):
    return (id, 0.1, split, paper, doc, question, None, 1, None)


def test_edits():
    assert one_edit("paper", "paaper") and one_edit("limit", "liimt") and one_edit("limit", "limt") and not one_edit("limit", "lmiti") and one_edit("a", "a")


def bag(spark, rows):
    made = bags(parsed(records_of(spark.createDataFrame(rows, BENCH), spark.createDataFrame([], CQ))))
    return {r.id: (r.numbers, r.words) for r in made.collect()}


def test_bags(spark):
    rows = [b(str(i), "train", "How large is the metallicity error of the grid for Fisukufi at 3 nm?") for i in range(25)]
    rows += [b("x", "test", "At 3.0 nm, how LARGE is this paper's  grid error, of the metlalicity?"), b("y", "test", "At 4 nm how large is the grid error of the metallicity of Fisukuf?"), b("z", "test", "Above the cloud base?"), b("u", "val", "Below the cloud base?")]
    got = bag(spark, rows)
    assert got["x"] == got["1"] == (["3.0"], ["error", "grid", "large", "metallicity", "nm"]) and got["y"] == (["4.0"], got["1"][1])
    assert got["z"] != got["u"]
    counts = spark.createDataFrame([("metallicity", 50), ("metlalicity", 1), ("limit", 50), ("limits", 40), ("at", 9)], "w string, n long")
    assert {(r.w, r.v) for r in misspellings(counts).collect()} == {("metlalicity", "metallicity")} and misspellings(counts.limit(0)).count() == 0


def test_rewordings_are_learned_and_conditions_are_none(spark):
    rng = random.Random(3)
    whats, where = [f"quantity{c}" for c in "abcdefghijkl"], ["below the cloud base", "above the tropopause", "near the equator", "over the polar cap"]
    rows = []
    for p in range(60):
        what, place = rng.choice(whats), rng.choice(where)
        q = f"How large is the {what} error of the model {place} when {p} layers are used?"
        rows.append(b(f"t{p:02d}", "train", q, f"Title {chr(97 + p // 26)}{chr(97 + p % 26)}", None))
        if p < 15:
            other = q.replace("large", "big").replace("used", "employed")
        elif p < 30:
            other = q.replace(place, rng.choice([x for x in where if x != place]))
        else:
            continue
        rows.append(b(f"v{p:02d}", "val", other, rows[-1][3], None))
    bench, cq = spark.createDataFrame(rows, BENCH), spark.createDataFrame([], CQ)
    learned = {(tuple(r.old), tuple(r.new)) for r in rewordings(bags(parsed(records_of(bench, cq)))).collect()}
    assert learned == {(("big", "employed"), ("large", "used"))}
    assert {(r.id_train, r.id_eval) for r in overlaps(bench, cq).collect()} == {(f"t{p:02d}", f"v{p:02d}") for p in range(15)}


def test_pairs(spark):
    q = "Why do the authors of Fisukufi keep the scale height below 603 km along the equator?"
    bench = [b("b1", "Train", q), b("b2", " val", "Why is the scale height kept below 603 km along the equator by the authors of Fisukufi?", paper="ON THE JETS  OF FISUKUFI.", doc=None), b("b3", "test", q.replace("603", "604")), b("b4", None, q), b("b5", "training", "Which data set is used?", "Other", None), b("b5", "training", "Which data set is used?", "Other", None), b("b6", "dev", None), b("b7", "train", q, None, None)]
    cq = [("q1", "On the jets of Fisukufi", q, None, None, "x"), ("q2", "Elsewhere", q, None, None, "y"), (None, "P", q, None, None, "x")]
    bench, cq = spark.createDataFrame(bench, BENCH), spark.createDataFrame(cq, CQ)
    got = {(r.id_train, r.id_eval) for r in overlaps(bench, cq).collect()}
    assert got == {("b1", "b2"), ("b1", "q1")}
    assert {(r.part, r.n_eval, r.n_pairs) for r in overlap_counts(bench, cq).collect()} == {("val", 1, 1), ("queries", 1, 1)}
    assert overlaps(bench.limit(0), cq.limit(0)).count() == 0


def test_a_title_in_many_spellings_is_one_paper(spark):
    t = "On the jets of Fisukufi"
    forms = [t, t.upper(), t.lower(), t + ".", " " + t, t + " ", t.replace(" ", "  "), t.upper() + "."]
    bench = [b(f"f{i}", "train", f"Which data set number {i} is used?", f) for i, f in enumerate(forms)] + [b("b1", "train", "How large is the grid error of Fisukufi?", forms[1], None), b("b2", "val", "How large is the grid error of this paper?", t, None)]
    bench = spark.createDataFrame(bench, BENCH)
    assert {(r.id_train, r.id_eval) for r in overlaps(bench, spark.createDataFrame([], CQ)).collect()} == {("b1", "b2")}


def test_a_word_is_a_name_at_any_size(spark):
    for times in (1, 40):
        rows = [b(f"{p}-{i}", "train", f"How large is the grid error of {n} for jets?", f"On the jets of {n}", None) for p, n in enumerate(["Fisukufi", "Lorosige", "Kovopela"]) for i in range(times)]
        rows += [b(f"o{i}", "train", "How fast are the jets?", "Elsewhere", None) for i in range(3 * times)]
        got = bag(spark, rows)
        assert got["0-0"] == got["2-0"] == ([], ["error", "grid", "jets", "large"])


def test_counts_agree_with_pairs(spark):
    q = "Which scale height is kept below 603 km?"
    rows = [("a1", "train", "One", "x"), ("a2", "train", "One", None), ("a3", "train", None, "x"), ("a4", "train", "Two", "x"), ("e1", "val", "One", "x"), ("e2", "val", None, "X "), ("e3", "test", "Two", "y"), ("e4", "test", "Two", None), ("e5", "val", "Three", "x"), ("e6", "val", "One", "z"), ("e7", "val", "None", "w")]
    bench, cq = spark.createDataFrame([b(i, s, q, p, d) for i, s, p, d in rows], BENCH), spark.createDataFrame([("q1", "One", q, None, None, "x")], CQ)
    pairs = overlaps(bench, cq).collect()
    want = {(p, t): (len({r.id_eval for r in pairs if (r.part, r.title) == (p, t)}), sum((r.part, r.title) == (p, t) for r in pairs)) for p, t in {(r.part, r.title) for r in pairs}}
    assert {(r.part, r.title): (r.n_eval, r.n_pairs) for r in overlap_counts(bench, cq).collect()} == want
    assert want["val", "one"] == (2, 6) and want["val", ""] == (1, 3) and want["queries", "one"] == (1, 4)
