import random

from pyspark.sql import functions as F

from lectern.operators import chunking, structure

PAGES = "doc_id string, page_number int, text string, lines array<struct<text:string,size:double,bold:boolean,y:double>>, tables array<string>"


def test_headings(spark):
    rows = spark.createDataFrame([("3.2 Model configuration",), ("Introduction",), ("COS",), ("4 Qpn(dp) ddp,",), ("RELATED WORK HERE",), ("Table 3 Results",), ("just some prose here",), (None,)], "x string")
    got = [r[0] for r in rows.select(structure.heading(F.col("x"))).collect()]
    assert got == ["3.2 Model configuration", "Introduction", None, None, "Related Work Here", None, None, None]


def test_references_are_cut(spark):
    body = "word " * 100
    pages = spark.createDataFrame([("a", 1, body + "\nReferences\nearly", None, []), ("a", 2, body, None, []), ("a", 3, body, None, []), ("a", 4, "end\nReferences\n[1] x", None, []), ("a", 5, "[2] y", None, []), ("b", 1, "", None, [])], PAGES)
    got = {(r.doc_id, r.page_number): r.text for r in structure.without_references(pages).collect()}
    assert ("a", 5) not in got and got["a", 4].strip() == "end" and "References" in got["a", 1] and got["b", 1] == ""


def test_segments_carry_sections_and_tables(spark):
    pages = spark.createDataFrame([("a", 1, "Opening words of it\n1 Methods\nThe run was long\nab", None, ["x | y\n1 | 2"]), ("a", 2, "It went on-\nwards", None, [])], PAGES)
    got = [(r.page_number, r.section, r.is_table, r.text) for r in structure.segments(pages).orderBy("seg_no").collect()]
    assert got == [(1, None, False, "Opening words of it"), (1, "1 Methods", False, "1 Methods The run was long"), (1, "1 Methods", True, "Table on page 1\nx | y\n1 | 2"), (2, "1 Methods", False, "It went onwards")]
    assert structure.segments(pages.limit(0)).count() == 0


def test_small_sections_merge(spark):
    long = "w " * 45
    rows = spark.createDataFrame([("a", 0, "tiny", "s0"), ("a", 1, long, "s1"), ("a", 2, "few words", "s2"), ("a", 3, long, None), ("a", 4, "few", "s4")], "doc_id string, seg_no int, text string, section string")
    assert [r.section for r in structure.merge_small_sections(rows).orderBy("seg_no").collect()] == [None, "s1", "s1", None, None]


def test_title_by_typography(spark):
    lines = [("Research Article", 20.0, False, 50.0), ("Haze layers over the", 18.0, True, 80.0), ("polar cap of Titan", 18.0, True, 100.0), ("J. Doe", 10.0, False, 130.0), ("Far line of eighteen", 18.0, False, 300.0), ("text", 10.0, False, 780.0)]
    pages = spark.createDataFrame([("a", 1, "", lines, [])], PAGES)
    assert structure.best_title(structure.title_lines(pages)).first().title == "Haze layers over the polar cap of Titan"
    assert structure.body_size(structure.page_lines(pages)).first().body in (10.0, 18.0, 20.0)


def brute(sentences, target, overlap):
    out, cur, n = [], [], 0
    for i, s in enumerate(sentences):
        if cur and s["section"] != cur[0]["section"]:
            out.append(cur)
            cur, n = [], 0
        if s["table"]:
            if cur:
                out.append(cur)
            cur, n = [], 0
            out.append([s])
            continue
        cur.append(s)
        n += s["n"]
        if n >= target:
            out.append(cur)
            k, m = len(cur), 0
            while k > 0 and m < overlap:
                k -= 1
                m += cur[k]["n"]
            cur = cur[k:]
            n = m
    if cur and n > overlap:
        out.append(cur)
    return [" ".join(x["text"] for x in c) for c in out]


def test_chunks_equal_a_plain_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(12):
        sents = []
        for seg in range(rng.randint(1, 9)):
            section, table = rng.choice(["A", "B", None]), rng.random() < 0.2
            texts = ["Xx " + "yy " * rng.randint(1, 60) + "zz." for _ in range(1 if table else rng.randint(1, 6))]
            rows.append((f"d{d}", seg, " ".join(texts), 1 + seg, section, table))
            sents += [{"text": t.strip(), "n": len(t.split()), "section": section, "table": table} for t in texts]
        want[f"d{d}"] = brute(sents, 100, 30)
    got = {}
    df = spark.createDataFrame(rows, "doc_id string, seg_no int, text string, page_number int, section string, is_table boolean")
    for r in chunking.chunk_segments(df, 100, 30).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.word_count == len(r.text.split()) and r.page_start <= r.page_end
    assert got == {k: v for k, v in want.items() if v}


def test_small_renderers(spark):
    rows = spark.createDataFrame([([["a", " b\nc "], ["", " "], ["1", "2"]],), ([["x"]],)], "r array<array<string>>")
    assert [r[0] for r in rows.select(structure.render_table(F.col("r"))).collect()] == ["a | b c\n1 | 2", None]
