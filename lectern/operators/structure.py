"""The structure of a paper from its pages: body size, references, headings, segments, sections, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.typography import render_spans
from lectern.operators.ranking import carried
from lectern.runtime import settle

# Names of sections, and what marks lines that are no headings.
SECTIONS = ["abstract", "introduction", "background", "related work", "methods", "methodology", "materials and methods", "model", "model description", "data", "data and methods", "experiments", "experimental setup", "results", "results and discussion", "discussion", "analysis", "conclusion", "conclusions", "conclusions and future work", "summary", "summary and conclusions", "acknowledgements", "acknowledgments", "appendix", "supplementary material"]
NO_HEADING = r"(?i)(@|\bhttps?://|\bdoi\b|university|universit[ée]|department|dept\.|institute|instituto|college|faculty|school of|academy|laborator|laboratoire|center for|centre for|corresponding author|e-?mail|\bissn\b|©|copyright|all rights reserved|received:|accepted:|published:|submitted:)"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+([A-Z][^.!?]{2,70})$"
UNNUMBERED = r"^[A-Z][A-Za-z]+(?:\s+[A-Za-z&-]+){0,6}$"
REFERENCES = r"(?im)^\s*(\d+\.?\s*)?(references|bibliography|works cited)\s*$"
CAPTION = r"^(?i:fig|table|eq|plate)"
#: Pages, segments and sentences of a paper that are put in order by one task.
PAGES, SEGMENTS = 256, 4096
TITLE_NOISE = r"(?i)(doi|https?://|www\.|arxiv|preprint|\bvol\.|©|copyright|\bissn\b|all rights reserved|general rights|downloaded from)"


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, text, size, bold): a row a line; pages without typography give lines of their text without size."""
    plain = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("text"), F.lit(None).cast("double").alias("size"), F.lit(False).alias("bold")))
    typed = F.transform("lines", lambda s: F.struct(s.text.alias("text"), s["size"].alias("size"), F.coalesce(s.bold, F.lit(False)).alias("bold")))
    return pages.select("doc_id", "page_number", F.posexplode(F.coalesce(typed, plain)).alias("line_no", "l")).select("doc_id", "page_number", "line_no", "l.text", "l.size", "l.bold")


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the font size with most characters; of equals the one met first. Papers without sizes have no row."""
    by = lines.where("size is not null and text is not null").groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page_number", "line_no")).alias("first"))
    return by.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first.page_number"), -F.col("first.line_no"))).alias("body"))


def heading_shape(line: Column) -> Column:
    """Whether a stripped line has the shape of a heading: short, capital or digit first, a letter or digit last, no furniture."""
    digits = F.length(F.regexp_replace(line, r"[^\p{Nd}]", ""))
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    return (
        F.length(line).between(2, 80)
        & F.size(T.words(line)).between(1, 12)
        & line.rlike(r"^[\p{Lu}\p{Lt}\p{Nd}]")
        & line.rlike(r"[\p{L}\p{N}]$")
        & (commas <= 1)
        & (digits <= F.length(line) * 0.3)
        & ~line.rlike(NO_HEADING)
        & ~F.regexp_replace(F.lower(line), "[.:]+$", "").isin(*T.BANNERS)
        & ~line.rlike(CAPTION)
    )


def heading(text: Column, size: Column | None = None, bold: Column | None = None, body: Column | None = None) -> Column:
    """The heading that a line is, else NULL: by type size or weight, by number, by known name, or in capitals."""
    line = T.strip(text)
    number, title = F.regexp_extract(line, NUMBERED, 1), T.strip(F.regexp_extract(line, NUMBERED, 2))
    numbered = F.when(~title.rlike(CAPTION) & title.rlike(r"[\p{L}\p{N}]$"), F.concat(number, F.lit(" "), title))
    named = F.when(F.lower(line).isin(*SECTIONS), line).when((F.upper(line) == line) & F.size(T.words(line)).between(2, 6), T.title_case(line))
    textual = F.when(line.rlike(NUMBERED), numbered).when(line.rlike(UNNUMBERED), named)
    if size is not None:
        big = (body > 0) & (size > 0) & heading_shape(line) & ((size >= body * 1.08) | (bold & (size >= body * 0.98)))
        textual = F.when(big, line).otherwise(textual)
    return F.when((line != "") & (F.length(line) <= 80), textual)


def without_references(pages: DataFrame) -> DataFrame:
    """Pages without their reference list: the first heading of one at or beyond 70 % of the paper's characters cuts its page there and drops
    the later pages. The cut page loses its typography and tables. A paper without such a heading stays whole."""
    pages = settle(pages)  # read for the lengths and for the pages
    sizes = carried(pages.select("doc_id", "page_number", F.length("text").alias("_n")), ["doc_id"], F.floor(F.col("page_number") / PAGES), ["page_number"], sums={"_upto": F.col("_n")})
    sizes = sizes.select("doc_id", "page_number", (F.col("_upto") - F.coalesce("_n", F.lit(0))).alias("_before"))
    sized = pages.join(sizes, ["doc_id", "page_number"]).join(pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("_all")), "doc_id")
    pieces, hits = F.split("text", REFERENCES, -1), F.regexp_extract_all("text", F.lit(REFERENCES), F.lit(0))
    # the offset of hit k is the length of pieces 0..k and hits 0..k-1
    offsets = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(F.slice(hits, F.lit(1), k - 1), F.lit(0), lambda a, s: a + F.length(s)))
    offsets = F.when(F.size(hits) > 0, offsets)
    late = F.array_min(F.filter(offsets, lambda o: o + F.col("_before") >= 0.7 * F.col("_all")))
    marked = sized.withColumn("_at", late)
    cut = marked.where("_at is not null").groupBy("doc_id").agg(F.min("page_number").alias("_cut"))
    kept = marked.join(cut, "doc_id", "left").where("_cut is null or page_number <= _cut")
    here = F.coalesce(F.col("page_number") == F.col("_cut"), F.lit(False))
    out = {"text": F.when(here, F.substring(F.col("text"), F.lit(1), F.col("_at"))).otherwise(F.col("text"))}
    for c in ("lines", "tables"):
        if c in pages.columns:
            out[c] = F.when(~here, F.col(c))
    return kept.withColumns(out).drop("_before", "_all", "_at", "_cut")


def segments(pages: DataFrame) -> DataFrame:
    """(doc_id, seg_no, page_number, section, is_table, text): prose between headings, a segment a page and section; then the page's tables.

    Lines of fewer than three characters are dropped; a heading begins the segment it names; the section is carried over pages."""
    pages = settle(pages)  # read for the type sizes, the lines and the tables
    lines = page_lines(pages)
    lines = lines.join(body_size(lines), "doc_id", "left").where(F.length(T.strip("text")) >= 3)
    lines = lines.withColumn("heading", heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")))
    lines = carried(lines, ["doc_id"], F.floor(F.col("page_number") / PAGES), ["page_number", "line_no"], sums={"part": F.col("heading").isNotNull().cast("int")}, lasts={"section": F.col("heading")})
    prose = lines.groupBy("doc_id", "page_number", "part").agg(F.max("section").alias("section"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    prose = prose.select("doc_id", "page_number", "part", F.lit(0).alias("k"), "section", F.lit(False).alias("is_table"), T.clean_text(F.array_join(F.transform("l", lambda s: s.text), "\n")).alias("text")).where("text <> ''")
    last = lines.groupBy("doc_id", "page_number").agg(F.max_by(F.struct("section"), F.struct("part", "line_no")).getField("section").alias("section"), F.max("part").alias("part"))
    label = F.concat(F.lit("Table on page "), F.col("page_number").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit(" ("), (F.col("k") + 1).cast("string"), F.lit(")"))).otherwise(""), F.lit("\n"), F.col("table"))
    tables = pages.select("doc_id", "page_number", F.size("tables").alias("n"), F.posexplode("tables").alias("k", "table")).join(last, ["doc_id", "page_number"], "left")
    tables = tables.select("doc_id", "page_number", F.coalesce("part", F.lit(1 << 30)).alias("part"), (F.col("k") + 1).alias("k"), "section", F.lit(True).alias("is_table"), label.alias("text"))
    every = prose.unionByName(tables).withColumn("tabled", F.col("is_table").cast("int"))
    every = carried(every, ["doc_id"], F.floor(F.col("page_number") / PAGES), ["page_number", "tabled", "part", "k"], sums={"number": F.lit(1)})
    return every.select("doc_id", (F.col("number") - 1).cast("int").alias("seg_no"), "page_number", "section", "is_table", "text")


def merge_small_sections(segs: DataFrame, least: int = 40) -> DataFrame:
    """Runs of one section (NULL is a section too) with fewer than ``least`` words take the section of the run that stayed before; the first such runs NULL.

    (doc_id, seg_no) is the key of a row."""
    block, order = F.floor(F.col("seg_no") / SEGMENTS), ["seg_no"]
    # what is ordered along a paper is its segments' sections, without any text, and then a row a run
    rows = segs.select("doc_id", "seg_no", "section", F.size(T.words("text")).alias("_words"))
    rows = carried(rows, ["doc_id"], block, order, before={"_before": F.struct("section")})
    fresh = F.col("_before").isNull() | ~F.col("section").eqNullSafe(F.col("_before.section"))
    rows = carried(rows.select("doc_id", "seg_no", "section", "_words", fresh.cast("int").alias("_fresh")), ["doc_id"], block, order, sums={"_run": F.col("_fresh")})
    runs = rows.groupBy("doc_id", "_run").agg(F.sum("_words").alias("_words"), F.first("section").alias("_section"))
    runs = carried(runs, ["doc_id"], F.floor(F.col("_run") / SEGMENTS), ["_run"], lasts={"_kept": F.when(F.col("_words") >= least, F.struct("_section"))})
    found = rows.select("doc_id", "seg_no", "_run").join(runs.select("doc_id", "_run", "_kept"), ["doc_id", "_run"]).select("doc_id", "seg_no", F.col("_kept._section").alias("_section"))
    return segs.join(found, ["doc_id", "seg_no"]).withColumn("section", F.col("_section")).select(*segs.columns)


def title_lines(pages: DataFrame) -> DataFrame:
    """The lines of the first three pages that may be title: upper 55 % of the page's type, at most 250 characters, legible, no banner, few digits."""
    lines = pages.where("page_number <= 3 and lines is not null").select("doc_id", "page_number", F.posexplode("lines").alias("line_no", "l")).select("doc_id", "page_number", "line_no", T.strip("l.text").alias("text"), "l.size", "l.y")
    height = F.max("y").over(Window.partitionBy("doc_id", "page_number"))  # pages come without their height
    digits = F.length(F.regexp_replace("text", r"[^\p{Nd}]", ""))
    lines = lines.withColumn("_h", height).where("text <> '' and size is not null and y <= 0.55 * _h and length(text) <= 250")
    return lines.where(T.is_legible("text") & ~T.is_banner("text") & ~F.col("text").rlike(TITLE_NOISE) & (digits <= 0.2 * F.length("text"))).drop("_h")


def best_title(lines: DataFrame) -> DataFrame:
    """(doc_id, title): lines of at least 95 % of the largest size, the earliest page's topmost and those that follow it on the page in
    its size without a larger gap than 2.2 times the size; at least ten characters and a plausible title."""
    top = F.max("size").over(Window.partitionBy("doc_id"))
    big = lines.withColumn("_top", top).where("size >= 0.95 * _top")
    first = big.groupBy("doc_id").agg(F.min(F.struct("page_number", "y", "line_no", "size")).alias("f"))
    same = big.join(first, "doc_id").where((F.col("page_number") == F.col("f.page_number")) & (F.abs(F.col("size") - F.col("f.size")) <= 0.5) & (F.struct("y", "line_no") >= F.struct("f.y", "f.line_no")))
    order = Window.partitionBy("doc_id").orderBy("y", "line_no")
    gap = F.coalesce((F.col("y") - F.lag("y").over(order) > 2.2 * F.col("f.size")).cast("int"), F.lit(0))
    chain = same.withColumn("_gap", gap).withColumn("_far", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_far = 0")
    made = chain.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y", "line_no", "text"))).alias("l")).select("doc_id", T.strip(T.collapse(F.array_join(F.transform("l", lambda s: s.text), " "))).alias("title"))
    return made.where((F.length("title") >= 10) & ~T.is_banner("title") & T.is_plausible_title("title"))


def pages_of_layout(layout: DataFrame, tables: bool = True, marks: bool = False) -> DataFrame:
    """(doc_id, page_number, text, lines, tables) of pages as a layout parser gives them: ``blocks`` of lines of spans, and ``grids``.

    ``blocks`` is array<struct<lines: array<struct<spans: array<struct<text, size, flags, y>>, x0, y0, x1, y1>>>>, ``grids``
    array<struct<x0, y0, x1, y1, rows: array<array<string>>>>. Lines are read in order, without icon glyphs, with mathematical letters
    restored and, with ``marks``, with sub- and superscripts marked; empty ones drop out. With ``tables``, grids of two rows
    or more are rendered, and lines whose centre lies in one of them are left to it. The text is that of the lines."""
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
    grids = F.transform("grids", lambda g: F.struct(g.x0.cast("double").alias("x0"), g.y0.cast("double").alias("y0"), g.x1.cast("double").alias("x1"), g.y1.cast("double").alias("y1"), render_table(g.rows).alias("text")))
    grids = F.coalesce(F.filter(grids, lambda g: g.text.isNotNull()), F.array().cast(kind)) if tables else F.array().cast(kind)
    rows = layout.select("doc_id", "page_number", F.flatten(F.transform("blocks", lambda b: b.lines)).alias("_l"), grids.alias("_g"))

    def line(x: Column) -> Column:
        style = line_of_spans(x.spans)
        text = T.restore_truncated_math(T.strip_icon_glyphs(render_spans(x.spans, marks)))
        return F.struct(text.alias("text"), style["size"].alias("size"), F.coalesce(style.bold, F.lit(False)).alias("bold"), x.y0.cast("double").alias("y"))

    outside = F.filter("_l", lambda x: (F.size(x.spans) > 0) & ~inside(x.x0, x.y0, x.x1, x.y1, F.col("_g")))
    lines = F.filter(F.transform(outside, line), lambda x: x.text != "")
    return rows.select("doc_id", "page_number", F.coalesce(lines, F.array().cast("array<struct<text:string,size:double,bold:boolean,y:double>>")).alias("lines"), "_g").select("doc_id", "page_number", F.array_join(F.transform("lines", lambda x: x.text), "\n").alias("text"), "lines", F.transform("_g", lambda g: g.text).alias("tables"))


def render_table(rows: Column) -> Column:
    """Rows of cells as lines with bars; empty rows dropped; NULL unless two lines or more remain."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: T.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    lines = F.transform(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | "))
    return F.when(F.size(lines) >= 2, F.array_join(lines, "\n"))


def inside(x0: Column, y0: Column, x1: Column, y1: Column, regions: Column) -> Column:
    """Whether the centre of a box lies in one of the regions, borders included."""
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return F.exists(regions, lambda r: (cx >= r.x0) & (cx <= r.x1) & (cy >= r.y0) & (cy <= r.y1))


def line_of_spans(spans: Column) -> Column:
    """struct<size, bold>: the largest size, to one place, and whether a span carries the bold flag (16)."""
    return F.struct(F.round(F.array_max(F.transform(spans, lambda s: s["size"])), 1).alias("size"), F.exists(spans, lambda s: s.flags.bitwiseAND(16) != 0).alias("bold"))
