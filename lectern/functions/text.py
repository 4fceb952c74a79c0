"""Scalar text functions as column expressions: cleaning, titles, tokens, sentences, citations, questions.

All stay inside the JVM. NULL in gives NULL out unless a function says otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every white-space character, as a regular-expression class that Java and RE2 read alike.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_B = BLANK[1:-1]
PRIVATE_USE = r"[\x{e000}-\x{f8ff}\x{f0000}-\x{10ffff}]"

# Words too common to index.
STOPWORDS = "a an the of in on at to for and or is are was were be been it its this that these those as by with from we our".split()
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"

# Abbreviations that do not end a sentence.
ABBREVIATIONS = ["et al.", "e.g.", "i.e.", "etc.", "vs.", "Fig.", "Figs.", "Eq.", "Eqs.", "Ref.", "Refs.", "Sect.", "cf.", "approx.", "resp.", "Dr.", "Mr.", "Mrs.", "No.", "pp.", "Vol.", "vol."]

# Labels and journal names that are no titles, and placeholder titles.
BANNERS = ["review", "reviews", "review articles", "review article", "articles", "article", "research article", "research articles", "letter", "letters", "perspective", "perspectives", "editorial", "news and views", "comment", "brief communication", "rapid communication", "short communication", "original article", "technical note", "correspondence", "abstract", "supplementary information", "open access", "research"]
JOURNALS = ["astronomy astrophysics", "astronomy & astrophysics", "science advances", "nature", "science", "icarus", "physical review", "physical review letters", "journal of chemical physics", "the journal of chemical physics", "proceedings", "communications of the acm", "online", "advertisement", "science journals", "science journals aaas", "aaas", "hhs public access", "author manuscript", "public access", "downloaded from", "the new england journal of medicine", "new england journal of medicine", "nejm", "ieee", "acm"]
PLACEHOLDER_TITLES = ["untitled", "no title", "title", "document", "microsoft word", "paper", "manuscript", "untitled document", "doc", "pdf", "main", "article"]

# Phrases of comparative, dependent and referring questions.
COMPARATIVE = r"(?i)\b(compare|comparison|contrast|versus|vs\.?|each (?:paper|study|article|author)|which (?:papers|studies|articles)|any (?:two|other) papers?|both papers|across (?:the )?papers|between (?:the )?(?:two )?papers|do (?:they|the papers) (?:agree|disagree)|disagree)\b"
DEPENDENT = r"(?i)^(and|but|so|then|what about|how about|why|and what|ok|okay|also)\b"
REFERRING = r"(?i)\b(it|its|it's|they|them|their|that|those|this|these|he|she|his|her|the same|the former|the latter|there|then)\b"
CITATION = r"(?i)\[Excerpt\s+(\d+)\]"
BANNED_IN_QUESTIONS = ["passage", "excerpt", "this text", "the above", "the following"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(col(x), f"^{BLANK}+", ""), f"{BLANK}+$", "")


def collapse(x: Column | str) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(col(x), f"{BLANK}+", " ")


def words(x: Column | str) -> Column:
    """The words between white space; an empty array for blank text."""
    return F.filter(F.split(col(x), f"{BLANK}+"), lambda w: w != "")


def strip_icon_glyphs(x: Column | str) -> Column:
    """Private-use glyphs become spaces, runs of spaces and tabs one space."""
    return strip(F.regexp_replace(F.regexp_replace(col(x), PRIVATE_USE, " "), r"[ \t]+", " "))


def math_letters() -> tuple[str, str]:
    """Code points U+D400..D7FF that lost their plane bit, and the letters that their mathematical forms fold to."""
    pairs = []
    for code in range(0xD400, 0xD800):
        whole = chr(code + 0x10000)
        folded = unicodedata.normalize("NFKC", whole)
        if folded != whole and len(folded) == 1:
            pairs.append((chr(code), folded))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def restore_truncated_math(x: Column | str) -> Column:
    """Truncated mathematical letters as plain ones; a text with other Hangul syllables is left alone."""
    lost, letters = math_letters()
    return F.when(col(x).rlike(r"[\x{ac00}-\x{d3ff}]"), col(x)).otherwise(F.translate(col(x), lost, letters))


def clean_text(x: Column | str) -> Column:
    """Words broken before a lower-case letter joined, all white space as single spaces."""
    return strip(collapse(F.regexp_replace(col(x), "-\n(?=[a-z])", "")))


def normal_banner(x: Column | str) -> Column:
    """Lower case, punctuation as spaces."""
    return strip(collapse(F.regexp_replace(F.lower(col(x)), rf"[^\p{{L}}\p{{N}}_{_B}]", " ")))


def is_banner(x: Column | str) -> Column:
    """A journal's name or a label such as "research article"."""
    return normal_banner(x).isin(*BANNERS, *JOURNALS)


def is_legible(x: Column | str) -> Column:
    """At least three quarters letters and white space; the empty text is not."""
    kept = F.length(F.regexp_replace(col(x), rf"[^\p{{L}}{_B}]", ""))
    return (F.length(col(x)) > 0) & (kept >= F.length(col(x)) * 0.75)


def is_plausible_title(x: Column | str) -> Column:
    """Legible, two words of Latin letters or more, 30 words at most, a capital or digit first."""
    return is_legible(x) & (F.size(F.regexp_extract_all(col(x), F.lit("[A-Za-z]{2,}"), F.lit(0))) >= 2) & (F.size(words(x)) <= 30) & F.substring(strip(x), 1, 1).rlike(r"[\p{Lu}\p{Lt}\p{Nd}]")


def metadata_title(x: Column | str) -> Column:
    """A usable title from metadata, else NULL."""
    t = strip(collapse(F.regexp_replace(F.coalesce(col(x), F.lit("")), "<[^>]+>", "")))
    lower = F.regexp_replace(F.lower(t), r"\.+$", "")
    bad = ~F.length(t).between(10, 250) | lower.isin(*PLACEHOLDER_TITLES) | is_banner(t) | t.rlike(r"(?i)\.(pdf|docx?|tex|indd|qxd|qxp|pages|rtf)$")
    bad = bad | ((F.lower(t) == t) & t.rlike(r"\p{L}") & (F.size(words(t)) < 3)) | ~is_plausible_title(t)
    return F.when(~bad, t)


def unmarked(x: Column | str) -> Column:
    """Lower case without sub- and superscript markers."""
    return F.translate(F.lower(col(x)), "^_{}", "")


def tokens(x: Column | str) -> Column:
    """Index tokens: runs of ASCII letters and digits, joined by dots and hyphens, without stop words; NULL gives none."""
    return F.filter(F.regexp_extract_all(unmarked(F.coalesce(col(x), F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))  # a hash set, not a scan


def sentences(x: Column | str) -> Column:
    """Sentences: cut after . ! ? before white space and an ASCII capital, abbreviations excepted."""
    t = col(x)
    for i, abbreviation in enumerate(ABBREVIATIONS):
        t = F.replace(t, F.lit(abbreviation), F.lit(f"\x01{i}\x02"))
    parts = F.split(t, rf"(?<=[.!?]){BLANK}+(?=[A-Z]|$)")

    def restore(s: Column) -> Column:
        for i, abbreviation in enumerate(ABBREVIATIONS):
            s = F.replace(s, F.lit(f"\x01{i}\x02"), F.lit(abbreviation))
        return strip(s)

    return F.filter(F.transform(parts, restore), lambda s: s != "")


def citation(title: Column, page_start: Column, page_end: Column, section: Column) -> Column:
    """"title, p. 3-4, Section s", each part only if there is one; "source unknown" if there is none."""
    page = F.when(page_start > 0, F.concat(F.lit("p. "), page_start.cast("string"), F.when((page_end > 0) & (page_end != page_start), F.concat(F.lit("-"), page_end.cast("string"))).otherwise("")))
    named = F.when(title != "", title)
    part = F.when(section != "", F.concat(F.lit("Section "), section))
    return F.coalesce(F.nullif(F.concat_ws(", ", named, page, part), F.lit("")), F.lit("source unknown"))


def excerpt_label(number: Column, cited: Column) -> Column:
    return F.concat(F.lit("[Excerpt "), number.cast("string"), F.lit("] ("), cited, F.lit(")"))


def short_title(x: Column | str) -> Column:
    """At most 70 characters."""
    return F.when(F.length(col(x)) > 70, F.concat(F.substring(col(x), 1, 67), F.lit("..."))).otherwise(col(x))


def title_case(x: Column | str) -> Column:
    """Every run of ASCII letters with a capital first and small letters after it, so "CROSS-CHECK" gives "Cross-Check"."""
    parts = F.split(col(x), "(?<=[^A-Za-z])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def filename_title(x: Column | str) -> Column:
    """A file name's stem with underscores as spaces."""
    return strip(F.regexp_replace(F.regexp_replace(col(x), r"(.)\.[^.]*$", "$1"), rf"[{_B}_]+", " "))


def looks_comparative(x: Column | str) -> Column:
    """Whether a question spans several papers; NULL does not."""
    return F.coalesce(col(x), F.lit("")).rlike(COMPARATIVE)


def looks_self_contained(x: Column | str) -> Column:
    """Whether a question stands alone: no dependent opener, no referring word, five words or more."""
    q = strip(F.coalesce(col(x), F.lit("")))
    return ~q.rlike(DEPENDENT) & ~q.rlike(REFERRING) & (F.size(words(q)) >= 5)


def accept_rewrite(question: Column | str, reply: Column | str) -> Column:
    """The first line of a model's rewrite without label and quotes, or the question if that is no single short question."""
    first = F.split_part(strip(reply), F.lit("\n"), F.lit(1))
    r = F.regexp_replace(F.regexp_replace(strip(F.regexp_replace(first, r"(?i)^(standalone question|question)\s*[:\-]\s*", "")), '^"+', ""), '"+$', "")
    return F.when((r == "") | (F.length(r) > 300) | ~F.contains(r, F.lit("?")) | r.isNull(), col(question)).otherwise(r)


def cited_excerpts(x: Column | str) -> Column:
    """The excerpt numbers of an answer, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(CITATION), F.lit(1)), lambda n: F.try_cast(n, "int") if hasattr(F, "try_cast") else n.cast("int"))


def claims(x: Column | str) -> Column:
    """The claims of a model's reply: a line each, without bullets, numbers and citations, longer than 15 characters; none if it begins with NONE."""
    raw = strip(F.coalesce(col(x), F.lit("")))
    lines = F.transform(F.split(raw, "\n"), lambda s: strip(F.regexp_replace(strip(F.regexp_replace(s, r"^\s*[-*•]?\s*\d*[.)]?\s*", "")), CITATION, "")))
    return F.when(F.startswith(F.upper(raw), F.lit("NONE")), F.array().cast("array<string>")).otherwise(F.filter(lines, lambda s: F.length(s) > 15))


def verdict(x: Column | str) -> Column:
    """The first of CONTRADICTED, UNSUPPORTED, SUPPORTED that a reply contains; UNSUPPORTED for others and NULL."""
    up = F.upper(F.coalesce(col(x), F.lit("")))
    return F.when(F.contains(up, F.lit("CONTRADICTED")), "CONTRADICTED").when(F.contains(up, F.lit("UNSUPPORTED")), "UNSUPPORTED").when(F.contains(up, F.lit("SUPPORTED")), "SUPPORTED").otherwise("UNSUPPORTED")


def generated_question(x: Column | str) -> Column:
    """A generated question without label and quotes, its first line."""
    bare = strip(F.regexp_replace(strip(x), r"(?i)^(question|q)\s*[:\-]\s*", ""))
    return strip(F.split_part(F.regexp_replace(F.regexp_replace(bare, '^"+', ""), '"+$', ""), F.lit("\n"), F.lit(1)))


def usable_question(x: Column | str, least: int = 25, most: int = 220) -> Column:
    """Of fitting length, with a question mark and without words that point at the passage."""
    ok = F.length(col(x)).between(least, most) & F.contains(col(x), F.lit("?"))
    for phrase in BANNED_IN_QUESTIONS:
        ok = ok & ~F.contains(F.lower(col(x)), F.lit(phrase))
    return F.coalesce(ok, F.lit(False))


def lexical_overlap(question: Column | str, text: Column | str) -> Column:
    """The share of the question's distinct tokens that the text has; 1 if it has none."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) == 0, 1.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def in_scope(title: Column | str, needle: str | None) -> Column:
    """Whether a title contains the trimmed needle, ignoring case; an empty needle is in every title."""
    n = (needle or "").strip().lower()
    return F.lit(True) if not n else F.coalesce(F.contains(F.lower(col(title)), F.lit(n)), F.lit(False))


def retrieval_summary(mode: Column, n_sources: Column, quota: Column, n_dense: Column, n_lexical: Column, n_fused: Column) -> Column:
    """One line on how the passages were found."""
    tail = F.concat(n_sources.cast("string"), F.lit(" passages"), F.when(quota.isNotNull() & (quota != 0), F.concat(F.lit(", quota "), quota.cast("string"), F.lit("/paper"))).otherwise(""))
    single = F.concat(mode, F.lit(" retrieval -> "), tail)
    double = F.concat(n_dense.cast("string"), F.lit(" dense + "), n_lexical.cast("string"), F.lit(" lexical candidates -> "), n_fused.cast("string"), F.lit(" fused -> "), tail)
    return F.when(mode.isin("dense", "bm25"), single).otherwise(double)


def source_block(number: Column, cited: Column, score: Column, text: Column) -> Column:
    """One retrieved passage as a collapsible block with its number, citation and score to three places."""
    return F.format_string("<details open><summary><b>[Excerpt %d]</b> %s <i>score %.3f</i></summary>\n\n%s\n\n</details>", number, cited, score, text)
