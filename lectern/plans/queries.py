"""The engine's own queries over the test tables, each with its SQL where SQL can say it.

Every query reads its whole tables. Rows delivered twice are taken once (``distinct`` over the columns in use)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, conversation, dense, evaluation, fusion, lexical, structure
from lectern.operators.ranking import latest_by
from lectern.runtime import settle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- SQL fragments
_B = T.BLANK


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_B}+', ''), '{_B}+$', '')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{_B}+', ' ', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_B}+'), lambda w: w <> '')"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(translate(lower(coalesce({x}, '')), '^_{{}}', ''), '{T.TOKEN}'), lambda t: not list_contains([{', '.join(repr(w) for w in T.STOPWORDS)}], t))"


def _in(x: str, values: list[str]) -> str:
    return f"{x} in ({', '.join(repr(v) for v in values)})"


def _banner(x: str) -> str:
    return _strip(_collapse(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{_B[1:-1]}]', ' ', 'g')"))


def _legible(x: str) -> str:
    return f"(length({x}) > 0 and length(regexp_replace({x}, '[^\\p{{L}}{_B[1:-1]}]', '', 'g')) >= length({x}) * 0.75)"


def _plausible(x: str) -> str:
    return f"({_legible(x)} and len(regexp_extract_all({x}, '[A-Za-z]{{2,}}')) >= 2 and len({_words(x)}) <= 30 and regexp_matches(substr({_strip(x)}, 1, 1), '[\\p{{Lu}}\\p{{Lt}}\\p{{Nd}}]'))"


def _sentences(x: str) -> str:
    for i, a in enumerate(T.ABBREVIATIONS):
        x = f"replace({x}, '{a}', chr(1) || '{i}' || chr(2))"
    x = f"string_split(regexp_replace({x}, '([.!?]){_B}+([A-Z])', '\\1' || chr(30) || '\\2', 'g'), chr(30))"
    s = "s"
    for i, a in enumerate(T.ABBREVIATIONS):
        s = f"replace({s}, chr(1) || '{i}' || chr(2), '{a}')"
    return f"list_filter(list_transform({x}, lambda s: {_strip(s)}), lambda z: z <> '')"


def _heading_shape(x: str) -> str:
    return f"""(length({x}) between 2 and 80 and len({_words(x)}) between 1 and 12 and regexp_matches({x}, '^[\\p{{Lu}}\\p{{Lt}}\\p{{Nd}}]') and regexp_matches({x}, '[\\p{{L}}\\p{{N}}]$')
 and length({x}) - length(replace({x}, ',', '')) <= 1 and length(regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')) <= length({x}) * 0.3
 and not regexp_matches({x}, '{structure.NO_HEADING}') and not {_in(f"regexp_replace(lower({x}), '[.:]+$', '')", T.BANNERS)} and not regexp_matches({x}, '^(?i:fig|table|eq|plate)'))"""


_CH = "ch as (select distinct doc_id, chunk_id, text from chunks where doc_id is not null and chunk_id is not null)"
_QS = "qs as (select distinct id as query_id, question, paper, must_contain, doc_id from corpus_queries where id is not null)"
_TITLES = "titles as (select doc_id, max(paper) as title from (select doc_id, paper from corpus_queries union all select doc_id, paper from benchmark) where doc_id is not null group by doc_id)"
_CITE = "coalesce(nullif(concat_ws(', ', case when title <> '' then title end, case when page_start > 0 then 'p. ' || page_start || case when page_end > 0 and page_end <> page_start then '-' || page_end else '' end end, case when section <> '' then 'Section ' || section end), ''), 'source unknown')"


def _bm25(k: int, questions: str = "qs", scope: str = "true") -> str:
    """CTEs tk, post, stat, wt, lx (query_id, doc_id, chunk_id, score, rank)."""
    return f"""tk as (select doc_id, chunk_id, {_tok('text')} as t from ch),
post as (select doc_id, chunk_id, term, count(*) as tf from (select doc_id, chunk_id, unnest(t) as term from tk) group by all),
stat as (select count(*) as n, avg(len(t)) as mean_len from tk),
wt as (select term, count(*) as df, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from post, stat group by term),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tok('question')}) as term from {questions}) group by all),
ls as (select qt.query_id, p.doc_id, p.chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tk.t) / case when mean_len > 0 then mean_len else 1 end))), 9) as score
  from qt join post p using (term) join wt using (term) join tk on tk.doc_id = p.doc_id and tk.chunk_id = p.chunk_id, stat where {scope} group by all),
lx as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_id) as rank from ls) where rank <= {k})"""


def _dense(k: int, questions: str = "qs") -> str:
    """CTEs hv, hq, dn (query_id, doc_id, chunk_id, score, rank); texts without tokens score 0."""
    slot = "('0x' || substr(md5(t), 1, 6))::bigint % 64"
    return f"""hc as (select doc_id, chunk_id, b, count(*) as c from (select doc_id, chunk_id, unnest(list_transform({_tok('text')}, lambda t: {slot})) as b from ch where text is not null) group by all),
hv as (select *, c / sqrt(sum(c * c) over (partition by doc_id, chunk_id)) as w from hc),
hd as (select query_id, b, count(*) as c from (select query_id, unnest(list_transform({_tok('question')}, lambda t: {slot})) as b from {questions}) group by all),
hq as (select *, c / sqrt(sum(c * c) over (partition by query_id)) as w from hd),
dp as (select hq.query_id, hv.doc_id, hv.chunk_id, sum(hq.w * hv.w) as s from hq join hv using (b) group by all),
ds as (select q.query_id, ch.doc_id, ch.chunk_id, round(coalesce(s, 0), 9) as score from (select distinct query_id from {questions}) q cross join ch left join dp on dp.query_id = q.query_id and dp.doc_id = ch.doc_id and dp.chunk_id = ch.chunk_id),
dn as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_id) as rank from ds) where rank <= {k})"""


def _fused(pool: int, wd: float = 1.0, wl: float = 1.0) -> str:
    return f"""ev as (select *, {wd}::double as w from dn union all select *, {wl}::double as w from lx),
fu as (select query_id, doc_id, chunk_id, round(sum(w / (60 + rank)), 12) as fused, min(rank) as best_rank, max(score) as first_score from ev group by all),
fr as (select * from (select *, row_number() over (partition by query_id order by fused desc, best_rank, doc_id, chunk_id) as rank from fu) where rank <= {pool})"""


def _divers(source: str, k: int, quota: str = "null::int") -> str:
    return f"""od as (select *, coalesce(row_number() over (partition by query_id, doc_id order by rank) > {quota} and {quota} >= 1, false) as over from {source}),
fin as (select * exclude (rank, over, place), place as rank from (select *, row_number() over (partition by query_id order by over, rank) as place from od) where place <= {k})"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs
def _chunks(s: SparkSession, d: str, *more: str) -> DataFrame:
    return table(s, d, "chunks").where("doc_id is not null and chunk_id is not null").select("doc_id", "chunk_id", "text", *more).distinct()


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """The chunks with their tokens, settled, for queries that read them several times."""
    return settle(_chunks(s, d).withColumn("tokens", T.tokens("text")))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "corpus_queries").where("id is not null").select(F.col("id").alias("query_id"), "question", "paper", "must_contain", "doc_id").distinct()


def _split_name(split: Column) -> Column:
    clean = F.lower(F.trim(split))
    return F.when(clean.isin("train", "training"), "train").when(clean.isin("val", "validation", "dev"), "val").when(clean == "test", "test")


def _titles(s: SparkSession, d: str) -> DataFrame:
    both = table(s, d, "corpus_queries").select("doc_id", "paper").unionByName(table(s, d, "benchmark").select("doc_id", "paper"))
    return both.where("doc_id is not null").groupBy("doc_id").agg(F.max("paper").alias("title"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return latest_by(table(s, d, "raw_pages").where("text is not null"), ["doc_id", "page_number"], "scanned_at", ["text"]).drop("scanned_at")


# ---------------------------------------------------------------- text functions
def _text_query(name: str, source: str, keys: list[str], column: str, fn, sql: str) -> None:
    """A text function over a column of a table, as the MD5 of its result."""
    where = f"{column} is not null"

    def run(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, source).where(where).select(*keys, F.md5(fn(F.col(column))).alias("digest")).distinct()

    QUERIES[name] = run
    SQL[name] = f"select distinct {', '.join(keys)}, md5({sql}) as digest from {source} where {where}"


_lost, _letters = T.math_letters()
_text_query("t01_icon_glyphs", "documents", ["doc_id"], "text", T.strip_icon_glyphs, _strip(f"regexp_replace(regexp_replace(text, '{T.PRIVATE_USE}', ' ', 'g'), '[ \\t]+', ' ', 'g')"))
_text_query("t02_truncated_math", "documents", ["doc_id"], "text", T.restore_truncated_math, f"case when regexp_matches(text, '[\\x{{ac00}}-\\x{{d3ff}}]') then text else translate(text, '{_lost}', '{_letters}') end")
_text_query("t04_clean_text", "raw_pages", ["doc_id", "page_number"], "text", T.clean_text, _strip(_collapse("regexp_replace(text, '-\\n([a-z])', '\\1', 'g')")))
_text_query("t05_banner_form", "documents", ["doc_id"], "title", T.normal_banner, _banner("title"))
_text_query("t11_unmarked", "chunks", ["doc_id", "chunk_id"], "text", T.unmarked, "translate(lower(text), '^_{}', '')")
_text_query("t15_short_title", "documents", ["doc_id"], "title", T.short_title, "case when length(title) > 70 then substr(title, 1, 67) || '...' else title end")
_text_query("t16_filename_title", "documents", ["doc_id"], "filename", T.filename_title, _strip(f"regexp_replace(regexp_replace(filename, '(.)\\.[^.]*$', '\\1'), '[{_B[1:-1]}_]+', ' ', 'g')"))

_HEADS = "heads as (select distinct section as line from segments where section is not null union select distinct title from documents where title is not null)"


def _heads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "segments").select(F.col("section").alias("line")).unionByName(table(s, d, "documents").select(F.col("title").alias("line"))).where("line is not null").distinct()


@query(f"with {_HEADS} select line, {_in(_banner('line'), T.BANNERS + T.JOURNALS)} as is_banner, {_legible('line')} as is_legible, {_plausible('line')} as is_plausible from heads")
def t06_t08_line_tests(s: SparkSession, d: str) -> DataFrame:
    """Banner, legibility and title tests of all section names and titles."""
    return _heads(s, d).select("line", T.is_banner("line").alias("is_banner"), T.is_legible("line").alias("is_legible"), T.is_plausible_title("line").alias("is_plausible"))


@query(f"""with {_HEADS}, t as (select line, {_strip(_collapse("regexp_replace(line, '<[^>]+>', '', 'g')"))} as t from heads)
select line, case when length(t) between 10 and 250 and not {_in("regexp_replace(lower(t), '[.]+$', '')", T.PLACEHOLDER_TITLES)} and not {_in(_banner('t'), T.BANNERS + T.JOURNALS)}
 and not regexp_matches(t, '(?i)\\.(pdf|docx?|tex|indd|qxd|qxp|pages|rtf)$') and not (lower(t) = t and regexp_matches(t, '\\p{{L}}') and len({_words('t')}) < 3) and {_plausible('t')} then t end as title from t""")
def t09_metadata_title(s: SparkSession, d: str) -> DataFrame:
    """Usable metadata titles."""
    return _heads(s, d).select("line", T.metadata_title("line").alias("title"))


@query(f"with {_CH} select doc_id, chunk_id, len(t) as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, chunk_id, {_tok('text')} as t from ch)")
def t10_tokens(s: SparkSession, d: str) -> DataFrame:
    """Index tokens of every chunk."""
    return _chunks(s, d).select("doc_id", "chunk_id", T.tokens("text").alias("t")).select("doc_id", "chunk_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"with {_CH} select doc_id, chunk_id, len(t) as n_sentences, md5(array_to_string(t, chr(10))) as digest from (select doc_id, chunk_id, {_sentences('text')} as t from ch where text is not null)")
def t12_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences of every chunk."""
    return _chunks(s, d).where("text is not null").select("doc_id", "chunk_id", T.sentences("text").alias("t")).select("doc_id", "chunk_id", F.size("t").alias("n_sentences"), F.md5(F.array_join("t", "\n")).alias("digest"))


@query(f"with {_TITLES}, c as (select distinct doc_id, chunk_id, page_start, page_end, section from chunks where doc_id is not null) select c.doc_id, chunk_id, {_CITE} as cited, '[Excerpt ' || (chunk_id + 1) || '] (' || {_CITE} || ')' as label from c left join titles t on c.doc_id = t.doc_id")
def t13_t14_citations(s: SparkSession, d: str) -> DataFrame:
    """Citation and excerpt label of every chunk, with the paper's title."""
    c = table(s, d, "chunks").where("doc_id is not null").select("doc_id", "chunk_id", "page_start", "page_end", "section").distinct().join(_titles(s, d), "doc_id", "left")
    cited = T.citation(F.col("title"), F.col("page_start"), F.col("page_end"), F.col("section"))
    return c.select("doc_id", "chunk_id", cited.alias("cited"), T.excerpt_label(F.col("chunk_id") + 1, cited).alias("label"))


_Q = "q as (select distinct turn_id, question, answer, retrieval_question from turns where turn_id is not null)"


@query(f"""with {_Q} select turn_id, regexp_matches(coalesce(question, ''), '{T.COMPARATIVE}') as comparative,
 not regexp_matches({_strip("coalesce(question, '')")}, '{T.DEPENDENT}') and not regexp_matches({_strip("coalesce(question, '')")}, '{T.REFERRING.replace("'", "''")}') and len({_words("coalesce(question, '')")}) >= 5 as self_contained,
 coalesce(length(question) between 25 and 220 and contains(question, '?') and {' and '.join(f"not contains(lower(question), '{w}')" for w in T.BANNED_IN_QUESTIONS)}, false) as usable from q""")
def t17_t18_t23_question_tests(s: SparkSession, d: str) -> DataFrame:
    """Comparative, self-contained and usable questions."""
    q = table(s, d, "turns").where("turn_id is not null").select("turn_id", "question", "answer", "retrieval_question").distinct()
    return q.select("turn_id", T.looks_comparative("question").alias("comparative"), T.looks_self_contained("question").alias("self_contained"), T.usable_question("question").alias("usable"))


@query(f"""with {_Q}, b as (select turn_id, {_strip("regexp_replace(" + _strip("coalesce(retrieval_question, question)") + ", '(?i)^(question|q)\\s*[:\\-]\\s*', '')")} as b from q),
g as (select turn_id, {_strip("split_part(regexp_replace(regexp_replace(b, '^\"+', ''), '\"+$', ''), chr(10), 1)")} as g from b)
select turn_id, coalesce(g, '') as generated, coalesce(length(g) between 20 and 200 and contains(g, '?') and {' and '.join(f"not contains(lower(g), '{w}')" for w in T.BANNED_IN_QUESTIONS)}, false) as usable from g""")
def t23_generated_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions as a model may have given them, cleaned, and whether they are fit for training."""
    q = table(s, d, "turns").where("turn_id is not null").select("turn_id", "question", "answer", "retrieval_question").distinct()
    made = q.select("turn_id", T.generated_question(F.coalesce("retrieval_question", "question")).alias("g"))
    return made.select("turn_id", F.coalesce("g", F.lit("")).alias("generated"), T.usable_question("g", 20, 200).alias("usable"))


@query(f"""with {_Q}, r as (select turn_id, question, {_strip('retrieval_question')} as s from q),
r2 as (select turn_id, question, regexp_replace(regexp_replace({_strip("regexp_replace(split_part(s, chr(10), 1), '(?i)^(standalone question|question)\\s*[:\\-]\\s*', '')")}, '^"+', ''), '"+$', '') as r from r)
select turn_id, case when r is null or r = '' or length(r) > 300 or not contains(r, '?') then question else r end as rewritten from r2""")
def t19_rewrites(s: SparkSession, d: str) -> DataFrame:
    """Accepted rewrites of follow-up questions."""
    q = table(s, d, "turns").where("turn_id is not null").select("turn_id", "question", "answer", "retrieval_question").distinct()
    return q.select("turn_id", T.accept_rewrite("question", "retrieval_question").alias("rewritten"))


_A = "a as (select distinct answer_id, question, text, n_sources from answers where answer_id is not null)"


def _answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "answers").where("answer_id is not null").select("answer_id", "question", "text", "n_sources").distinct()


@query(f"""with {_A}, n as (select answer_id, coalesce(n_sources, 0) as n, list_transform(regexp_extract_all(coalesce(text, ''), '{T.CITATION}', 1), lambda x: x::int) as c from a),
k as (select answer_id, n, c, list_filter(c, lambda x: x >= 1 and x <= n) as v from n)
select answer_id, len(c) as total, len(v) as valid, n as supplied, len(list_distinct(v)) as distinct_valid, case when len(c) > 0 then len(v) / len(c) end as validity, case when n > 0 then len(list_distinct(v)) / n end as utilisation from k""")
def t20_a10_citation_counts(s: SparkSession, d: str) -> DataFrame:
    """Citation counts and ratios of every answer."""
    a = _answers(s, d).withColumn("n", F.coalesce("n_sources", F.lit(0))).select("answer_id", evaluation.citation_counts(F.col("text"), F.col("n")).alias("c"))
    return a.select("answer_id", "c.*").withColumn("validity", evaluation.ratio(F.col("valid"), F.col("total"))).withColumn("utilisation", evaluation.ratio(F.col("distinct_valid"), F.col("supplied")))


@query(f"""with {_A}, l as (select answer_id, {_strip("coalesce(text, '')")} as raw from a),
c as (select answer_id, case when starts_with(upper(raw), 'NONE') then []::varchar[] else list_filter(list_transform(string_split(raw, chr(10)), lambda s: {_strip("regexp_replace(" + _strip("regexp_replace(s, '^[\\t-\\r ]*[-*•]?[\\t-\\r ]*\\d*[.)]?[\\t-\\r ]*', '')") + f", '{T.CITATION}', '', 'g')")}), lambda z: length(z) > 15) end as c from l)
select answer_id, len(c) as n_claims, md5(array_to_string(c, chr(10))) as digest from c""")
def t21_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims, were every answer a model's list of them."""
    return _answers(s, d).select("answer_id", T.claims("text").alias("c")).select("answer_id", F.size("c").alias("n_claims"), F.md5(F.array_join("c", "\n")).alias("digest"))


_VERDICT = "case when contains(upper(coalesce(answer, '')), 'CONTRADICTED') then 'CONTRADICTED' when contains(upper(coalesce(answer, '')), 'UNSUPPORTED') then 'UNSUPPORTED' when contains(upper(coalesce(answer, '')), 'SUPPORTED') then 'SUPPORTED' else 'UNSUPPORTED' end"


@query(f"""with v as (select distinct conv_id, turn_id, {_VERDICT} as verdict from turns where turn_id is not null)
select conv_id, count(*) as n_verdicts, count(*) filter (verdict = 'SUPPORTED') / count(*) as faithfulness, count(*) filter (verdict = 'CONTRADICTED') / count(*) as contradiction_rate from v group by conv_id""")
def t22_a09_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Verdict ratios by conversation, every answer read as a judge's reply."""
    v = table(s, d, "turns").where("turn_id is not null").select("conv_id", "turn_id", T.verdict("answer").alias("verdict")).distinct()
    share = lambda x: F.avg((F.col("verdict") == x).cast("double"))
    return v.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_verdicts"), share("SUPPORTED").alias("faithfulness"), share("CONTRADICTED").alias("contradiction_rate"))


@query(f"""with {_CH}, b as (select distinct id, doc_id, source_chunk, question from benchmark where id is not null)
select id, case when len(list_distinct({_tok('question')})) = 0 then 1.0 else round(len(list_intersect(list_distinct({_tok('question')}), {_tok('text')})) / len(list_distinct({_tok('question')})), 9) end as overlap from b join ch on ch.doc_id = b.doc_id and ch.chunk_id = b.source_chunk""")
def t24_x2_lexical_overlap(s: SparkSession, d: str) -> DataFrame:
    """Overlap of every benchmark question with its chunk."""
    b = table(s, d, "benchmark").where("id is not null").select("id", "doc_id", F.col("source_chunk").alias("chunk_id"), "question").distinct()
    return b.join(_chunks(s, d), ["doc_id", "chunk_id"]).select("id", F.round(T.lexical_overlap("question", "text"), 9).alias("overlap"))


@query("select distinct doc_id, title from documents where contains(lower(title), 'boundary layer')")
def t25_title_filter(s: SparkSession, d: str) -> DataFrame:
    """Documents whose title holds a phrase."""
    return table(s, d, "documents").where(T.in_scope("title", "  Boundary layer ")).select("doc_id", "title").distinct()


@query("""with a as (select distinct answer_id, mode, n_sources, max_per_document as m from answers where answer_id is not null)
select answer_id, case when mode in ('dense', 'bm25') then mode || ' retrieval -> ' || n_sources || ' passages' else '30 dense + 30 lexical candidates -> 30 fused -> ' || n_sources || ' passages' end || case when m is not null and m <> 0 then ', quota ' || m || '/paper' else '' end as summary from a""")
def t26_summaries(s: SparkSession, d: str) -> DataFrame:
    """How each answer's passages were found, in a line."""
    a = table(s, d, "answers").where("answer_id is not null").select("answer_id", "mode", "n_sources", "max_per_document").distinct()
    return a.select("answer_id", T.retrieval_summary(F.col("mode"), F.col("n_sources"), F.col("max_per_document"), F.lit(30), F.lit(30), F.lit(30)).alias("summary"))


# ---------------------------------------------------------------- structure
# Pages as a layout parser gives them, made of the scanned lines: a block of all lines, a line of two spans, a grid of the first table at 60 to 120 points.


@query(f"""with p as (select doc_id, page_number, text, lines, tables from raw_pages where text is not null qualify row_number() over (partition by doc_id, page_number order by scanned_at desc nulls last, text desc) = 1),
l as (select doc_id, page_number, unnest(range(len(lines))) as n, unnest(lines) as l, tables from p where lines is not null),
g as (select doc_id, page_number, array_to_string(list_filter(list_transform(string_split(tables[1], chr(10)), lambda r: array_to_string(list_transform(string_split(r, ' | '), lambda c: {_strip('c')}), ' | ')), lambda r: regexp_matches(r, '[^ |]')), chr(10)) as g, len(list_filter(string_split(tables[1], chr(10)), lambda r: regexp_matches(r, '[^ |]'))) as rows from p where len(tables) > 0),
k as (select l.doc_id, l.page_number, n, {_strip(f"regexp_replace(regexp_replace(l.l.text, '{T.PRIVATE_USE}', ' ', 'g'), '[ \\t]+', ' ', 'g')")} as text, round(l.l.size, 1) as size, coalesce(l.l.bold, false) as bold from l left join g on g.doc_id = l.doc_id and g.page_number = l.page_number and g.rows >= 2 where not coalesce(l.l.y + 5 >= 60 and l.l.y + 5 <= 120 and g.rows >= 2, false)),
m as (select doc_id, page_number, count(*) as n_lines, count(*) filter (bold) as n_bold, round(sum(size), 3) as sizes, md5(string_agg(text, chr(10) order by n)) as digest from (select * replace (case when regexp_matches(text, '[\\x{{ac00}}-\\x{{d3ff}}]') then text else translate(text, '{_lost}', '{_letters}') end as text) from k) where text <> '' group by doc_id, page_number)
select p.doc_id, p.page_number, coalesce(n_lines, 0) as n_lines, coalesce(n_bold, 0) as n_bold, coalesce(sizes, 0) as sizes, coalesce(digest, md5('')) as digest, md5(coalesce(case when rows >= 2 then g end, '')) as grids from p left join m using (doc_id, page_number) left join g using (doc_id, page_number)""")
def s03_s04_s05_layout(s: SparkSession, d: str) -> DataFrame:
    """Lines and tables of every page, read from a layout that is made of its scanned lines: two spans a line, the page's first table as a
    grid at 60 to 120 points; lines whose centre lies in the grid are left to it."""
    half = lambda l: F.floor(F.length(l.text) / 2).cast("int")
    span = lambda l, part: F.struct(part.alias("text"), l["size"].alias("size"), F.when(F.coalesce(l.bold, F.lit(False)), 16).otherwise(0).alias("flags"), l.y.alias("y"))
    line = lambda l: F.struct(F.array(span(l, F.substring(l.text, F.lit(1), half(l))), span(l, F.substring(l.text, half(l) + 1, F.length(l.text)))).alias("spans"), F.lit(0.0).alias("x0"), l.y.alias("y0"), F.lit(100.0).alias("x1"), (l.y + 10).alias("y1"))
    grid = F.when(F.size("tables") > 0, F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(60.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(120.0).alias("y1"), F.transform(F.split(F.get("tables", F.lit(0)), "\n"), lambda r: F.split(r, r" \| ")).alias("rows"))))
    layout = _pages(s, d).select("doc_id", "page_number", F.array(F.struct(F.transform("lines", line).alias("lines"))).alias("blocks"), grid.alias("grids"))
    pages = structure.pages_of_layout(layout)
    sizes = F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.coalesce(x["size"], F.lit(0.0))), 3)
    return pages.select("doc_id", "page_number", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: x.bold)).cast("long").alias("n_bold"), sizes.alias("sizes"), F.md5("text").alias("digest"), F.md5(F.array_join("tables", "\n")).alias("grids"))


@query("""with p as (select * from raw_pages where text is not null qualify row_number() over (partition by doc_id, page_number order by scanned_at desc nulls last, text desc) = 1),
l as (select doc_id, page_number, unnest(range(len(lines))) as n, unnest(lines) as l from p where lines is not null),
z as (select doc_id, l.size as size, sum(length(l.text)) as c, min(page_number * 100000 + n) as f from l where l.size is not null and l.text is not null group by all)
select doc_id, size as body from z qualify row_number() over (partition by doc_id order by c desc, f) = 1""")
def d01_body_size(s: SparkSession, d: str) -> DataFrame:
    """Body font size of every scanned paper."""
    return structure.body_size(structure.page_lines(_pages(s, d)))


_P = "p as (select doc_id, page_number, text, lines, tables from raw_pages where text is not null qualify row_number() over (partition by doc_id, page_number order by scanned_at desc nulls last, text desc) = 1)"
_KEPT = f"""{_P}, b as (select *, coalesce(sum(length(text)) over (partition by doc_id order by page_number rows between unbounded preceding and 1 preceding), 0) as before, sum(length(text)) over (partition by doc_id) as whole,
 string_split_regex(text, '{structure.REFERENCES}') as pc, regexp_extract_all(text, '{structure.REFERENCES}') as hs from p),
c as (select *, list_min(list_filter(list_transform(range(1, len(hs) + 1), lambda k: (coalesce(list_sum(list_transform(pc[1:k], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(hs[1:k-1], lambda z: length(z))), 0))::bigint), lambda o: o + before >= 0.7 * whole)) as off from b),
d as (select *, min(case when off is not null then page_number end) over (partition by doc_id) as cut from c),
kept as (select doc_id, page_number, case when page_number = cut then substr(text, 1, off) else text end as text, case when page_number is distinct from cut then lines end as lines, case when page_number is distinct from cut then tables end as tables from d where cut is null or page_number <= cut)"""


@query(f"with {_KEPT} select doc_id, page_number, md5(text) as digest, length(text) as n_chars from kept")
def d02_without_references(s: SparkSession, d: str) -> DataFrame:
    """Pages left when reference lists are cut."""
    return structure.without_references(_pages(s, d)).select("doc_id", "page_number", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


_LINES = "lines_ as (select distinct unnest(string_split(text, chr(10))) as raw from raw_pages where text is not null), ln as (select distinct " + _strip("raw") + " as line from lines_)"


@query(f"""with {_LINES}, h as (select line, {_heading_shape('line')} as shape, regexp_matches(line, '{structure.NUMBERED}') as numbered, regexp_extract(line, '{structure.NUMBERED}', 1) as no, {_strip(f"regexp_extract(line, '{structure.NUMBERED}', 2)")} as title from ln where line <> '')
select line, shape, case when length(line) > 80 then null when numbered then case when not regexp_matches(title, '^(?i:fig|table|eq|plate)') and regexp_matches(title, '[\\p{{L}}\\p{{N}}]$') then no || ' ' || title end
 when regexp_matches(line, '{structure.UNNUMBERED}') then case when {_in('lower(line)', structure.SECTIONS)} then line when upper(line) = line and len({_words('line')}) between 2 and 6 then array_to_string(list_transform(regexp_extract_all(line, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '') end end as heading from h""")
def d03_d04_headings(s: SparkSession, d: str) -> DataFrame:
    """Heading shape and textual heading of every distinct line."""
    lines = table(s, d, "raw_pages").where("text is not null").select(F.explode(F.split("text", "\n")).alias("raw")).select(T.strip("raw").alias("line")).distinct().where("line <> ''")
    return lines.select("line", structure.heading_shape(F.col("line")).alias("shape"), structure.heading(F.col("line")).alias("heading"))


def _clean(x: str) -> str:
    return _strip(_collapse(f"regexp_replace({x}, '-\\n([a-z])', '\\1', 'g')"))


_TEXTUAL = f"""case when regexp_matches(line, '{structure.NUMBERED}') then case when not regexp_matches(title, '^(?i:fig|table|eq|plate)') and regexp_matches(title, '[\\p{{L}}\\p{{N}}]$') then no || ' ' || title end
 when regexp_matches(line, '{structure.UNNUMBERED}') then case when {_in('lower(line)', structure.SECTIONS)} then line when upper(line) = line and len({_words('line')}) between 2 and 6 then array_to_string(list_transform(regexp_extract_all(line, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '') end end"""
_SEGMENTS = f"""{_KEPT}, li as (select doc_id, page_number, unnest(range(len(lines))) as n, unnest(lines) as l from kept where lines is not null),
pl as (select doc_id, page_number, unnest(range(len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as t from kept where lines is null),
al as (select doc_id, page_number, n, l.text as text, l.size as size, coalesce(l.bold, false) as bold from li union all select doc_id, page_number, n, t, null, false from pl),
zs as (select doc_id, size, sum(length(text)) as c, min(page_number * 100000 + n) as f from al where size is not null and text is not null group by all),
body as (select doc_id, size as body from zs qualify row_number() over (partition by doc_id order by c desc, f) = 1),
ln as (select al.*, body, {_strip('text')} as line from al left join body using (doc_id) where length({_strip('text')}) >= 3),
lt as (select *, regexp_extract(line, '{structure.NUMBERED}', 1) as no, {_strip(f"regexp_extract(line, '{structure.NUMBERED}', 2)")} as title from ln),
lh as (select *, case when length(line) > 80 then null when coalesce(body > 0 and size > 0 and {_heading_shape('line')} and (size >= body * 1.08 or (bold and size >= body * 0.98)), false) then line else {_TEXTUAL} end as heading from lt),
ls as (select *, last_value(heading ignore nulls) over w as section, count(heading) over w as part from lh window w as (partition by doc_id order by page_number, n rows between unbounded preceding and current row)),
pr as (select doc_id, page_number, part, 0 as k, max(section) as section, false as is_table, {_clean("string_agg(text, chr(10) order by n)")} as text from ls group by doc_id, page_number, part),
lp as (select doc_id, page_number, arg_max(struct_pack(s := section), part * 100000 + n).s as section, max(part) as part from ls group by doc_id, page_number),
tn as (select doc_id, page_number, len(tables) as m, unnest(range(len(tables))) as k, unnest(tables) as t from kept where tables is not null),
tb as (select tn.doc_id, tn.page_number, coalesce(part, 1 << 30) as part, k + 1 as k, section, true as is_table, 'Table on page ' || tn.page_number || case when m > 1 then ' (' || (k + 1) || ')' else '' end || chr(10) || t as text from tn left join lp on lp.doc_id = tn.doc_id and lp.page_number = tn.page_number),
every as (select * from pr where text <> '' union all select * from tb)"""


@query(f"with {_SEGMENTS} select doc_id, (row_number() over (partition by doc_id order by page_number, is_table::int, part, k) - 1)::int as seg_no, page_number, coalesce(section, '') as section, is_table, text from every")
def d05_segments(s: SparkSession, d: str) -> DataFrame:
    """Segments of every scanned paper."""
    return structure.segments(structure.without_references(_pages(s, d))).withColumn("section", F.coalesce("section", F.lit("")))


_SEG = "seg as (select * from segments where doc_id is not null and seg_no is not null qualify row_number() over (partition by doc_id, seg_no order by ingested_at desc nulls last, text desc nulls last, section desc nulls last) = 1)"


def _segments(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "segments").where("doc_id is not null and seg_no is not null")
    return latest_by(rows, ["doc_id", "seg_no"], "ingested_at", ["text", "section"]).drop("ingested_at")


@query(f"""with {_SEG}, a as (select doc_id, seg_no, section, len({_words("coalesce(text, '')")}) as n, case when row_number() over w = 1 or section is distinct from lag(section) over w then 1 else 0 end as fresh from seg window w as (partition by doc_id order by seg_no)),
b as (select *, sum(fresh) over (partition by doc_id order by seg_no) as run from a), c as (select *, sum(n) over (partition by doc_id, run) as words from b),
k as (select *, max(case when words >= 40 then seg_no end) over (partition by doc_id order by seg_no) as kept from c)
select k.doc_id, k.seg_no, coalesce(s.section, '') as section from k left join seg s on s.doc_id = k.doc_id and s.seg_no = k.kept""")
def d06_merged_sections(s: SparkSession, d: str) -> DataFrame:
    """Sections after runs of too few words took the one before."""
    rows = _segments(s, d).withColumn("text", F.coalesce("text", F.lit("")))
    return structure.merge_small_sections(rows).select("doc_id", "seg_no", F.coalesce("section", F.lit("")).alias("section"))


_DIGITS = "length(regexp_replace(text, '[^\\p{Nd}]', '', 'g'))"


@query(f"""with {_P}, li as (select doc_id, page_number, unnest(range(len(lines))) as n, unnest(lines) as l from p where page_number <= 3 and lines is not null),
la as (select doc_id, page_number, n, {_strip('l.text')} as text, l.size as size, l.y as y, max(l.y) over (partition by doc_id, page_number) as height from li),
lb as (select * from la where text <> '' and size is not null and y <= 0.55 * height and length(text) <= 250 and {_legible('text')} and not {_in(_banner('text'), T.BANNERS + T.JOURNALS)} and not regexp_matches(text, '{structure.TITLE_NOISE}') and {_DIGITS} <= 0.2 * length(text)),
bg as (select * from lb qualify size >= 0.95 * max(size) over (partition by doc_id)),
ft as (select * from bg qualify row_number() over (partition by doc_id order by page_number, y, n) = 1),
sm as (select bg.*, ft.size as top from bg join ft using (doc_id) where bg.page_number = ft.page_number and abs(bg.size - ft.size) <= 0.5 and (bg.y > ft.y or bg.y = ft.y and bg.n >= ft.n)),
gp as (select *, coalesce(y - lag(y) over (partition by doc_id order by y, n) > 2.2 * top, false)::int as gap from sm),
ch as (select * from gp qualify sum(gap) over (partition by doc_id order by y, n rows between unbounded preceding and current row) = 0),
tt as (select doc_id, {_strip(_collapse("string_agg(text, ' ' order by y, n)"))} as title from ch group by doc_id)
select doc_id, title from tt where length(title) >= 10 and not {_in(_banner('title'), T.BANNERS + T.JOURNALS)} and {_plausible('title')}""")
def d08_d09_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles found by typography."""
    return structure.best_title(structure.title_lines(_pages(s, d)))


@query(f"""with {_SEG}, t as (select doc_id, seg_no, case when coalesce(is_table, false) then [text] else {_sentences('text')} end as t from seg where text is not null)
select doc_id, seg_no, len(t) as n_sentences, list_sum(list_transform(t, lambda x: len({_words('x')})))::bigint as n_words from t where len(t) > 0""")
def d10_flattened(s: SparkSession, d: str) -> DataFrame:
    """Sentences and words of every segment, tables whole."""
    return chunking.flatten(_segments(s, d)).groupBy("doc_id", "seg_no").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_words"))


_CHUNKS = f"""{_SEG}, st as (select doc_id, seg_no, page_number, section, coalesce(is_table, false) as is_table, unnest(range(len(t))) as sent_no, unnest(t) as text from (select *, case when coalesce(is_table, false) then [text] else {_sentences('text')} end as t from seg where text is not null)),
sn as (select *, len({_words('text')}) as n, row_number() over w as o, (is_table or coalesce(lag(is_table) over w, true) or section is distinct from lag(section) over w)::int as border from st window w as (partition by doc_id order by seg_no, sent_no)),
sr as (select *, sum(border) over (partition by doc_id order by o) as run from sn),
rn as (select doc_id, run, any_value(section) as section, bool_or(is_table) as is_table, list(text order by o) as ts, list(page_number order by o) as ps, list(n order by o) as ns, run = max(run) over (partition by doc_id) as last from sr group by doc_id, run),
ru as (select *, list_prepend(0, list_transform(range(1, len(ns) + 1), lambda k: list_sum(ns[1:k])::bigint)) as cum from rn),
walk as (
 select doc_id, run, 0::bigint as k, 0::bigint as a, case when is_table then 0 else list_filter(range(0, len(ns)), lambda j: cum[j + 2] >= 180)[1] end as b from ru
 union all
 select w.doc_id, w.run, w.k + 1, greatest(w.a, len(list_filter(cum, lambda c: c <= cum[w.b + 2] - 40)) - 1), list_filter(range(w.b + 1, len(ns)), lambda j: cum[j + 2] - cum[greatest(w.a, len(list_filter(cum, lambda c: c <= cum[w.b + 2] - 40)) - 1) + 1] >= 180)[1]
 from walk w join ru on ru.doc_id = w.doc_id and ru.run = w.run where w.b is not null and not ru.is_table),
cut as (select w.doc_id, w.run, w.k, w.a, coalesce(w.b, len(ns) - 1) as b, ts, ps, ns, section from walk w join ru on ru.doc_id = w.doc_id and ru.run = w.run where w.b is not null or w.a < len(ns) and cum[len(ns) + 1] - cum[w.a + 1] > case when last then 40 else 0 end)"""


@query(f"""with recursive {_CHUNKS}
select doc_id, (row_number() over (partition by doc_id order by run, k) - 1)::int as chunk_id, array_to_string(ts[a + 1:b + 1], ' ') as text, list_sum(ns[a + 1:b + 1])::int as word_count, list_min(ps[a + 1:b + 1]) as page_start, list_max(ps[a + 1:b + 1]) as page_end, coalesce(section, '') as section from cut""")
def d11_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of every paper's segments."""
    return chunking.chunk_segments(_segments(s, d)).withColumn("section", F.coalesce("section", F.lit("")))


# ---------------------------------------------------------------- lexical and dense search
@query(f"with {_CH}, {_QS}, {_bm25(1)} select doc_id, chunk_id, term, tf from post")
def a01_term_frequency(s: SparkSession, d: str) -> DataFrame:
    """Term frequencies of every chunk."""
    return lexical.postings(_chunks(s, d))


@query(f"with {_CH}, {_QS}, {_bm25(1)} select count(*) as n_chunks, sum(len(t))::bigint as n_tokens, round(avg(len(t)), 9) as mean_tokens, min(len(t)) as least, max(len(t)) as most from tk")
def a02_lengths(s: SparkSession, d: str) -> DataFrame:
    """Token lengths of the corpus."""
    return lexical.lengths(_chunks(s, d)).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.round(F.avg("n_tokens"), 9).alias("mean_tokens"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"))


@query(f"with {_CH}, {_QS}, {_bm25(1)} select term, df, round(idf, 9) as idf from wt")
def a03_a04_idf(s: SparkSession, d: str) -> DataFrame:
    """Document frequency and inverse document frequency of every term."""
    chunks = _chunks(s, d)
    return lexical.idf(lexical.postings(chunks), chunks).withColumn("idf", F.round("idf", 9))


_HIT = "query_id, doc_id, chunk_id, score, rank"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "chunk_id", "score", "rank")


@query(f"with {_CH}, {_QS}, {_bm25(10)} select {_HIT} from lx")
def a05_k02_bm25(s: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of every question by BM25."""
    return _hits(lexical.bm25(_chunks(s, d), _asked(s, d), 10))


@query(f"with {_CH}, {_QS}, {_bm25(5, scope='p.doc_id < ' + repr('8'))} select {_HIT} from lx")
def f01_scoped_bm25(s: SparkSession, d: str) -> DataFrame:
    """BM25 within a scope of papers, with statistics of the whole library."""
    chunks = _chunks(s, d)
    return _hits(lexical.bm25(chunks, _asked(s, d), 5, scope=chunks.where("doc_id < '8'").select("doc_id")))


@query("""with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 20 = 0), v as (select vec_id, embedding::double[] as e from embeddings),
s as (select query_id, vec_id, round(list_inner_product(q.e, v.e), 9) as score from q, v)
select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")
def k01_knn(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every query vector."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.knn(v, q, 10, key=["vec_id"]).select("query_id", "vec_id", "score", "rank")


@query("""with q as (select vec_id as query_id, label as want, embedding::double[] as e from embeddings where vec_id % 20 = 0), v as (select vec_id, label, embedding::double[] as e from embeddings),
s as (select query_id, want, vec_id, label, round(list_inner_product(q.e, v.e), 9) as score from q, v where q.query_id <> v.vec_id),
r as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5),
f as (select query_id, min(rank) filter (label = want) as first_rank, count(*) filter (label = want) as n_relevant from r group by query_id)
select count(*) as n_queries, round(avg((first_rank is not null)::int), 9) as hit_rate, round(avg(coalesce(1.0 / first_rank, 0)), 9) as mrr, round(avg(n_relevant / 5), 9) as precision from f""")
def a08_label_metrics(s: SparkSession, d: str) -> DataFrame:
    """Hit rate, MRR and precision of vector search by label, the query itself left out."""
    v = table(s, d, "embeddings").select("vec_id", "label", "embedding")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"), "embedding")
    hits = dense.knn(v, q, 6, key=["vec_id"]).where("query_id <> vec_id")
    hits = lexical.top(hits.drop("rank"), 5, ["vec_id"]).join(v.select("vec_id", "label"), "vec_id").join(q.select("query_id", "want"), "query_id").where("label = want")
    firsts = q.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n_relevant")), "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    m = evaluation.retrieval_metrics(firsts, 5)
    return m.select("n_queries", *[F.round(c, 9).alias(c) for c in ("hit_rate", "mrr", "precision")])


# ---------------------------------------------------------------- retrieval modes
_ARMS = f"{_CH}, {_QS}, {_bm25(30)}, {_dense(30)}"


@query(f"with {_CH}, {_QS}, {_dense(30)}, {_divers('dn', 5, '2')} select {_HIT} from fin")
def r01_r05_dense(s: SparkSession, d: str) -> DataFrame:
    """Mode dense with a quota of two."""
    return _hits(fusion.retrieve(_chunks(s, d), _asked(s, d), "dense", 5, 2))


@query(f"with {_CH}, {_QS}, {_bm25(30)}, {_divers('lx', 5, '2')} select {_HIT} from fin")
def r02_bm25(s: SparkSession, d: str) -> DataFrame:
    """Mode bm25 with a quota of two."""
    return _hits(fusion.retrieve(_chunks(s, d), _asked(s, d), "bm25", 5, 2))


@query(f"with {_ARMS}, {_fused(1_000_000, 1.0, 2.0)} select query_id, doc_id, chunk_id, round(fused, 9) as fused, best_rank, first_score, rank from fr")
def a06_a07_r07_fused(s: SparkSession, d: str) -> DataFrame:
    """Weighted fusion of both arms."""
    chunks, asked = _indexed(s, d), _asked(s, d)
    arms = [dense.knn(dense.vectors_of(chunks), asked.select("query_id", dense.embed("question").alias("embedding")), 30), lexical.bm25(chunks, asked, 30)]
    return fusion.fuse(arms, [1.0, 2.0]).select("query_id", "doc_id", "chunk_id", F.round("fused", 9).alias("fused"), "best_rank", "first_score", "rank")


@query(f"with {_ARMS}, {_fused(30)}, src as (select query_id, doc_id, chunk_id, fused as score, rank from fr), {_divers('src', 5, '3')} select {_HIT} from fin")
def r03_hybrid(s: SparkSession, d: str) -> DataFrame:
    """Mode hybrid with a quota of three."""
    return _hits(fusion.retrieve(_indexed(s, d), _asked(s, d), "hybrid", 5, 3))


_RERANKED = f"""rr as (select fr.query_id, fr.doc_id, fr.chunk_id, round(case when len(list_distinct({_tok('question')})) = 0 then 1.0 else len(list_intersect(list_distinct({_tok('question')}), {_tok('text')})) / len(list_distinct({_tok('question')})) end, 9) as score, fr.rank as before
 from fr join qs on qs.query_id = fr.query_id join ch on ch.doc_id = fr.doc_id and ch.chunk_id = fr.chunk_id), src as (select query_id, doc_id, chunk_id, score, row_number() over (partition by query_id order by score desc, before) as rank from rr)"""


@query(f"with {_ARMS}, {_fused(30)}, {_RERANKED}, {_divers('src', 5)} select {_HIT} from fin")
def r04_k04_reranked(s: SparkSession, d: str) -> DataFrame:
    """Mode hybrid+rerank with the stand-in scorer."""
    return _hits(fusion.retrieve(_indexed(s, d), _asked(s, d), "hybrid+rerank", 5))


_REL = "ch.text is not null and (q.paper is null or q.paper = '' or coalesce(contains(lower(t.title), lower(q.paper)), false)) and len(list_filter(coalesce(q.must_contain, []), lambda p: not contains(translate(lower(ch.text), '^_{}', ''), translate(lower(p), '^_{}', '')))) = 0"


def _firsts(source: str) -> str:
    return f"""rel as (select h.query_id, h.rank from {source} h join qs q on q.query_id = h.query_id join ch on ch.doc_id = h.doc_id and ch.chunk_id = h.chunk_id left join titles t on t.doc_id = h.doc_id where {_REL}),
fi as (select qs.query_id, min(rank) as first_rank, count(rank) as n_relevant from (select distinct query_id from qs) qs left join rel on rel.query_id = qs.query_id group by qs.query_id)"""


_METRICS = "count(*) as n_queries, round(avg((first_rank is not null)::int), 9) as hit_rate, round(avg(coalesce(1.0 / first_rank, 0)), 9) as mrr, round(avg(n_relevant / 5), 9) as precision"


@query(f"with {_ARMS}, {_TITLES}, {_divers('lx', 5)}, {_firsts('fin')} select {_METRICS} from fi")
def a08_w05_bm25_metrics(s: SparkSession, d: str) -> DataFrame:
    """Hit rate, MRR and precision of BM25 on the hand-written questions."""
    chunks, asked = _chunks(s, d), _asked(s, d)
    hits = fusion.retrieve(chunks, asked, "bm25", 5)
    m = evaluation.retrieval_metrics(evaluation.first_ranks(hits, asked, chunks, _titles(s, d)), 5)
    return m.select("n_queries", *[F.round(c, 9).alias(c) for c in ("hit_rate", "mrr", "precision")])


def _grid_sql() -> str:
    parts = []
    for n, (pool, w) in enumerate(_GRID):
        parts.append(f"select {n} as config_no, {pool} as pool, {w}::double as weight, * from (with ev as (select *, 1.0::double as w from dn where rank <= {pool} union all select *, {w}::double as w from lx where rank <= {pool}), fu as (select query_id, doc_id, chunk_id, round(sum(w / (60 + rank)), 12) as fused, min(rank) as best_rank from ev group by all), fr as (select *, row_number() over (partition by query_id order by fused desc, best_rank, doc_id, chunk_id) as rank from fu), fin as (select * from fr where rank <= 5), {_firsts('fin')} select {_METRICS} from fi)")
    return f"with {_CH}, {_QS}, {_TITLES}, {_bm25(30)}, {_dense(30)} " + " union all ".join(parts)


_GRID = [(10, 1.0), (10, 2.0), (30, 1.0), (30, 2.0)]


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """All configurations of pool and weight over the same two arms, in one plan."""
    chunks, asked = _indexed(s, d), _asked(s, d)
    arms = dense.knn(dense.vectors_of(chunks), asked.select("query_id", dense.embed("question").alias("embedding")), 30).withColumn("arm", F.lit(0))
    arms = arms.unionByName(lexical.bm25(chunks, asked, 30).withColumn("arm", F.lit(1)))
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("config_no"), F.lit(p).alias("pool"), F.lit(w).alias("weight")) for n, (p, w) in enumerate(_GRID)]))
    # One row a candidate with its rank in either arm, and, as rows stay with their question, one shuffle for all configurations.
    ranks = [F.min(F.when(F.col("arm") == n, F.col("rank"))).alias(r) for n, r in enumerate(("_near", "_met"))]
    rows = arms.repartition("query_id").groupBy("query_id", "doc_id", "chunk_id").agg(*ranks).withColumn("g", grid)
    near, met = [F.when(F.col(r) <= F.col("g.pool"), F.col(r)) for r in ("_near", "_met")]
    fused = F.round(F.coalesce(1.0 / (60 + near), F.lit(0.0)) + F.coalesce(F.col("g.weight") / (60 + met), F.lit(0.0)), 12)
    rows = rows.select("query_id", "doc_id", "chunk_id", "g", fused.alias("fused"), F.least(near, met).alias("best_rank")).where("best_rank is not null")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id", "g").orderBy(F.col("fused").desc(), "best_rank", "doc_id", "chunk_id"))
    hits = rows.withColumn("rank", place).where("rank <= 5").groupBy("query_id", "doc_id", "chunk_id").agg(F.collect_list(F.struct("g", "rank")).alias("at"))
    rel = evaluation.judged(hits, asked, chunks, _titles(s, d)).select("query_id", "relevant", F.explode("at").alias("at")).select("query_id", "at.*", "relevant")
    rel = rel.groupBy("g", "query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.count_if("relevant").alias("n_relevant"))
    every = asked.select("query_id").distinct().select("query_id", grid.alias("g"))
    firsts = every.join(rel, ["g", "query_id"], "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))).select("g.*", "first_rank", "n_relevant")
    return evaluation.retrieval_metrics(firsts, 5, ["config_no", "pool", "weight"])


@query(_grid_sql())
def r20_sweep(s: SparkSession, d: str) -> DataFrame:
    """Metrics of a grid of pools and weights."""
    return _sweep(s, d).select("config_no", "pool", "weight", "n_queries", *[F.round(c, 9).alias(c) for c in ("hit_rate", "mrr", "precision")])


@query(f"select config_no, pool, weight from ({_grid_sql()}) order by hit_rate desc, mrr desc, config_no limit 1")
def k06_best_config(s: SparkSession, d: str) -> DataFrame:
    """The best configuration of the grid."""
    return evaluation.best_config(_sweep(s, d)).select("config_no", "pool", "weight")


_MODELS = {"share": fusion.overlap_scorer, "count": lambda q, t: F.size(F.array_intersect(F.array_distinct(T.tokens(q)), T.tokens(t))).cast("double")}
_POOLS = [10, 30]


def _models_sql() -> str:
    q, t = f"list_distinct({_tok('question')})", _tok("text")
    score = {"share": f"case when len({q}) = 0 then 1.0 else len(list_intersect({q}, {t})) / len({q}) end", "count": f"len(list_intersect({q}, {t}))"}
    parts = [
        f"select '{m}' as model, {p} as pool, * from (with rr as (select fr.query_id, fr.doc_id, fr.chunk_id, row_number() over (partition by fr.query_id order by round({score[m]}, 9) desc, fr.rank) as rank from fr join qs on qs.query_id = fr.query_id join ch on ch.doc_id = fr.doc_id and ch.chunk_id = fr.chunk_id where fr.rank <= {p}), fin as (select * from rr where rank <= 5), {_firsts('fin')} select {_METRICS} from fi)"
        for m in _MODELS for p in _POOLS
    ]
    return f"with {_ARMS}, {_TITLES}, {_fused(30)} " + " union all ".join(parts)


@query(_models_sql())
def r20_r21_models(s: SparkSession, d: str) -> DataFrame:
    """Metrics of two re-rankers over two pools, all from one settled first stage."""
    chunks, asked = _indexed(s, d), _asked(s, d)
    return evaluation.model_sweep(fusion.first_stage(chunks, asked, 30), asked, chunks, _titles(s, d), _MODELS, _POOLS, 5).select("model", "pool", "n_queries", *[F.round(c, 9).alias(c) for c in ("hit_rate", "mrr", "precision")])


_LOG = """lg as (select answer_id, doc_id, chunk_id, rank, case when not isnan(score) then score end as score, logged_at from retrieved where answer_id is not null and doc_id is not null and chunk_id is not null),
l1 as (select * from lg qualify row_number() over (partition by answer_id, doc_id, chunk_id order by logged_at desc nulls last, score desc nulls last, rank desc nulls last) = 1),
an as (select * from answers where answer_id is not null qualify row_number() over (partition by answer_id order by answered_at desc nulls last, max_per_document desc nulls last, question desc nulls last) = 1)"""


def _log(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "retrieved").where("answer_id is not null and doc_id is not null and chunk_id is not null").withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    return latest_by(rows, ["answer_id", "doc_id", "chunk_id"], "logged_at", ["score", "rank"])


def _given(s: SparkSession, d: str) -> DataFrame:
    return latest_by(table(s, d, "answers").where("answer_id is not null"), ["answer_id"], "answered_at", ["max_per_document", "question"])


@query(f"""with {_LOG}, src as (select l.answer_id as query_id, l.doc_id, l.chunk_id, l.score, a.max_per_document as m, row_number() over (partition by l.answer_id order by l.score desc nulls last, l.doc_id, l.chunk_id) as rank from l1 l join an a using (answer_id)),
{_divers('src', 5, 'm')} select query_id, doc_id, chunk_id, rank from fin""")
def w02_quota(s: SparkSession, d: str) -> DataFrame:
    """The five passages of every logged answer under its quota, overflow filling up."""
    from pyspark.sql import Window

    rows = _log(s, d).join(_given(s, d).select("answer_id", "max_per_document"), "answer_id").withColumnRenamed("answer_id", "query_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "doc_id", "chunk_id")))
    return fusion.diversify(rows.select("query_id", "doc_id", "chunk_id", "max_per_document", "rank"), 5, F.col("max_per_document")).select("query_id", "doc_id", "chunk_id", "rank")


@query(f"with {_LOG}, n as (select answer_id, count(distinct doc_id) as n from l1 group by answer_id) select an.answer_id, coalesce(case when max_per_document is null and n > 1 and regexp_matches(coalesce(question, ''), '{T.COMPARATIVE}') then 2 else max_per_document end, 0)::int as quota from an join n using (answer_id)")
def r09_auto_quota(s: SparkSession, d: str) -> DataFrame:
    """The quota of every answer, set for comparative questions; 0 for none."""
    n = _log(s, d).groupBy("answer_id").agg(F.countDistinct("doc_id").alias("n"))
    rows = _given(s, d).select("answer_id", "question", "max_per_document").join(n, "answer_id")
    return rows.select("answer_id", F.coalesce(fusion.auto_quota(F.col("question"), F.col("max_per_document"), F.col("n"), 5), F.lit(0)).cast("int").alias("quota"))


@query(f"""with {_LOG}, c as (select doc_id, chunk_id, text, page_start, page_end, section from chunks where doc_id is not null qualify row_number() over (partition by doc_id, chunk_id order by text desc nulls last) = 1), {_TITLES},
r as (select answer_id, doc_id, chunk_id, row_number() over (partition by answer_id order by score desc nulls last, doc_id, chunk_id) as place from l1),
e as (select r.answer_id, place, '[Excerpt ' || place || '] (' || {_CITE} || ')' || chr(10) || coalesce(c.text, '') as block from r join c on c.doc_id = r.doc_id and c.chunk_id = r.chunk_id left join titles t on t.doc_id = r.doc_id where place <= 5)
select e.answer_id, count(*) as n_excerpts, md5('Context excerpts:' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by place) || chr(10) || chr(10) || 'Question: ' || coalesce(max(question), '')) as digest from e join an using (answer_id) group by e.answer_id""")
def r14_a18_prompts(s: SparkSession, d: str) -> DataFrame:
    """The prompt of every answer: its five best passages, labelled, and the question."""
    from pyspark.sql import Window

    from lectern.plans.ask import context_of

    best = _log(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("answer_id").orderBy(F.col("score").desc_nulls_last(), "doc_id", "chunk_id"))).where("rank <= 5")
    texts = table(s, d, "chunks").where("doc_id is not null").groupBy("doc_id", "chunk_id").agg(F.max_by(F.struct("text", "page_start", "page_end", "section"), F.struct(F.col("text").isNotNull(), "text")).alias("c")).select("doc_id", "chunk_id", "c.*")
    context = context_of(best.select(F.col("answer_id").alias("query_id"), "doc_id", "chunk_id", "rank"), texts, _titles(s, d))
    rows = context.withColumnRenamed("query_id", "answer_id").join(_given(s, d).select("answer_id", "question"), "answer_id")
    return rows.select("answer_id", "n_excerpts", F.md5(F.concat(F.lit("Context excerpts:\n\n"), "context", F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")))).alias("digest"))


_BEST = f"""{_LOG}, c as (select doc_id, chunk_id, text, page_start, page_end, section from chunks where doc_id is not null qualify row_number() over (partition by doc_id, chunk_id order by text desc nulls last) = 1), {_TITLES},
w as (select r.answer_id as query_id, place as excerpt, r.doc_id, t.title, {_CITE} as citation, c.page_start, c.page_end, c.section, r.score, c.text from (select *, row_number() over (partition by answer_id order by score desc nulls last, doc_id, chunk_id) as place from l1) r join c on c.doc_id = r.doc_id and c.chunk_id = r.chunk_id left join titles t on t.doc_id = r.doc_id where place <= 5)"""


def _wired(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from lectern.plans.ask import wire

    best = _log(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("answer_id").orderBy(F.col("score").desc_nulls_last(), "doc_id", "chunk_id"))).where("rank <= 5").withColumnRenamed("answer_id", "query_id")
    texts = table(s, d, "chunks").where("doc_id is not null").groupBy("doc_id", "chunk_id").agg(F.max_by(F.struct("text", "page_start", "page_end", "section"), F.struct(F.col("text").isNotNull(), "text")).alias("c")).select("doc_id", "chunk_id", "c.*")
    return wire(best, texts, _titles(s, d))


@query(f"with {_BEST} select * exclude (text, title, section, score), coalesce(title, '') as title, coalesce(section, '') as section, coalesce(score, 0) as score, md5(coalesce(text, '')) as digest from w")
def f08_wire_rows(s: SparkSession, d: str) -> DataFrame:
    """What a service sends for the five best passages of every logged answer."""
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "section")}
    return _wired(s, d).withColumns({**blank, "score": F.coalesce("score", F.lit(0.0)), "digest": F.md5(F.coalesce("text", F.lit("")))}).drop("text")


@query(f"with {_BEST} select query_id, excerpt, md5('<details open><summary><b>[Excerpt ' || excerpt || ']</b> ' || citation || ' <i>score ' || printf('%.3f', round(coalesce(score, 0), 6) + 1e-9) || '</i></summary>' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '</details>') as digest from w")
def t27_source_blocks(s: SparkSession, d: str) -> DataFrame:
    """The passages of every logged answer as collapsible blocks; scores are nudged off ties, which engines round differently."""
    score = F.round(F.coalesce("score", F.lit(0.0)), 6) + 1e-9
    return _wired(s, d).select("query_id", "excerpt", F.md5(T.source_block(F.col("excerpt"), F.col("citation"), score, F.coalesce("text", F.lit("")))).alias("digest"))


@query("""with b as (select distinct id as query_id, paper, case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'validation', 'dev') then 'val' when lower(trim(split)) = 'test' then 'test' end as split from benchmark where id is not null)
select query_id from b where split = 'val' and (contains(lower(coalesce(paper, '')), 'layer') or contains(lower(coalesce(paper, '')), 'role of')) order by query_id limit 50""")
def f04_picked_queries(s: SparkSession, d: str) -> DataFrame:
    """The first fifty validation questions about papers whose name holds one of two phrases."""
    b = table(s, d, "benchmark").where("id is not null").select(F.col("id").alias("query_id"), "paper", _split_name(F.col("split")).alias("split")).distinct().where("split is not null")
    return evaluation.pick_queries(b, "val", ["layer", "role OF"], limit=50).select("query_id")


# ---------------------------------------------------------------- joins, sets, counts, samples, conversations
@query(f"""with {_QS}, {_CH}, {_TITLES}, hit as (select distinct q.query_id, ch.doc_id, ch.chunk_id from qs q, ch left join titles t on t.doc_id = ch.doc_id where {_REL})
select q.query_id, count(hit.chunk_id) as n_chunks, count(hit.chunk_id) = 0 as unanswerable from (select distinct query_id from qs) q left join hit on hit.query_id = q.query_id group by q.query_id""")
def r19_j06_f05_answerable(s: SparkSession, d: str) -> DataFrame:
    """How many chunks, of all papers whose title holds the one that is named, answer each question."""
    return evaluation.answerable(_asked(s, d), _chunks(s, d), _titles(s, d))


@query(f"with {_TITLES} select c.doc_id, coalesce(t.title, 'unknown document') as title, c.n_chunks from (select doc_id, count(distinct chunk_id) as n_chunks from chunks where doc_id is not null group by doc_id) c left join titles t on t.doc_id = c.doc_id")
def j05_s11_library(s: SparkSession, d: str) -> DataFrame:
    """The library: every paper with its title and chunks."""
    n = table(s, d, "chunks").where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return n.join(_titles(s, d), "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("unknown document")).alias("title"), "n_chunks")


@query("select distinct doc_id from benchmark where doc_id is not null except select doc_id from corpus_queries")
def j09_x03_papers_not_asked(s: SparkSession, d: str) -> DataFrame:
    """Papers of the benchmark without a hand-written question."""
    a = table(s, d, "benchmark").where("doc_id is not null").select("doc_id").distinct()
    return a.join(table(s, d, "corpus_queries").select("doc_id").distinct(), "doc_id", "left_anti")


@query("select distinct lower(trim(doc_id)) as doc_id from retrieved where doc_id is not null except select doc_id from raw_pages")
def j10_unknown_ids(s: SparkSession, d: str) -> DataFrame:
    """Retrieved papers of which no scan is known."""
    a = table(s, d, "retrieved").where("doc_id is not null").select(F.lower(F.trim("doc_id")).alias("doc_id")).distinct()
    return a.join(table(s, d, "raw_pages").select("doc_id").distinct(), "doc_id", "left_anti")


@query(f"with {_CH} select doc_id, count(*) as n_chunks from ch where doc_id not in (select doc_id from corpus_queries where doc_id is not null) group by doc_id")
def j12_s10_deleted(s: SparkSession, d: str) -> DataFrame:
    """The library after the papers that have questions are deleted."""
    gone = table(s, d, "corpus_queries").select("doc_id").distinct()
    return _chunks(s, d).join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


_SPLIT = "case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'validation', 'dev') then 'val' when lower(trim(split)) = 'test' then 'test' end"


@query(f"""with b as (select distinct id, coalesce(left(doc_id, 1), '-') as cluster, {_SPLIT} as split from benchmark where id is not null), c as (select coalesce(cluster, 'TOTAL') as cluster, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test, count(*) as total from b group by rollup (cluster)) select * from c""")
def a12_a14_split_counts(s: SparkSession, d: str) -> DataFrame:
    """Benchmark questions by split and cluster of papers, with the total."""
    b = table(s, d, "benchmark").where("id is not null").select("id", F.coalesce(F.left("doc_id", F.lit(1)), F.lit("-")).alias("cluster"), _split_name(F.col("split")).alias("split")).distinct()
    return evaluation.split_table(b)


_FRAGMENTS = [("atmosphere", "train", "haze layer"), ("atmosphere", "test", "Measuring jet speed with"), ("atmosphere", "val", "no such paper"), ("retrieval", "train", "How the query rewriter sets the"), ("retrieval", "val", "On the batch size of")]


@query(f"""with f as (select * from (values {', '.join(str(x) for x in _FRAGMENTS)}) v(cluster, split, fragment)), t as (select distinct paper as title from benchmark where paper is not null),
p as (select cluster, split, fragment, title, coalesce(lower(trim(title)) = lower(trim(fragment)), false) as exact from f left join t on contains(lower(trim(title)), lower(trim(fragment)))),
b as (select *, bool_or(exact) over (partition by cluster, split, fragment) as any_exact from p),
o as (select cluster, split, fragment, count(title) as n_titles, min(title) as title from b where exact or not any_exact group by all)
select cluster, split, fragment, n_titles, coalesce(title, '') as title, coalesce(case when n_titles = 0 then 'no match' when n_titles > 1 then 'several matches' when (select count(distinct split) from o o2 where o2.title = o.title and o2.n_titles = 1) > 1 then 'two splits' end, '') as problem from o""")
def j07_r23_splits(s: SparkSession, d: str) -> DataFrame:
    """Which titles the fragments of a split specification name."""
    f = s.createDataFrame(_FRAGMENTS, "cluster string, split string, fragment string")
    t = table(s, d, "benchmark").where("paper is not null").select(F.col("paper").alias("title"))
    return evaluation.resolve_splits(f, t).select("cluster", "split", "fragment", "n_titles", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("problem", F.lit("")).alias("problem"))


_BQ = "bq as (select distinct id as query_id, question, doc_id, source_chunk from benchmark where id is not null and doc_id is not null)"


@query(f"with {_CH}, {_BQ}, {_bm25(10, 'bq')}, n as (select l.* from lx l where not exists (select 1 from bq where bq.query_id = l.query_id and bq.doc_id = l.doc_id and bq.source_chunk = l.chunk_id)) select query_id, doc_id, chunk_id, place from (select *, row_number() over (partition by query_id order by rank) as place from n) where place <= 3")
def j11_hard_negatives(s: SparkSession, d: str) -> DataFrame:
    """Three hard negatives of every benchmark question."""
    b = table(s, d, "benchmark").where("id is not null and doc_id is not null").select(F.col("id").alias("query_id"), "question", "doc_id", F.col("source_chunk").alias("chunk_id")).distinct()
    return evaluation.hard_negatives(lexical.bm25(_chunks(s, d), b.select("query_id", "question"), 10), b, 3).select("query_id", "doc_id", "chunk_id", "place")


@query(f"""with {_CH}, {_BQ}, {_bm25(1, 'bq')}, c as (select bq.query_id as id, p.term, round(idf, 9) as idf from bq join post p on p.doc_id = bq.doc_id and p.chunk_id = bq.source_chunk join wt using (term)
 where df >= 2 and regexp_matches(p.term, '^[a-z0-9][a-z0-9.\\-]{{2,19}}$') and regexp_matches(p.term, '[a-z]') and not list_contains({_tok('bq.question')}, p.term))
select id, term, place from (select *, row_number() over (partition by id order by idf desc, term) as place from c) where place <= 2""")
def k05_evidence(s: SparkSession, d: str) -> DataFrame:
    """Two evidence terms of every benchmark question's chunk."""
    b = table(s, d, "benchmark").where("id is not null and doc_id is not null").select("id", "question", "doc_id", F.col("source_chunk").alias("chunk_id")).distinct()
    return lexical.evidence(_chunks(s, d), b)


@query(f"with {_CH} select doc_id, chunk_id from (select doc_id, chunk_id, row_number() over (partition by doc_id order by md5('7|' || doc_id || '|' || chunk_id), doc_id, chunk_id) as place from ch where len({_words('text')}) >= 60) where place <= 2")
def k07_f03_sample(s: SparkSession, d: str) -> DataFrame:
    """Two chunks of 60 words or more of every paper, by seeded hash."""
    rows = _chunks(s, d).where(F.size(T.words("text")) >= 60)
    return evaluation.sample_by(rows, ["doc_id"], ["doc_id", "chunk_id"], 2).select("doc_id", "chunk_id")


@query("""with b as (select distinct id, lexical_overlap <= 0.45 as positive from benchmark where id is not null and lexical_overlap is not null), n as (select 3 * count(*) filter (positive) as most from b)
select id, positive from (select id, positive, row_number() over (partition by positive order by md5('7|' || id), id) as place from b), n where positive or place <= most""")
def k08_negative_ratio(s: SparkSession, d: str) -> DataFrame:
    """All questions of low overlap, and at most three times as many others, by seeded hash."""
    b = table(s, d, "benchmark").where("id is not null and lexical_overlap is not null").select("id", (F.col("lexical_overlap") <= 0.45).alias("positive")).distinct()
    return evaluation.balanced(b, "positive", ["id"])


@query(f"with {_CH} select count(*) as n_chunks, min(n) as least, max(n) as most, round(avg(n), 9) as mean from (select len({_words('text')}) as n from ch where text is not null)")
def a15_chunk_words(s: SparkSession, d: str) -> DataFrame:
    """Words of the chunks."""
    n = _chunks(s, d).where("text is not null").select(F.size(T.words("text")).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"))


@query("select doc_id, min(page_start) as first_page, max(page_end) as last_page, min(chunk_id) as first_chunk, count(distinct section) as n_sections from chunks where doc_id is not null group by doc_id")
def a16_a17_page_ranges(s: SparkSession, d: str) -> DataFrame:
    """Pages, first chunk and sections of every paper."""
    return table(s, d, "chunks").where("doc_id is not null").groupBy("doc_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.min("chunk_id").alias("first_chunk"), F.countDistinct("section").alias("n_sections"))


_TURNS = "tn as (select * from turns where turn_id is not null and conv_id is not null qualify row_number() over (partition by turn_id order by asked_at desc nulls last, answer desc nulls last) = 1)"


def _turns(s: SparkSession, d: str) -> DataFrame:
    return latest_by(table(s, d, "turns").where("turn_id is not null and conv_id is not null"), ["turn_id"], "asked_at", ["answer"])


@query(f"with {_TURNS}, l as (select * from tn qualify row_number() over (partition by conv_id order by turn desc) <= 2) select conv_id, md5(string_agg('Q: ' || coalesce(question, '') || chr(10) || 'A: ' || left(coalesce(answer, ''), 300), chr(10) order by turn)) as digest from l group by conv_id")
def w04_transcripts(s: SparkSession, d: str) -> DataFrame:
    """The last two turns of every conversation as a transcript."""
    return conversation.transcripts(_turns(s, d)).select("conv_id", F.md5("transcript").alias("digest"))


@query(f"""with {_TURNS}, l as (select * from tn qualify row_number() over (partition by conv_id order by turn desc) <= 3), m as (select conv_id, turn, 0 as k, 'user' as role, question as content from l union all select conv_id, turn, 1, 'assistant', left(coalesce(answer, ''), 600) from l)
select conv_id, row_number() over (partition by conv_id order by turn, k) as place, role, md5(coalesce(content, '')) as digest from m""")
def w04_messages(s: SparkSession, d: str) -> DataFrame:
    """The last three turns of every conversation as messages."""
    return conversation.messages(_turns(s, d)).select("conv_id", "place", "role", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


@query(f"with {_TURNS}, h as (select *, row_number() over (partition by conv_id order by turn) > 1 as has_history from tn) select turn_id, has_history and not (not regexp_matches({_strip(chr(99)+'oalesce(question, ' + chr(39)*2 + ')')}, '{T.DEPENDENT}') and not regexp_matches({_strip(chr(99)+'oalesce(question, ' + chr(39)*2 + ')')}, '{T.REFERRING.replace(chr(39), chr(39)*2)}') and len({_words(chr(99)+'oalesce(question, ' + chr(39)*2 + ')')}) >= 5) as needs_rewrite from h")
def r15_rewrite_gate(s: SparkSession, d: str) -> DataFrame:
    """Which turns need a rewrite: those with history that do not stand alone."""
    from pyspark.sql import Window

    rows = _turns(s, d).withColumn("has_history", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) > 1)
    return rows.select("turn_id", (F.col("has_history") & ~T.looks_self_contained("question")).alias("needs_rewrite"))


@query(f"""with {_A}, n as (select coalesce(n_sources, 0) as n, list_transform(regexp_extract_all(coalesce(text, ''), '{T.CITATION}', 1), lambda x: x::int) as c from a), k as (select n, c, list_filter(c, lambda x: x >= 1 and x <= n) as v from n)
select round(avg(case when len(c) > 0 then len(v) / len(c) end), 9) as mean_validity, round(avg(case when n > 0 then len(list_distinct(v)) / n end), 9) as mean_utilisation, sum(len(c))::bigint as n_citations from k""")
def a11_r17_report(s: SparkSession, d: str) -> DataFrame:
    """Means of the citation ratios over all answers, those that do not apply left out."""
    rows = t20_a10_citation_counts(s, d)
    return rows.agg(F.round(F.avg("validity"), 9).alias("mean_validity"), F.round(F.avg("utilisation"), 9).alias("mean_utilisation"), F.sum("total").alias("n_citations"))
