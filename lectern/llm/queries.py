"""The queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import capping, cutoff, encoding, leakage, lookalikes, overlap, pairs, scans, splitting
from lectern.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks that the cap of their answer leaves out."""
    return capping.capped_hits(table(spark, d, "retrieved"), table(spark, d, "answers")).where(~F.col("stays")).select("answer_id", "doc_id", "chunk_id")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks that stay in the answers that have a cap."""
    return capping.capped_hits(table(spark, d, "retrieved"), table(spark, d, "answers")).where(F.col("stays")).select("answer_id", "doc_id", "chunk_id")


def p1_capped_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents under nested caps: at most 40 of a source in a language, then at most a twentieth of all rows of a source; the longest stay."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), F.length("text").cast("double").alias("size"))
    levels = [capping.Level(("source", "lang"), cap=40), capping.Level(("source",), share=0.05)]
    return capping.cap_nested(docs, levels, "size", ["doc_id"]).select("doc_id", "source", "lang", F.coalesce("cut_at", F.lit(0)).alias("cut_at"))


def p1_nested_caps(spark: SparkSession, d: str) -> DataFrame:
    """Documents under three nested caps that are shares: at most half of a source's rows in a language, then a tenth of its organisation's
    rows of a source, then two fifths of all rows of an organisation; the longest stay. Sources of one half of the alphabet stand for an organisation."""
    source = F.coalesce("source", F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", F.when(source < "m", "a").otherwise("m").alias("org"), source.alias("source"), F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), F.length("text").cast("double").alias("size"))
    levels = [capping.Level(("org", "source", "lang"), share=0.5), capping.Level(("org", "source"), share=0.1), capping.Level(("org",), share=0.4)]
    return capping.cap_nested(docs, levels, "size", ["doc_id"]).select("doc_id", "org", "source", "lang", F.coalesce("cut_at", F.lit(0)).alias("cut_at"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(splitting.long_items(table(spark, d, "segments"), table(spark, d, "chunks")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the splitter had to cut: those with a second piece."""
    return _long(spark, d).where("piece_no = 2").select("item_kind", "doc_id", "item_no")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every item beyond the limit, with the item's section."""
    return _long(spark, d).withColumn("section", F.coalesce("section", F.lit("")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Phrases that a reader sees in a chunk of their paper though the stored characters differ."""
    return lookalikes.phrase_hits(table(spark, d, "corpus_queries"), table(spark, d, "chunks")).where(~F.col("stored")).drop("stored")


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk text in the consistent form."""
    chunks = table(spark, d, "chunks").select("doc_id", "chunk_id", "text").where("text is not null and doc_id is not null and chunk_id is not null")
    return lookalikes.canonical_texts(chunks).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned pages that carry noise, with its kind."""
    return scans.page_noise(table(spark, d, "raw_pages"))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of every scanned paper."""
    return scans.paragraphs(table(spark, d, "raw_pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Question and answer pairs that are unfit for use, with the defect."""
    model = pairs.fit_language_model(table(spark, d, "documents"))
    return pairs.defects(pairs.answer_records(table(spark, d, "turns"), table(spark, d, "answers")), model)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training question and an evaluation question that ask the same about the same paper."""
    pairs_ = overlap.overlaps(table(spark, d, "benchmark"), table(spark, d, "corpus_queries"))
    return pairs_.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).where("id_a < id_b").distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and paper, how many records training holds too, and their pairs."""
    return overlap.overlap_counts(table(spark, d, "benchmark"), table(spark, d, "corpus_queries"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encoding.encode_corpus(table(spark, d, "documents").where("doc_id is not null"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the held-out items of which they hold a passage."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "heldout"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Where each document and item have their longest verbatim match, in words."""
    return leakage.passages(table(spark, d, "documents"), table(spark, d, "heldout"))


def p8_leaked(spark: SparkSession, d: str) -> DataFrame:
    """The held-out items that leaked, with the number of documents."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left when those with a held-out passage are removed."""
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "heldout")).select("doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were cut before their end."""
    return cutoff.endings(table(spark, d, "documents")).where("is_cut").select("doc_id").distinct()


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut documents per source."""
    return cutoff.cut_share(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_kept, p1_capped_sources, p1_nested_caps, p2_found, p2_pieces, p3_found, p3_canonical, p4_found, p4_paragraphs, p5_found, p6_found, p6_counts, p7_ids, p8_found, p8_passages, p8_leaked, p8_clean, p9_found, p9_share)
}

_HITS = """
with hit as (
  select answer_id, lower(trim(doc_id)) as doc_id, chunk_id, case when not isnan(score) then score end as score, rank, logged_at
  from retrieved where answer_id is not null and doc_id is not null and chunk_id is not null),
last as (
  select * from hit qualify row_number() over (partition by answer_id, doc_id, chunk_id order by logged_at desc nulls last, score desc nulls last, rank) = 1),
cap as (
  select answer_id, max_per_document from answers
  qualify row_number() over (partition by answer_id order by answered_at desc nulls last, max_per_document desc nulls last) = 1),
placed as (
  select l.answer_id, l.doc_id, l.chunk_id, c.max_per_document as m,
    row_number() over (partition by l.answer_id, l.doc_id order by l.score desc nulls last, l.chunk_id) as place
  from last l join cap c on l.answer_id = c.answer_id where c.max_per_document >= 1)
"""

SQL: dict[str, str] = {
    "p1_found": _HITS + "select answer_id, doc_id, chunk_id from placed where place > m",
    "p1_kept": _HITS + "select answer_id, doc_id, chunk_id from placed where place <= m",
    "p1_capped_sources": """
with doc as (
  select doc_id, coalesce(source, '') as source, lower(coalesce(lang, '')) as lang, length(text)::double as size from documents),
inner_ as (
  select *, row_number() over (partition by source, lang order by size desc nulls last, doc_id) as a from doc),
outer_ as (
  select *, row_number() over (partition by source, a > 40 order by size desc nulls last, doc_id) as b from inner_)
select doc_id, source, lang, (case when a > 40 then 1 when b > (select greatest(1, floor(count(*) * 0.05)) from doc) then 2 else 0 end)::int as cut_at from outer_
""",
    "p1_nested_caps": """
with doc as (
  select doc_id, case when coalesce(source, '') < 'm' then 'a' else 'm' end as org, coalesce(source, '') as source, lower(coalesce(lang, '')) as lang, length(text)::double as size from documents),
one as (
  select *, row_number() over (partition by org, source, lang order by size desc nulls last, doc_id) > greatest(1, floor(count(*) over (partition by org, source) * 0.5)) as cut1, count(*) over (partition by org) as n_org from doc),
two as (
  select *, not cut1 and row_number() over (partition by org, source, cut1 order by size desc nulls last, doc_id) > greatest(1, floor(n_org * 0.1)) as cut2 from one),
three as (
  select *, not cut1 and not cut2 and row_number() over (partition by org, cut1, cut2 order by size desc nulls last, doc_id) > greatest(1, floor((select count(*) from doc) * 0.4)) as cut3 from two)
select doc_id, org, source, lang, (case when cut1 then 1 when cut2 then 2 when cut3 then 3 else 0 end)::int as cut_at from three
""",
    "p2_found": """
with seg as (
  select * from segments where doc_id is not null and seg_no is not null
  qualify row_number() over (partition by doc_id, seg_no order by ingested_at desc nulls last, length(text) desc nulls last) = 1),
long_ as (
  select distinct 'segment' as item_kind, doc_id, seg_no as item_no from seg where length(text) > 1600
  union all
  select distinct 'chunk', doc_id, chunk_id from chunks where length(text) > 1600 and doc_id is not null and chunk_id is not null)
select item_kind, doc_id, item_no::int as item_no from long_
""",
}
