"""The index path: pages to segments to chunks to vectors, and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, dense, structure


def index_pages(pages: DataFrame, names: DataFrame | None = None, target_words: int = 180, overlap_words: int = 40, embedder=dense.embed) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) for ``Library.add`` of pages (doc_id, page_number, text, lines, tables).

    References are cut, sections found and merged, sentences chunked, tokenised for the lexical index and embedded. The title is that of
    the file's metadata (``names``: doc_id, path, title if there is one) if it is usable, else found by typography, else made
    of the file's name. Papers without any chunk have no row."""
    segs = structure.merge_small_sections(structure.segments(structure.without_references(pages)))
    chunks = chunking.chunk_segments(segs, target_words, overlap_words).withColumn("tokens", T.tokens("text")).withColumn("embedding", embedder("text"))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    docs = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages")).join(counts, "doc_id").join(structure.best_title(structure.title_lines(pages)), "doc_id", "left")
    if names is not None:
        given = F.max(T.metadata_title("title")) if "title" in names.columns else F.lit(None).cast("string")
        docs = docs.join(names.groupBy("doc_id").agg(F.min(F.element_at(F.split("path", "/"), -1)).alias("filename"), given.alias("given")), "doc_id", "left")
    else:
        docs = docs.withColumn("filename", F.concat("doc_id", F.lit(".pdf"))).withColumn("given", F.lit(None).cast("string"))
    title = F.coalesce("given", "title", T.filename_title("filename"))
    return docs.select("doc_id", title.alias("title"), "filename", "n_pages", "n_chunks", F.current_timestamp().alias("added_at")), chunks
