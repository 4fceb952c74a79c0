"""Sources and sinks: documents through a parser, JSON query files, JSON-lines training examples, evaluation reports."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.structure import pages_of_layout

PAGES = "doc_id string, page_number int, text string, lines array<struct<text:string,size:double,bold:boolean,y:double>>, tables array<string>"
LAYOUT = "page_number int, blocks array<struct<lines:array<struct<spans:array<struct<text:string,size:double,flags:int,y:double>>,x0:double,y0:double,x1:double,y1:double>>>>, grids array<struct<x0:double,y0:double,x1:double,y1:double,rows:array<array<string>>>>"
TRUE = ("1", "true", "yes", "on")


def toggle(name: str, spark: SparkSession | None = None) -> bool:
    """A feature switch from the session setting ``lectern.<name>``, else the environment variable NAME; off unless 1, true, yes or on."""
    value = spark.conf.get(f"lectern.{name}", None) if spark is not None else None
    return (value if value is not None else os.environ.get(name.upper(), "")).strip().lower() in TRUE


def text_parser(content: bytes) -> Iterable[dict]:
    """Pages of a plain-text document, parted by form feeds, without typography."""
    for n, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield {"page_number": n, "text": page, "lines": None, "tables": []}


def read_documents(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[dict]] = text_parser, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of the documents under a path. A parser gives page dictionaries; one that fails, or gives no text, rejects its document.

    The page's doc_id is the first 12 hex digits of the MD5 of the content, so the same file has the same id. A parser of another
    format (PDF with typography and tables, say) takes the place of ``text_parser``; it runs in the tasks, a document at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.substring(F.md5("content"), 1, 12).alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, doc_id, content in zip(batch["path"], batch["doc_id"], batch["content"]):
                try:
                    pages, error = [dict(p) for p in parser(content)], None
                    if not any((p.get("text") or "").strip() for p in pages):
                        pages, error = [], "no text could be extracted"
                except Exception as e:
                    pages, error = [], f"{type(e).__name__}: {e}"
                rows = [{"path": name, "doc_id": doc_id, "page_number": p["page_number"], "text": p.get("text"), "lines": p.get("lines"), "tables": p.get("tables") or [], "error": None} for p in pages]
                if error is not None:
                    rows = [{"path": name, "doc_id": doc_id, "page_number": None, "text": None, "lines": None, "tables": None, "error": error}]
                yield pd.DataFrame(rows)

    parsed = files.mapInPandas(run, f"path string, {PAGES}, error string")
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("path", "doc_id", "error")


def read_layouts(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[dict]], pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(pages, names) of the documents under a path through a parser of layout: it gives dictionaries of page_number, blocks and grids, as
    ``pages_of_layout`` reads them, and title, that of the file's metadata.

    The switches ``enable_table_extraction`` and ``enable_script_markers`` turn grids and marks on. ``names`` is (doc_id, path, title) for
    ``index_pages``. A document that the parser fails on has no rows; pages come a row each, so a long document is held by no task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.substring(F.md5("content"), 1, 12).alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, doc_id, content in zip(batch["path"], batch["doc_id"], batch["content"]):
                try:
                    for p in parser(content):
                        yield pd.DataFrame([{"path": name, "doc_id": doc_id, "title": p.get("title"), "page_number": p["page_number"], "blocks": p.get("blocks") or [], "grids": p.get("grids") or []}])
                except Exception:
                    continue

    parsed = files.mapInPandas(run, f"path string, doc_id string, title string, {LAYOUT}")
    pages = pages_of_layout(parsed, toggle("enable_table_extraction", spark), toggle("enable_script_markers", spark))
    return pages, parsed.groupBy("doc_id").agg(F.min("path").alias("path"), F.max("title").alias("title"))


def read_originals(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, path, content) of the files under a path, for the library to keep; a file that lies there twice is one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.substring(F.md5("content"), 1, 12).alias("doc_id"), "path", "content")
    return files.dropDuplicates(["doc_id"])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries of a JSON file {"queries": [...]}."""
    schema = "queries array<struct<id:string,paper:string,question:string,must_contain:array<string>,type:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")


def read_split_spec(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, split, fragment) of a JSON file cluster -> split -> [title fragments]."""
    spec = F.from_json("value", "map<string,map<string,array<string>>>")
    whole = spark.read.text(path, wholetext=True).select(F.explode(spec).alias("cluster", "splits"))
    return whole.select("cluster", F.explode("splits").alias("split", "f")).select("cluster", "split", F.explode("f").alias("fragment"))


def write_examples(examples: DataFrame, path: str) -> None:
    """Training examples as JSON lines."""
    examples.write.mode("overwrite").json(path)


def write_split_record(splits: DataFrame, path: str, source: str = "") -> None:
    """Beside training examples: which papers of (doc_id, split) they are drawn from, and which are held out, as one JSON row."""
    train = F.coalesce(F.col("split") == "train", F.lit(False))
    row = splits.agg(F.array_sort(F.collect_set(F.when(train, F.col("doc_id")))).alias("train"), F.array_sort(F.collect_set(F.when(~train, F.col("doc_id")))).alias("held_out"), F.lit(source).alias("source"))
    row.write.mode("overwrite").json(path)


def write_report(per_question: DataFrame, summary: DataFrame, path: str) -> None:
    """An evaluation report: {"summary": ..., "per_question": ...} as two JSON folders below the path."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_question.write.mode("overwrite").json(f"{path}/per_question")
