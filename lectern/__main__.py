"""python -m lectern list|add|remove|ask FOLDER [...]: a library from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lectern.functions import text as T
from lectern.plans import ask as asking
from lectern.plans.index import index_pages
from lectern.sources.readers import read_documents, read_originals
from lectern.sources.store import Library


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lectern", description=__doc__)
    p.add_argument("command", choices=["list", "add", "remove", "ask"])
    p.add_argument("folder")
    p.add_argument("what", nargs="?", help="files to add, a document id, or a question")
    p.add_argument("--mode", default="hybrid+rerank")
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--quota", type=int, help="most passages a paper")
    p.add_argument("--titled", help="only papers whose title holds this")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    library = Library(spark, a.folder)
    documents, chunks = library.load()
    if a.command == "list":
        print(*documents.columns, sep="\t")
        for row in documents.orderBy("doc_id").toLocalIterator():
            print(*row, sep="\t")
    elif a.command == "add":
        pages, rejects = read_documents(spark, a.what)
        documents, chunks = index_pages(pages.drop("path"), pages.select("doc_id", "path"))
        files = read_originals(spark, a.what).join(documents.select("doc_id"), "doc_id", "left_semi")
        library.add(documents, chunks, files)
        rejects.show(truncate=False)
    elif a.command == "remove":
        return 0 if library.remove(a.what) else 1
    else:
        questions = spark.createDataFrame([(1, a.what)], "query_id int, question string")
        scope = documents.where(T.in_scope("title", a.titled)).select("doc_id") if a.titled else None
        asking.ask(questions, chunks, documents.select("doc_id", "title"), a.mode, a.k, a.quota, scope=scope).select("context").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
