"""Sentence-respecting overlapping chunks with page and section provenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ranking import carried
from lectern.operators.structure import SEGMENTS
from lectern.runtime import settle


def parted(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_no, page_number, section, is_table, parts array<string>): the sentences of every segment that has any; tables stay whole."""
    table = F.coalesce("is_table", F.lit(False))
    parts = F.when(table, F.array(F.col("text"))).otherwise(T.sentences("text"))
    return segments.where("text is not null").select("doc_id", "seg_no", "page_number", "section", table.alias("is_table"), parts.alias("parts")).where("size(parts) > 0")


def flatten(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_no, sent_no, page_number, section, is_table, text, n): a row a sentence; tables stay whole."""
    rows = parted(segments).select("doc_id", "seg_no", "page_number", "section", "is_table", F.posexplode("parts").alias("sent_no", "text"))
    return rows.withColumn("n", F.size(T.words("text")))


def cut(counts: list[int], last: bool, target: int, overlap: int) -> list[tuple[int, int]]:
    """First and last sentence of each chunk of one run of sentences."""
    total = np.concatenate(([0], np.cumsum(counts)))
    out, start, seed = [], 0, -1
    for i in range(len(counts)):
        if total[i + 1] - total[start] >= target:
            out.append((start, i))
            # the shortest tail with enough words, at most the whole chunk
            start = max(start, int(np.searchsorted(total, total[i + 1] - overlap, "right")) - 1)
            seed = i
    if start < len(counts) and total[-1] - total[start] > (overlap if last else 0):
        out.append((start, len(counts) - 1))
    return out


def chunk_segments(segments: DataFrame, target_words: int = 180, overlap_words: int = 40) -> DataFrame:
    """(doc_id, chunk_id, text, word_count, page_start, page_end, section): greedy chunks of whole sentences.

    A chunk closes at ``target_words``; the next begins with the last sentences of ``overlap_words``. A change of section (NULL is a
    section) or a table closes it too, at whatever size, and a table is a chunk of its own; the rest at a paper's end counts only
    beyond the overlap. Between two such borders sentences form a run, and runs are chunked independently, so no task holds more
    than a run: only word counts go to Python, texts stay in the JVM. Chunks are numbered from 0 in reading order."""
    rows = settle(parted(segments))
    # a run begins with a segment; what is ordered along a paper is its segments' sections, without any text
    block, order = F.floor(F.col("seg_no") / SEGMENTS), ["seg_no"]
    steps = carried(rows.select("doc_id", "seg_no", "is_table", "section"), ["doc_id"], block, order, before={"before": F.struct("is_table", "section")})
    border = F.col("is_table") | F.coalesce("before.is_table", F.lit(True)) | ~F.col("section").eqNullSafe(F.col("before.section"))
    steps = carried(steps.select("doc_id", "seg_no", border.cast("int").alias("border")), ["doc_id"], block, order, sums={"run": F.col("border")}).select("doc_id", "seg_no", "run")
    parts = F.transform("parts", lambda t: F.struct(F.size(T.words(t)).alias("n"), F.col("page_number").alias("page_number"), t.alias("text")))
    runs = rows.join(steps, ["doc_id", "seg_no"]).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("seg_no", parts.alias("parts")))).alias("segs"), F.first("section").alias("section"), F.first("is_table").alias("is_table"))
    runs = runs.join(steps.groupBy("doc_id").agg(F.max("run").alias("last_run")), "doc_id")
    runs = runs.select("doc_id", "run", F.flatten(F.transform("segs", lambda x: x.parts)).alias("s"), "section", "is_table", (F.col("run") == F.col("last_run")).alias("last"))

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def ranges(counts: pd.Series, last: pd.Series, table: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in ([(0, 0)] if t else cut(list(c), bool(z), target_words, overlap_words))] for c, z, t in zip(counts, last, table)])

    made = runs.select("doc_id", "run", "section", "s", F.posexplode(ranges(F.transform("s", lambda x: x.n), "last", "is_table")).alias("k", "r"))
    part = F.slice("s", F.col("r.a") + 1, F.col("r.b") - F.col("r.a") + 1)
    made = carried(made, ["doc_id"], F.floor(F.col("run") / SEGMENTS), ["run", "k"], sums={"number": F.lit(1)})
    return made.select(
        "doc_id",
        (F.col("number") - 1).cast("int").alias("chunk_id"),
        F.array_join(F.transform(part, lambda x: x.text), " ").alias("text"),
        F.aggregate(F.transform(part, lambda x: x.n), F.lit(0), lambda a, x: a + x).alias("word_count"),
        F.array_min(F.transform(part, lambda x: x.page_number)).alias("page_start"),
        F.array_max(F.transform(part, lambda x: x.page_number)).alias("page_end"),
        "section",
    )
