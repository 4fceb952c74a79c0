"""Problem 2: cutting long items at natural boundaries, with an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strengths of a cut after a character, weakest first.
NOWHERE, INSIDE, BLANK, WORD, CLAUSE, SENTENCE, ROW, PARAGRAPH = range(8)

_BLANKS = re.compile(r"\s+")
_CLAUSE = re.compile(r"[,;:][)\]\"'’”»]*(?=\s)")
_SENTENCE = re.compile(r"[.!?…][)\]\"'’”»]*(?=\s+[^\sa-z]|\s*$)|[。！？][」』）]*")
_NOT_SENTENCE = re.compile(r"(?:\b(?:al|cf|vs|Fig|Figs|Eq|Eqs|Sec|Ref|Refs|No|Dr|Prof|approx)\.|\b[a-z]\.[a-z]\.|\b[A-Z]\.)$")
_JOINED = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff\ufe00-\ufe0f\u200d]")

#: Positions that one index spans; a longer text is indexed piece by piece.
BLOCK = 1 << 17


def boundary_strengths(text: str) -> np.ndarray:
    """The strength of a cut before each offset 0..len(text)."""
    at = np.full(len(text) + 1, INSIDE, np.int8)
    for pattern, strength in ((_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE)):
        for m in pattern.finditer(text):
            if strength != SENTENCE or not _NOT_SENTENCE.search(text, max(0, m.end() - 12), m.end()):
                at[m.end()] = strength
    for m in _BLANKS.finditer(text):
        a, b = m.span()
        if b - a > 1:
            at[a + 1 : b] = BLANK
        rows = text.count("\n", a, b)
        end = PARAGRAPH if rows > 1 else ROW if rows else WORD
        if at[a] < end:
            at[a] = end
    for m in _JOINED.finditer(text):
        at[m.start()] = NOWHERE
        if m.group() == "\u200d":
            at[m.end()] = NOWHERE
    return at


class RangeMax:
    """Sparse table over boundary strengths: the strongest offset of a range in two look-ups, the rightmost of equals."""

    def __init__(self, strengths: np.ndarray, widest: int):
        self.shift = 1 << 28
        row = strengths.astype(np.int32) * 0x8000000 + np.arange(len(strengths), dtype=np.int32)
        self.rows = [row]
        step = 1
        while 2 * step <= min(widest, len(row)):
            row = np.maximum(row[:-step], row[step:])
            self.rows.append(row)
            step *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, offset) over lo..hi, both inclusive."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.rows[level]
        key = int(max(row[lo], row[hi - (1 << level) + 1]))
        return key >> 27, key & 0x7FFFFFF


def cut_points(text: str, limit: int = 1600, overlap: tuple[int, int] = (100, 200), least: int = 800) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: at most ``limit`` characters each, ending at the strongest
    boundary between ``least`` and ``limit``, below ``least`` only if there is none at all; each next piece
    starts ``overlap`` characters before the end of the last, at the strongest boundary there. A text within the
    limit is one piece; an empty text is one empty piece."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    near, far = overlap
    if not 0 <= near <= far < least <= limit:
        raise ValueError("overlap must be below least, least at most limit")
    strengths = boundary_strengths(text)
    pieces, start, base, index = [], 0, 0, None
    while n - start > limit:
        if index is None or start + limit >= base + BLOCK:
            base = start
            index = RangeMax(strengths[base : base + BLOCK + 1], limit + 1)
        strength, end = index.best(start + least - base, start + limit - base)
        if strength <= INSIDE:
            lower = index.best(start + far + 1 - base, start + least - 1 - base)
            if lower[0] > strength:
                strength, end = lower
        pieces.append((start, base + end))
        _, start = index.best(end - far, end - near)
        start += base
    pieces.append((start, n))
    return pieces


def split_items(items: DataFrame, limit: int = 1600, overlap: tuple[int, int] = (100, 200), least: int = 800) -> DataFrame:
    """``items`` with a string ``text`` becomes one row per piece: its other columns, ``piece_no`` from 1,
    ``piece_start`` and ``piece_end`` (offsets in code points) and ``piece``.

    Narrow: no shuffle, one Arrow pass, memory of one text at a time. Whole texts, whatever their length. NULL
    texts give no row, empty ones one empty piece; white space counts and belongs to the pieces. Columns of those four
    names that are there already are replaced."""
    items = items.drop("piece_no", "piece_start", "piece_end", "piece")
    keep = [c for c in items.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields if f.name != "text"]
    schema = ", ".join([*fields, "piece_no int", "piece_start int", "piece_end int", "piece string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            where, rows = [], []
            for i, text in enumerate(batch["text"]):
                if text is not None:
                    for k, (a, b) in enumerate(cut_points(text, limit, overlap, least), 1):
                        where.append(i)
                        rows.append((k, a, b, text[a:b]))
            out = batch[keep].iloc[where].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["piece_no", "piece_start", "piece_end", "piece"])], axis=1)

    return items.mapInPandas(run, schema)


def long_items(segments: DataFrame, chunks: DataFrame, limit: int = 1600) -> DataFrame:
    """(item_kind, doc_id, item_no, section, text) of the segments and chunks beyond ``limit``, once a key.

    Of a segment delivered more than once the latest counts, so short rows take part too, but only the text of
    long ones travels: the shuffle carries keys and long texts. Rows without key drop out."""
    size = F.length("text")
    body = F.struct(F.when(size > limit, F.col("text")).alias("text"), F.when(size > limit, F.col("section")).alias("section"))

    def once(df: DataFrame, kind: str, no: str, order) -> DataFrame:
        rows = df.where(F.col("doc_id").isNotNull() & F.col(no).isNotNull())
        best = rows.groupBy("doc_id", F.col(no).alias("item_no")).agg(F.max_by(body, order).alias("b"))
        return best.where("b.text is not null").select(F.lit(kind).alias("item_kind"), "doc_id", F.col("item_no").cast("int").alias("item_no"), "b.section", "b.text")

    seg = once(segments, "segment", "seg_no", F.struct(F.col("ingested_at"), size))
    return seg.unionByName(once(chunks, "chunk", "chunk_id", F.struct(size, F.xxhash64("text"))))
