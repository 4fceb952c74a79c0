"""The request rules of a thin service around the engine: what is refused, and how, before any job runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lectern.operators.fusion import MODES

LEAST_K, MOST_K = 1, 20


class Refused(Exception):
    """A request that is turned down, with its HTTP status."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


@dataclass(frozen=True)
class Ask:
    """One question to the library. ``doc_ids`` of None is the whole library, an empty list nothing."""

    question: str
    mode: str = "hybrid+rerank"
    top_k: int = 5
    max_per_document: int | None = None
    doc_ids: list[str] | None = None
    history: list[tuple[str, str]] = field(default_factory=list)


def check(ask: Ask, documents: DataFrame) -> Ask:
    """The request as it stands, or Refused: 422 for values out of range or an unknown mode, 409 for an empty library, 404 for unknown documents."""
    if len(ask.question) < 1:
        raise Refused(422, "the question is empty")
    if ask.mode not in MODES:
        raise Refused(422, f"unknown mode {ask.mode!r}")
    if not LEAST_K <= ask.top_k <= MOST_K:
        raise Refused(422, f"top_k must be {LEAST_K} to {MOST_K}")
    if ask.max_per_document is not None and ask.max_per_document < 1:
        raise Refused(422, "max_per_document must be 1 or more")
    if documents.isEmpty():
        raise Refused(409, "the library is empty")
    if ask.doc_ids:
        wanted = documents.sparkSession.createDataFrame([(d,) for d in ask.doc_ids], "doc_id string")
        unknown = [r.doc_id for r in wanted.join(documents.select("doc_id"), "doc_id", "left_anti").collect()]
        if unknown:
            raise Refused(404, f"unknown documents: {', '.join(sorted(unknown))}")
    return ask


def check_upload(filename: str) -> str:
    """415 for what is no PDF."""
    if not filename.lower().endswith(".pdf"):
        raise Refused(415, "only PDF files are read")
    return filename


def chosen_scope(selected: list[str], visible: list[str], everything: list[str]) -> list[str] | None:
    """The scope of a selection in a filtered list: what is both selected and visible, None for the whole library."""
    both = [d for d in selected if d in set(visible)]
    return None if set(both) == set(everything) else both
