import datetime

from lectern.operators.chunking import chunk_segments
from lectern.operators.ranking import latest_by
from lectern.streaming.ingest import ARRIVALS, current_chunks, current_postings, ingest


def test_stream_keeps_papers_of_several_deliveries_whole(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = lambda month, day=1: datetime.datetime(2024, month, day)
    row = lambda doc, seg, word, t: (doc, seg, f"The {word} is fast here. " * 10, 1, f"S{seg}", False, t)
    batches = [
        [row("a", 0, "jet", at(6)), row("b", 0, "old", at(6)), row("b", 0, "new", at(7)), row("c", 0, "gone", at(6)), row("d", 0, "still", at(6))],
        [row("a", 1, "late", at(1)), row("b", 0, "older", at(5)), ("c", 0, None, 1, None, False, at(8)), row(None, 0, "x", at(6))],  # far behind the first
        [row("a", 0, "jet", at(6)), row("a", 1, "fixed", at(2))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, out, cp).awaitTermination()
    whole = latest_by(spark.read.schema(ARRIVALS).parquet(src).where("doc_id is not null"), ["doc_id", "seg_no"], "ingested_at", ["text"]).drop("ingested_at")
    got, want = (sorted(map(tuple, x.select("doc_id", "chunk_id", "text").collect())) for x in (current_chunks(spark, out), chunk_segments(whole)))
    assert got == want and [x[0] for x in got] == ["a", "a", "b", "d"] and "fixed" in got[1][2] and "new" in got[2][2]
    assert {(r.doc_id, r.term) for r in current_postings(spark, out).where("term in ('jet', 'late', 'fixed', 'old', 'new', 'gone', 'still')").collect()} == {("a", "jet"), ("a", "fixed"), ("b", "new"), ("d", "still")}
