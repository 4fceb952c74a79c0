"""Documents that arrive in a folder, into chunk and posting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import chunking, lexical
from lectern.operators.ranking import latest_by

ARRIVALS = "doc_id string, seg_no int, text string, page_number int, section string, is_table boolean, ingested_at timestamp"


def ingest(spark: SparkSession, arrivals: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads segments (Parquet) as they arrive, keeps them all by batch, and writes chunks and postings of the papers of a batch anew.

    A paper is rebuilt whole, from the latest row of each (doc_id, seg_no) over all batches so far, so its segments may come in any
    number of deliveries, again, and at any age. Each micro-batch writes under its own id, so a batch that is run again after a
    failure replaces what it had written; readers take the latest batch of each paper. Rows without key drop out. A target or
    checkpoint written without a table of segments cannot be continued: begin with new folders."""
    stream = spark.readStream.schema(ARRIVALS).parquet(arrivals)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.where("doc_id is not null and seg_no is not null").write.mode("overwrite").parquet(f"{target}/segments/batch={number}")
        rows = _segments(own, target).where(F.col("batch") <= number)
        touched = rows.where(F.col("batch") == number).select("doc_id").distinct()
        rows = rows.drop("batch").join(touched, "doc_id", "left_semi")
        rows = latest_by(rows, ["doc_id", "seg_no"], "ingested_at", ["text", "section", "page_number", "is_table"])
        chunking.chunk_segments(rows.drop("ingested_at")).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        made = own.read.parquet(f"{target}/chunks/batch={number}")
        lexical.postings(made).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _segments(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{ARRIVALS}, batch long").parquet(f"{target}/segments")


def _current(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of each paper's latest batch; none if the paper has no text left in it."""
    last = _segments(spark, target).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/{name}").join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of the latest batch of each paper."""
    return _current(spark, target, "chunks")


def current_postings(spark: SparkSession, target: str) -> DataFrame:
    """The postings of the chunks of ``current_chunks``."""
    return _current(spark, target, "postings")
