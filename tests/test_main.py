from pyspark.sql import functions as F

from lectern.__main__ import main
from lectern.sources.store import Library


def test_list_shows_every_document(spark, tmp_path, capsys):
    ids = spark.range(1001).select(F.format_string("d%04d", "id").alias("doc_id"))
    documents = ids.select("doc_id", F.lit("T").alias("title"), F.lit("f").alias("filename"), F.lit(1).alias("n_pages"), F.lit(1).alias("n_chunks"), F.current_timestamp().alias("added_at"))
    chunks = ids.select(F.lit(0).alias("chunk_id"), F.lit("x").alias("text"), F.lit(1).alias("word_count"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("S").alias("section"), F.array(F.lit(1.0).cast("double")).alias("embedding"), "doc_id")
    Library(spark, str(tmp_path)).save(documents, chunks)
    assert main(["list", str(tmp_path)]) == 0
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines() if x.startswith("d0") or x.startswith("d1")] == [f"d{i:04d}" for i in range(1001)]
