"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read lazily so that columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only in a single process (master ``local``) is a folder of our own chosen where the setting is absent; elsewhere executors would
    write to disks of their own and a table read back would be a part of itself, so that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not there:
        there = getattr(spark, "_lectern_dir", None)
        if not there:
            there = spark._lectern_dir = "file://" + tempfile.mkdtemp(prefix="lectern-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(there)
    return there


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into a table in the shared folder and returns that table, its lineage cut.

    A table that is written is computed once, where ``checkpoint()`` computes its rows twice, and outlives lost executors.
    The tables go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not hasattr(spark, "_lectern_tables"):
        spark._lectern_tables = []
        atexit.register(_drop, spark, spark._lectern_tables)
    spark._lectern_tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, paths: list[str]) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; the cluster's folder is cleaned by its owner
        pass
