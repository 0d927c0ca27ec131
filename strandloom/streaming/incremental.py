"""Graphs that grow from a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.kmers import kmers


def stream_counts(records: DataFrame, k: int, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each batch's k-mer counts as ``folder/batch=N``; a batch that is run again overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        counts = kmers(batch, k).groupBy("kmer").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_so_far(spark: SparkSession, folder: str, min_count: int = 1) -> DataFrame:
    """``kmer, n`` over all batches written; the count filter holds over the whole stream."""
    out = spark.read.parquet(folder).groupBy("kmer").agg(F.sum("n").alias("n"))
    return out.where(F.col("n") >= min_count) if min_count > 1 else out
