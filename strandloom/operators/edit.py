"""Editing a graph is set algebra on its k-mers; colors follow by k-mer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compact_local import unitig_kmers
from .kmers import distinct_kmers


def union(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("kmer")
    for t in tables[1:]:
        out = out.unionByName(t.select("kmer"))
    return out.distinct()


def add_sequences(kmers: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """All k-mers of the sequences join the graph, whatever their count."""
    return union(kmers, distinct_kmers(records, k))


def remove_sequences(kmers: DataFrame, records: DataFrame, k: int) -> DataFrame:
    return kmers.join(distinct_kmers(records, k), "kmer", "left_anti")


def remove_unitigs(unitigs: DataFrame, unitig_ids: DataFrame, k: int) -> DataFrame:
    """The k-mers that stay; ``unitig_ids(unitig_id)``: these whole unitigs leave the graph."""
    return unitig_kmers(unitigs.join(unitig_ids.select("unitig_id"), "unitig_id", "left_anti"), k).select("kmer")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """An extension: k-mers of both graphs."""
    return a.select("kmer").join(b.select("kmer"), "kmer", "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """An extension: k-mers of the first graph only."""
    return a.select("kmer").join(b.select("kmer"), "kmer", "left_anti")


def difference_size(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """``only_a, only_b``: rows of one table only. Two graphs are equal exactly if both are 0."""
    on = on or ["kmer"]
    sides = a.select(*on).distinct().withColumn("s", F.lit(1)).unionByName(b.select(*on).distinct().withColumn("s", F.lit(2)))
    seen = sides.groupBy(*on).agg(F.sum("s").alias("s"))
    return seen.agg(F.coalesce(F.sum((F.col("s") == 1).cast("long")), F.lit(0)).alias("only_a"), F.coalesce(F.sum((F.col("s") == 2).cast("long")), F.lit(0)).alias("only_b"))


def checksum(kmers: DataFrame) -> DataFrame:
    """``checksum``: the same for the same k-mers in any order."""
    return kmers.select(F.xxhash64("kmer").alias("h")).agg(F.bit_xor("h").alias("checksum"))


def merge_colors(first: DataFrame, second: DataFrame, n_first: int) -> DataFrame:
    """``kmer, color_id``: colors of the second graph are appended, numbered from n_first; names are not compared."""
    moved = second.select("kmer", (F.col("color_id") + n_first).cast("int").alias("color_id"))
    return first.select("kmer", "color_id").unionByName(moved).distinct()
