"""Graphs as columns: k-mers, unitigs, index and colors as Parquet, bucketed by range of k-mer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write(path: str, k: int, g: int, unitigs: DataFrame, index: DataFrame, colors: DataFrame | None = None, names: DataFrame | None = None) -> None:
    """Index rows lie sorted by k-mer, so a look-up reads the row groups its k-mers are in."""
    spark = unitigs.sparkSession
    unitigs.write.parquet(f"{path}/unitigs")
    index.repartitionByRange("kmer").sortWithinPartitions("kmer").write.parquet(f"{path}/index")
    if colors is not None:
        colors.repartitionByRange("kmer").sortWithinPartitions("kmer").write.parquet(f"{path}/colors")
    if names is not None:
        names.write.parquet(f"{path}/names")
    # Last, so that a folder with meta is whole.
    spark.range(1).select(F.lit(k).alias("k"), F.lit(g).alias("g"), F.lit(colors is not None).alias("colored"), F.lit(VERSION).alias("version")).write.parquet(f"{path}/meta")


def read(spark: SparkSession, path: str) -> dict:
    meta = spark.read.parquet(f"{path}/meta").collect()[0]
    if meta["version"] != VERSION:
        raise ValueError(f"{path}: version {meta['version']} is not known")
    out = {"k": meta["k"], "g": meta["g"], "unitigs": spark.read.parquet(f"{path}/unitigs"), "index": spark.read.parquet(f"{path}/index"), "colors": None, "names": None}
    if meta["colored"]:
        out["colors"] = spark.read.parquet(f"{path}/colors")
        try:
            out["names"] = spark.read.parquet(f"{path}/names")
        except AnalysisException:  # written without names
            out["names"] = None
    return out
