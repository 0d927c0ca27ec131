"""File kinds, lists of files, output names, and one reader for all sequence inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fastx import read_fasta, read_fastq
from .gfa import read_gfa

EXTENSIONS = {"gfa": ".gfa", "fasta": ".fasta", "graph": ".graph", "colors": ".colors", "tsv": ".tsv"}


def sniff(spark: SparkSession, path: str) -> str:
    """'fasta', 'fastq', 'gfa', 'graph' (a folder written by store.write) or 'unknown', by the first line."""
    try:
        first = spark.read.text(path).limit(1).collect()
    except AnalysisException:  # a folder without files of its own
        first = []
    line = first[0]["value"] if first else ""
    if line.startswith(">"):
        return "fasta"
    if line.startswith("@"):
        return "fastq"
    if line.startswith("H\tVN:Z:"):
        return "gfa"
    try:
        return "graph" if {"k", "g", "version"} <= set(spark.read.parquet(f"{path}/meta").columns) else "unknown"
    except AnalysisException:  # no such folder
        return "unknown"


def expand(spark: SparkSession, path: str) -> list[str]:
    """The path itself, or the paths listed in it, one a line, if it is no sequence file."""
    if sniff(spark, path) != "unknown":
        return [path]
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]  # a list of files


def output_name(prefix: str, kind: str, gzip: bool = False) -> str:
    end = EXTENSIONS[kind] + (".gz" if gzip and kind in ("gfa", "fasta") else "")
    return prefix if prefix.endswith(end) else prefix + end


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file_id, file_name, name, seq, qual`` of FASTA, FASTQ and GFA files together, file_id in the order given."""
    out = None
    for i, path in enumerate(paths):
        kind = sniff(spark, path)
        if kind == "gfa":
            rows = read_gfa(spark, path)[0].select(F.col("id").alias("name"), "seq", F.lit(None).cast("string").alias("qual"))
        elif kind in ("fasta", "fastq"):
            rows = {"fasta": read_fasta, "fastq": read_fastq}[kind](spark, path).select("name", "seq", "qual")
        else:
            raise ValueError(f"{path}: neither FASTA, FASTQ nor GFA")
        rows = rows.select(F.lit(i).alias("file_id"), F.lit(path).alias("file_name"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_tsv(result: DataFrame, path: str) -> None:
    """A result matrix as tab-separated text with a header, one part file a partition."""
    result.write.option("sep", "\t").option("header", True).csv(path)
