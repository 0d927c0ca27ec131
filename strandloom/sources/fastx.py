"""FASTA and FASTQ scans and sinks on Spark's own text reader: any store, split files, gzip by extension.

Records: ``file_name, name, comment, seq, qual``; order within files is kept by no column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.stage import materialize, ship


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records start at '>' on a line of its own; sequence lines are joined."""
    chunks = spark.read.text(paths, lineSep="\n>").select(F.col("_metadata.file_path").alias("file_name"), F.regexp_replace("value", r"^\s*>", "").alias("v"))
    head = F.regexp_extract("v", r"\A([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("v", r"\A[^\r\n]*", ""), r"\s", "")
    rows = chunks.where(F.trim("v") != "").select("file_name", head.alias("h"), body.alias("seq"))
    return rows.select("file_name", F.substring_index("h", " ", 1).alias("name"), F.trim(F.regexp_replace("h", r"^\S*", "")).alias("comment"), "seq", F.lit(None).cast("string").alias("qual"))


def parse_fastq(file: str, lines: Iterable[str]) -> Iterator[tuple[str, str, str]]:
    """``head, seq, qual`` of a file's lines: bases up to '+', then qualities until they are as many; blank lines between records are passed."""
    head, seq, qual, size = None, [], [], -1  # size: bases of the record whose qualities are read, else -1
    for line in lines:
        if size < 0 and head is None:
            if not line.strip():
                continue
            if not line.startswith("@"):
                raise ValueError(f"{file}: a record begins with {line[:40]!r}, not with '@'")
            head, seq, qual = line[1:], [], []
        elif size < 0:
            if line.startswith("+"):
                size = sum(map(len, seq))
            else:
                seq.append(line.strip())
        else:
            qual.append(line)
        if size >= 0 and (got := sum(map(len, qual))) >= size:
            if got > size:
                raise ValueError(f"{file}: {head[:40]!r} has {size} bases and more qualities")
            yield head, "".join(seq), "".join(qual)
            head, size = None, -1
    if head is not None:
        raise ValueError(f"{file}: the last record, {head[:40]!r}, is not whole")


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of any number of lines; what can't be parsed raises. Files of plain four-line records are read in parts, others one a task."""
    ship(spark)
    raw = spark.read.text(paths, lineSep="\n@")
    rows = raw.select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value")
    lines = F.split(F.regexp_replace(F.regexp_replace("value", r"\A@", ""), r"\r?\n\z", ""), r"\r?\n")
    # If every part of a file is a whole record, each starts where the one before has ended.
    size, third = F.length(F.get("l", F.lit(1))), F.get("l", F.lit(2))
    whole = (F.size("l") == 4) & (size > 0) & (size == F.length(F.get("l", F.lit(3)))) & third.startswith("+") & ~F.get("l", F.lit(1)).rlike(r"^\+|\s")
    parts = rows.withColumn("l", lines)
    begins = F.min(F.struct("row", F.col("value").startswith("@").alias("marked")))["marked"]
    sound = parts.groupBy("file_name", "at").agg(F.min(F.coalesce(whole, F.lit(False))).alias("all"), begins.alias("marked"))
    # A row for each file that is not plain: broadcast, so that no text is shuffled to find them.
    odd = F.broadcast(materialize(sound.where(~F.col("all") | (F.col("at") == 0) & ~F.col("marked")).select("file_name").distinct(), "odd-files"))
    plain = parts.join(odd, "file_name", "left_anti").select("file_name", F.get("l", F.lit(0)).alias("head"), F.get("l", F.lit(1)).alias("seq"), F.get("l", F.lit(3)).alias("qual"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import groupby

        def records() -> Iterator[tuple[str, str]]:
            for f in frames:
                yield from zip(f["file_name"], f["value"])

        def lines_of(parts: Iterable[tuple[str, str]]) -> Iterator[str]:
            for n, (_, value) in enumerate(parts):
                for line in (("@" if n else "") + value).removesuffix("\n").split("\n"):
                    yield line.removesuffix("\r")

        for file, parts in groupby(records(), key=lambda x: x[0]):
            block = []
            for r in parse_fastq(file, lines_of(parts)):
                block.append((file, *r))
                if len(block) == 1000:
                    yield pd.DataFrame(block, columns=["file_name", "head", "seq", "qual"])
                    block = []
            yield pd.DataFrame(block, columns=["file_name", "head", "seq", "qual"])

    ordered = rows.join(odd, "file_name", "left_semi").repartition("file_name").sortWithinPartitions("file_name", "at", "row")
    parsed = ordered.select("file_name", "value").mapInPandas(run, "file_name string, head string, seq string, qual string")
    out = plain.union(parsed)
    return out.select("file_name", F.substring_index("head", " ", 1).alias("name"), F.trim(F.regexp_replace("head", r"^\S*", "")).alias("comment"), "seq", "qual")


def fasta_lines(unitigs: DataFrame, number_col: str = "number") -> DataFrame:
    """``number, value``: one record a unitig, its number as the name."""
    return unitigs.select(number_col, F.concat(F.lit(">"), F.col(number_col).cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def write_fasta(unitigs: DataFrame, path: str, number_col: str = "number", gzip: bool = True) -> None:
    lines = fasta_lines(unitigs, number_col).repartitionByRange(number_col).sortWithinPartitions(number_col)
    lines.select("value").write.option("compression", "gzip" if gzip else "none").text(path)
