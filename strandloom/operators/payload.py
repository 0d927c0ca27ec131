"""User data on k-mers and unitigs.

Data live on canonical k-mers and are merged by aggregate expressions, so joining, splitting and merging of
unitigs need no hooks: the data of any piece are the merged data of its k-mers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Payload:
    """``name``: the column; ``merge``: aggregate of it over k-mers, associative; ``zero``: value where there are none; ``text``: how it is written as a tag."""

    name: str
    merge: Column
    zero: object = None
    text: Column | None = None


def merge_data(kmer_data: list[DataFrame], payload: Payload) -> DataFrame:
    """``kmer, name``: data of several graphs brought together."""
    rows = kmer_data[0].select("kmer", payload.name)
    for t in kmer_data[1:]:
        rows = rows.unionByName(t.select("kmer", payload.name))
    return rows.groupBy("kmer").agg(payload.merge.alias(payload.name))


def unitig_data(unitigs: DataFrame, index: DataFrame, kmer_data: DataFrame, payload: Payload) -> DataFrame:
    """``unitigs`` with the merged data of their k-mers."""
    found = index.select("unitig_id", "kmer").join(kmer_data.select("kmer", payload.name), "kmer").groupBy(F.col("unitig_id").alias("d_id")).agg(payload.merge.alias(payload.name))
    value = F.coalesce(F.col(payload.name), F.lit(payload.zero)) if payload.zero is not None else F.col(payload.name)
    return unitigs.join(found, F.col("unitig_id") == F.col("d_id"), "left").select(*[unitigs[c] for c in unitigs.columns], value.alias(payload.name))


def concat_data(index: DataFrame, kmer_data: DataFrame, name: str) -> DataFrame:
    """``unitig_id, name``: the data of a unitig's k-mers in the order of their places."""
    rows = index.select("unitig_id", "pos", "kmer").join(kmer_data.select("kmer", name), "kmer")
    return rows.groupBy("unitig_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", name))), lambda x: x[name]).alias(name))


def coverage(index: DataFrame, counts: DataFrame, full: int = 2) -> DataFrame:
    """``unitig_id, total, is_full``: summed counts of a unitig's k-mers, and whether each is seen ``full`` times or more."""
    rows = index.select("unitig_id", "kmer").join(counts.select("kmer", "n"), "kmer", "left").select("unitig_id", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("unitig_id").agg(F.sum("n").alias("total"), (F.min("n") >= full).alias("is_full"))
