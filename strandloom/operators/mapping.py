"""Accessors of mappings (unitig_id, dist, len, strand) joined with their unitig's ``seq`` and ``n_kmers``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna


def mapped_sequence(k: int) -> Column:
    """The mapped bases, read along the query."""
    part = F.substring(F.col("seq"), F.col("dist") + 1, F.col("len") + k - 1)
    return F.when(F.col("strand"), part).otherwise(dna.reverse_complement(part))


def kmer_at(i: Column, k: int) -> Column:
    """K-mer of the unitig at a place from 0."""
    return F.substring(F.col("seq"), i + 1, F.lit(k))


def mapped_kmer(i: Column, k: int) -> Column:
    """K-mer of the mapping at a place from 0, along the query; null outside."""
    at = F.when(F.col("strand"), F.col("dist") + i).otherwise(F.col("dist") + F.col("len") - 1 - i)
    word = kmer_at(at, k)
    return F.when((i >= 0) & (i < F.col("len")), F.when(F.col("strand"), word).otherwise(dna.reverse_complement(word)))


def mapped_head(k: int) -> Column:
    return mapped_kmer(F.lit(0), k)


def mapped_tail(k: int) -> Column:
    return mapped_kmer(F.col("len") - 1, k)


def unitig_head(k: int) -> Column:
    return kmer_at(F.lit(0), k)


def unitig_tail(k: int) -> Column:
    return kmer_at(F.col("n_kmers") - 1, k)


def whole_unitig() -> Column:
    return (F.col("dist") == 0) & (F.col("len") == F.col("n_kmers"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), i - 1))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(same), n))


def accessors(mappings: DataFrame, unitigs: DataFrame, k: int) -> DataFrame:
    """``mappings`` with the mapped sequence, head and tail, the unitig's head and tail, and whether the whole unitig is mapped."""
    rows = mappings.join(unitigs.select("unitig_id", "seq", "n_kmers"), "unitig_id")
    return rows.select(*[rows[c] for c in mappings.columns], mapped_sequence(k).alias("mapped"), mapped_head(k).alias("mapped_head"), mapped_tail(k).alias("mapped_tail"), unitig_head(k).alias("head"), unitig_tail(k).alias("tail"), whole_unitig().alias("whole"))
