"""Graph cleaning: isolated unitigs and tips, judged once against the graph as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compact import degrees, join_ends
from .compact_local import unitig_kmers


def to_remove(unitigs: DataFrame, edges: DataFrame, k: int, clip_tips: bool = False, delete_isolated: bool = False) -> DataFrame:
    """``unitig_id`` of short unitigs (fewer than k k-mers) with no neighbour (isolated) or with one (tips)."""
    n = degrees(unitigs, edges).select(F.col("unitig_id").alias("g_id"), (F.col("n_in") + F.col("n_out")).alias("n"))
    wanted = [x for x, on in ((0, delete_isolated), (1, clip_tips)) if on]
    short = unitigs.where(F.col("n_kmers") < k).select("unitig_id")
    return short.join(n, F.col("unitig_id") == F.col("g_id")).where(F.col("n").isin(wanted)).select("unitig_id")


def kept(unitigs: DataFrame, edges: DataFrame, k: int, clip_tips: bool = False, delete_isolated: bool = False) -> DataFrame:
    """The unitigs that stay, as they were."""
    gone = to_remove(unitigs, edges, k, clip_tips, delete_isolated).select(F.col("unitig_id").alias("r_id"))
    return unitigs.join(gone, F.col("unitig_id") == F.col("r_id"), "left_anti")


def simplify(kmers: DataFrame, unitigs: DataFrame, index: DataFrame, edges: DataFrame, k: int, clip_tips: bool = False, delete_isolated: bool = False) -> DataFrame:
    """The k-mers that stay."""
    return unitig_kmers(kept(unitigs, edges, k, clip_tips, delete_isolated), k).select("kmer")


def simplified(unitigs: DataFrame, edges: DataFrame, k: int, clip_tips: bool = False, delete_isolated: bool = False) -> DataFrame:
    """Unitigs of the simplified graph. An isolated one has no neighbour, so no other changes when it goes; where a tip went, its neighbours may join."""
    left = kept(unitigs, edges, k, clip_tips, delete_isolated)
    return join_ends(left, k) if clip_tips else left
