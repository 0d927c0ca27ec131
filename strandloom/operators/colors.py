"""Colors: which inputs hold which k-mers of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .kmers import kmers, partial_counts


def color_table(records: DataFrame, name_col: str, order_col: str | None = None) -> DataFrame:
    """``color_id, name``: inputs numbered from 0 in the order of their names, or of their first ``order_col`` (such as file_id); one row an input."""
    names = records.groupBy(F.col(name_col).alias("name")).agg(F.min(order_col if order_col else name_col).alias("place"))
    return names.select((F.row_number().over(W.orderBy("place", "name")) - 1).cast("int").alias("color_id"), "name")


def color_kmers(graph_kmers: DataFrame, records: DataFrame, k: int, color_col: str, seq_col: str = "seq") -> DataFrame:
    """``kmer, color`` of the graph's k-mers: the inputs are read again and matched to the graph, each pair once."""
    seen = partial_counts(records, k, color_col, seq_col).select("kmer", F.col(color_col).alias("color"))
    return seen.join(graph_kmers.select("kmer"), "kmer", "left_semi").distinct()


def count_colors(records: DataFrame, k: int, color_col: str, min_count: int = 1, seq_col: str = "seq") -> DataFrame:
    """``kmer, color`` of k-mers seen ``min_count`` times or more in all inputs together: the inputs are read and cut once.

    Counts by k-mer and color are combined before the shuffle; then a k-mer has a row a color at most.
    """
    pairs = partial_counts(records, k, color_col, seq_col).groupBy("kmer", F.col(color_col).alias("color")).agg(F.sum("n").alias("n"))
    if min_count <= 1:
        return pairs.select("kmer", "color")
    return pairs.withColumn("total", F.sum("n").over(W.partitionBy("kmer"))).where(F.col("total") >= min_count).select("kmer", "color")


def colors_per_kmer(colors: DataFrame) -> DataFrame:
    """``n_colors, kmers``: how many k-mers have so many colors."""
    return colors.groupBy("kmer").agg(F.count("*").alias("n_colors")).groupBy("n_colors").agg(F.count("*").alias("kmers"))


def unitig_colors(index: DataFrame, colors: DataFrame) -> DataFrame:
    """``unitig_id, color, n, full``: k-mers of a unitig with a color; full where all have it."""
    sizes = index.groupBy("unitig_id").agg(F.count("*").alias("size"))
    n = index.select("unitig_id", "kmer").join(colors, "kmer").groupBy("unitig_id", "color").agg(F.count("*").alias("n"))
    return n.join(sizes, "unitig_id").select("unitig_id", "color", "n", (F.col("n") == F.col("size")).alias("full"))


def mapping_colors(index: DataFrame, colors: DataFrame, mappings: DataFrame, every: bool = False) -> DataFrame:
    """``mappings`` columns and ``color`` for each color on some (or every) k-mer of mappings(unitig_id, dist, len)."""
    cols = mappings.columns
    asked = mappings.select(*cols, F.explode(F.sequence(F.col("dist"), F.col("dist") + F.col("len") - 1)).alias("m_pos")).where(F.col("len") > 0)
    places = index.select(F.col("unitig_id").alias("i_id"), F.col("pos").alias("i_pos"), F.col("kmer").alias("i_kmer"))
    inside = asked.join(places, (F.col("unitig_id") == F.col("i_id")) & (F.col("m_pos") == F.col("i_pos")))
    colored = inside.join(colors.select(F.col("kmer").alias("c_kmer"), F.col("color").alias("c_color")), F.col("i_kmer") == F.col("c_kmer"))
    n = colored.groupBy(*cols, "c_color").agg(F.countDistinct("i_pos").alias("c_n"))
    return (n.where(F.col("c_n") == F.col("len")) if every else n).select(*cols, F.col("c_color").alias("color"))


def _on(index: DataFrame, mappings: DataFrame, color) -> DataFrame:
    """``kmer, color`` of all k-mers of ``mappings(unitig_id, dist, len)``."""
    asked = mappings.where("len > 0").select(F.col("unitig_id").alias("m_id"), F.explode(F.sequence(F.col("dist"), F.col("dist") + F.col("len") - 1)).alias("m_pos"))
    held = index.join(asked, (F.col("unitig_id") == F.col("m_id")) & (F.col("pos") == F.col("m_pos")))
    return held.select("kmer", F.lit(color).alias("color")).distinct()


def add_color(colors: DataFrame, index: DataFrame, mappings: DataFrame, color) -> DataFrame:
    """``colors`` with the color on every k-mer of the mappings."""
    return colors.select("kmer", "color").union(_on(index, mappings, color)).distinct()


def remove_color(colors: DataFrame, index: DataFrame, mappings: DataFrame, color) -> DataFrame:
    """``colors`` without the color on any k-mer of the mappings."""
    gone = _on(index, mappings, color).withColumnsRenamed({"kmer": "g_kmer", "color": "g_color"})
    return colors.select("kmer", "color").join(gone, (F.col("kmer") == F.col("g_kmer")) & F.col("color").eqNullSafe(F.col("g_color")), "left_anti")


def color_sizes(index: DataFrame, colors: DataFrame, mappings: DataFrame) -> DataFrame:
    """``mappings`` columns, ``color, n``: on how many k-mers of a mapping a color lies; their sum is the size of its color set."""
    cols = mappings.columns
    asked = mappings.where("len > 0").select(*cols, F.explode(F.sequence(F.col("dist"), F.col("dist") + F.col("len") - 1)).alias("m_pos"))
    places = index.select(F.col("unitig_id").alias("i_id"), F.col("pos").alias("i_pos"), F.col("kmer").alias("i_kmer"))
    held = asked.join(places, (F.col("unitig_id") == F.col("i_id")) & (F.col("m_pos") == F.col("i_pos")))
    colored = held.join(colors.select(F.col("kmer").alias("c_kmer"), F.col("color").alias("c_color")), F.col("i_kmer") == F.col("c_kmer"))
    return colored.groupBy(*cols, F.col("c_color").alias("color")).agg(F.countDistinct("i_pos").alias("n"))


def color_max(index: DataFrame, colors: DataFrame) -> DataFrame:
    """``unitig_id, color``: the last color, in the order of the colors, on any k-mer of a unitig."""
    return index.select("unitig_id", "kmer").join(colors, "kmer").groupBy("unitig_id").agg(F.max("color").alias("color"))


def color_bitmaps(colors: DataFrame) -> DataFrame:
    """``kmer, bucket, bitmap`` of ``colors(kmer, color_id)``: color sets as bitmaps that merge by or."""
    at = colors.select("kmer", F.bitmap_bucket_number("color_id").alias("bucket"), F.bitmap_bit_position("color_id").alias("bit"))
    return at.groupBy("kmer", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def check_colors(graph_kmers: DataFrame, records: DataFrame, colors: DataFrame, k: int, color_col: str) -> DataFrame:
    """Pairs on one side only, for graphs that keep every k-mer: none if the colors are right."""
    truth = kmers(records, k, keep=[color_col]).select("kmer", F.col(color_col).alias("color")).distinct()
    mine = colors.select("kmer", "color")
    return truth.exceptAll(mine).withColumn("side", F.lit("missing")).unionByName(mine.exceptAll(truth).withColumn("side", F.lit("extra")))
