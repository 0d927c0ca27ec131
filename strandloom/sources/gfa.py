"""GFA: segments and links in, GFA 1 out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.stage import number_rows


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(segments ``id, seq, tags``, links ``src, src_strand, dst, dst_strand``, header tags) of GFA 1 or 2."""
    lines = spark.read.text(path).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f"))
    head = lines.where(F.get("f", F.lit(0)) == "H").limit(16).collect()  # header lines
    tags = {t.split(":", 2)[0]: t.split(":", 2)[2] for r in head for t in r["f"][1:] if t.count(":") >= 2}
    two = tags.get("VN", "1.0").startswith("2")
    at = 3 if two else 2
    s = lines.where(F.get("f", F.lit(0)) == "S")
    segments = s.select(F.get("f", F.lit(1)).alias("id"), F.get("f", F.lit(at)).alias("seq"), F.slice("f", at + 2, F.greatest(F.size("f") - at - 1, F.lit(0))).alias("tags"))
    if two:
        e = lines.where(F.get("f", F.lit(0)) == "E").select(F.get("f", F.lit(2)).alias("a"), F.get("f", F.lit(3)).alias("b"))
        links = e.select(F.regexp_replace("a", "[+-]$", "").alias("src"), F.regexp_extract("a", "([+-])$", 1).alias("src_strand"), F.regexp_replace("b", "[+-]$", "").alias("dst"), F.regexp_extract("b", "([+-])$", 1).alias("dst_strand"))
    else:
        e = lines.where(F.get("f", F.lit(0)) == "L")
        links = e.select(*[F.get("f", F.lit(i)).alias(n) for i, n in ((1, "src"), (2, "src_strand"), (3, "dst"), (4, "dst_strand"))])
    return segments, links, tags


def gfa_lines(unitigs: DataFrame, edges: DataFrame, k: int, g: int, tag_col: str | None = None) -> DataFrame:
    """``part, a, b, value``: header, segments numbered from 1 in the order of their ids, then links from both ends."""
    numbered = number_rows(unitigs, ["unitig_id"], "number", first=1)
    ids = numbered.select(F.col("unitig_id").alias("i_id"), F.col("number").alias("i_n"))
    zero = F.lit(0).cast("long")
    head = unitigs.sparkSession.range(1).select(F.lit(0).alias("part"), zero.alias("a"), zero.alias("b"), F.lit(f"H\tVN:Z:1.0\tBV:Z:1.0\tKL:Z:{k}\tML:Z:{g}").alias("value"))
    tag = F.concat(F.lit("\tDA:Z:"), F.col(tag_col).cast("string")) if tag_col else F.lit("")
    s = numbered.select(F.lit(1).alias("part"), F.col("number").alias("a"), zero.alias("b"), F.concat(F.lit("S\t"), F.col("number").cast("string"), F.lit("\t"), F.col("seq"), tag).alias("value"))
    e = edges.join(ids, F.col("src") == F.col("i_id")).withColumnRenamed("i_n", "a").drop("i_id").join(ids, F.col("dst") == F.col("i_id")).withColumnRenamed("i_n", "b")
    links = e.select(F.lit(2).alias("part"), "a", "b", F.concat_ws("\t", F.lit("L"), F.col("a").cast("string"), "src_strand", F.col("b").cast("string"), "dst_strand", F.lit(f"{k - 1}M")).alias("value"))
    return head.union(s).union(links)


def write_gfa(unitigs: DataFrame, edges: DataFrame, path: str, k: int, g: int, tag_col: str | None = None, gzip: bool = True) -> None:
    lines = gfa_lines(unitigs, edges, k, g, tag_col).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b", "value")
    lines.select("value").write.option("compression", "gzip" if gzip else "none").text(path)
