"""Queries against a graph: k-mers found, their ratio, presence, by color, exact or within one edit.

Hits of a query are counted by position: a k-mer that stands twice counts twice. The denominator is
the number of windows of the query, those with N included, 0 for queries shorter than k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandloom.functions import dna

from .kmers import kmers, positioned


def windows(records: DataFrame, k: int, name_col: str, seq_col: str = "seq") -> DataFrame:
    """``name, n_query``: windows of each name, over all its records (a file of records is one query)."""
    n = F.greatest(F.char_length(F.coalesce(F.col(seq_col), F.lit(""))) - (k - 1), F.lit(0)).cast("long")
    return records.groupBy(F.col(name_col).alias("name")).agg(F.sum(n).alias("n_query"))


def _asked(records: DataFrame, k: int, name_col: str, seq_col: str) -> DataFrame:
    """``name, kmer, n``: combined before the join, so a frequent k-mer is one row a query."""
    rows = kmers(records, k, keep=[name_col], seq_col=seq_col)
    return rows.groupBy(F.col(name_col).alias("name"), "kmer").agg(F.count("*").alias("n"))


def search(graph_kmers: DataFrame, records: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """``name, n_query, n_found, ratio``: positions of each query whose k-mer is in the graph."""
    found = _asked(records, k, name_col, seq_col).join(graph_kmers.select("kmer"), "kmer", "left_semi").groupBy("name").agg(F.sum("n").alias("n_found"))
    return _with_ratio(windows(records, k, name_col, seq_col), found)


def _with_ratio(total: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("name", "f_name")
    out = total.join(found, F.col("name").eqNullSafe(F.col("f_name")), "left").select("name", "n_query", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))
    return out.withColumn("ratio", F.when(F.col("n_query") > 0, F.col("n_found") / F.col("n_query")).otherwise(F.lit(0.0)))


def enough(n_found: Column, n_query: Column, min_ratio: float) -> Column:
    """Presence: at least max(1, windows times the ratio, rounded half up)."""
    return n_found >= F.greatest(F.lit(1), F.round(n_query * F.lit(float(min_ratio))).cast("long"))


def presence(graph_kmers: DataFrame, records: DataFrame, k: int, min_ratio: float, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """``name, present``: 1 where enough k-mers are found."""
    r = search(graph_kmers, records, k, name_col, seq_col)
    return r.select("name", enough(F.col("n_found"), F.col("n_query"), min_ratio).cast("int").alias("present"))


def search_colors(colors: DataFrame, records: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """``name, color, n_query, n_found, ratio`` for every query and color with a hit."""
    hits = _asked(records, k, name_col, seq_col).join(colors.select("kmer", "color"), "kmer").groupBy("name", "color").agg(F.sum("n").alias("n_found"))
    return _color_ratios(hits, windows(records, k, name_col, seq_col))


def _color_ratios(hits: DataFrame, total: DataFrame) -> DataFrame:
    out = hits.join(total.withColumnRenamed("name", "t_name"), F.col("name").eqNullSafe(F.col("t_name")))
    return out.select("name", "color", "n_query", "n_found", (F.col("n_found") / F.col("n_query")).alias("ratio"))


def color_matrix(hits: DataFrame, names: DataFrame, colors: list, value: str = "n_found") -> DataFrame:
    """One row for each of ``names(name)``, one column a color, 0 where there is no hit; ``colors`` are listed so that no pass is needed to find them.

    A null color's column is named "null", with underscores behind it where a color has that name.
    """
    asked = names.select("name").distinct()
    if not colors:
        return asked
    number = F.coalesce(*[F.when(F.col("color").eqNullSafe(F.lit(c)), F.lit(i)) for i, c in enumerate(colors)])
    cells = hits.withColumn("color_number", number).groupBy(F.col("name").alias("h_name")).pivot("color_number", list(range(len(colors)))).agg(F.first(value))
    out = asked.join(cells, F.col("name").eqNullSafe(F.col("h_name")), "left").drop("h_name").na.fill(0, [str(i) for i in range(len(colors))])
    empty = "null"
    while empty in colors:
        empty += "_"
    return out.toDF("name", *[empty if c is None else str(c) for c in colors])


def present_colors(found: DataFrame, min_ratio: float) -> DataFrame:
    """``name, color`` pairs of ``found(name, color, n_query, n_found)`` with enough hits."""
    return found.where(enough(F.col("n_found"), F.col("n_query"), min_ratio)).select("name", "color")


def color_presence(colors: DataFrame, records: DataFrame, k: int, min_ratio: float, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """``name, color`` pairs that are present."""
    return present_colors(search_colors(colors, records, k, name_col, seq_col), min_ratio)


def in_colors(present: DataFrame, total: DataFrame, min_colors: int) -> DataFrame:
    """``name, n_colors, present`` for each of ``total(name)``: 1 where at least ``min_colors`` of ``present(name, color)`` have the query."""
    n = present.groupBy(F.col("name").alias("p_name")).agg(F.count("*").alias("n_colors"))
    out = total.select("name").join(n, F.col("name").eqNullSafe(F.col("p_name")), "left").select("name", F.coalesce("n_colors", F.lit(0)).cast("long").alias("n_colors"))
    return out.withColumn("present", (F.col("n_colors") >= min_colors).cast("int"))


def presence_in_colors(colors: DataFrame, records: DataFrame, k: int, min_ratio: float, min_colors: int, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """``name, n_colors, present``: 1 where at least ``min_colors`` colors have the query."""
    return in_colors(color_presence(colors, records, k, min_ratio, name_col, seq_col), windows(records, k, name_col, seq_col), min_colors)


def find(index: DataFrame, records: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq", ends_only: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """``name, pos, unitig_id, dist, strand``: where each window of the queries lies; strand true where it reads along the unitig.

    With ``ends_only`` only the first and last k-mer of unitigs count (``sizes``: unitig_id, n_kmers).
    """
    at = positioned(records, k, [name_col], seq_col).select(F.col(name_col).alias("name"), "pos", "kmer", (F.col("oriented") == F.col("kmer")).alias("q_strand"))
    hits = at.join(index.select("kmer", "unitig_id", F.col("pos").alias("dist"), "strand"), "kmer")
    if ends_only:
        hits = hits.join(sizes.select("unitig_id", "n_kmers"), "unitig_id").where((F.col("dist") == 0) | (F.col("dist") == F.col("n_kmers") - 1))
    return hits.select("name", "pos", "unitig_id", "dist", (F.col("strand") == F.col("q_strand")).alias("strand"))


def find_minimizers(index: DataFrame, minimizers: DataFrame, k: int, g: int | None = None) -> DataFrame:
    """``minimizer, unitig_id, pos``: every k-mer of the graph whose minimizer is one of ``minimizers(minimizer)``, packed g-mers."""
    held = index.select(dna.minimizer(F.col("kmer"), k, g).alias("minimizer"), "unitig_id", "pos")
    return held.join(minimizers.select("minimizer").distinct(), "minimizer", "left_semi")


def mapping_runs(index: DataFrame, records: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """``name, pos, unitig_id, dist, len, size, strand``: maximal runs of consecutive windows along one unitig and strand."""
    hits = find(index, records, k, name_col, seq_col)
    step = F.when(F.col("strand"), F.col("pos") - F.col("dist")).otherwise(F.col("pos") + F.col("dist"))
    w = W.partitionBy("name", "unitig_id", "strand", "diagonal").orderBy("pos")
    runs = hits.withColumn("diagonal", step).withColumn("run", F.col("pos") - F.row_number().over(w))
    out = runs.groupBy("name", "unitig_id", "strand", "diagonal", "run").agg(F.min("pos").alias("pos"), F.min("dist").alias("dist"), F.count("*").alias("len"))
    return out.select("name", "pos", "unitig_id", "dist", "len", (F.col("len") + k - 1).alias("size"), "strand")


def _edited(x: Column, next_base: Column, k: int, substitution: bool, insertion: bool, deletion: bool) -> Column | None:
    """The different canonical k-mers one edit away."""
    parts = []
    if substitution:
        parts.append(dna.substitutions(x, k))
    if insertion:
        parts.append(dna.insertions(x, k))
    if deletion:
        parts.append(F.when(next_base.isNotNull(), dna.deletions(x, next_base, k)).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.transform(F.concat(*parts), lambda y: dna.rep(y, k))) if parts else None


def _placed(records: DataFrame, k: int, name_col: str, seq_col: str) -> DataFrame:
    """Windows by query, record and place: positions are numbered over all records of a name apart by record."""
    rows = records.select(F.col(name_col).alias("name"), F.monotonically_increasing_id().alias("rec"), F.col(seq_col).alias("seq"))
    return positioned(rows, k, ["name", "rec"])


def search_inexact(graph_kmers: DataFrame, records: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq", substitution: bool = True, insertion: bool = True, deletion: bool = True, exact: bool = True) -> DataFrame:
    """``name, n_query, n_found, ratio``: positions hit exactly or by a k-mer one edit away.

    Only positions without an exact hit are expanded, each different neighbour once.
    """
    at = _placed(records, k, name_col, seq_col).select("name", "rec", "pos", "oriented", "kmer", "next_base")
    marked = at.join(graph_kmers.select("kmer", F.lit(True).alias("hit")), "kmer", "left")
    hits = marked.where("hit").select("name", "rec", "pos")
    near = _edited(F.col("oriented"), F.col("next_base"), k, substitution, insertion, deletion)
    if near is not None:
        asked = marked.where(F.col("hit").isNull()).select("name", "rec", "pos", F.explode(near).alias("kmer"))
        edited = asked.join(graph_kmers.select("kmer"), "kmer", "left_semi").select("name", "rec", "pos").distinct()
        hits = hits.union(edited) if exact else edited
    found = hits.groupBy("name").agg(F.count("*").alias("n_found"))
    return _with_ratio(windows(records, k, name_col, seq_col), found)


def search_colors_inexact(colors: DataFrame, records: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq", substitution: bool = True, insertion: bool = True, deletion: bool = True, exact: bool = True) -> DataFrame:
    """``name, color, n_query, n_found, ratio``: positions that hit a color exactly or by a k-mer one edit away.

    A color counts a position once, by whichever k-mer; so positions with an exact hit are expanded too, for another color may
    be one edit away.
    """
    at = _placed(records, k, name_col, seq_col)
    own = F.array("kmer") if exact else F.array().cast("array<bigint>")
    near = _edited(F.col("oriented"), F.col("next_base"), k, substitution, insertion, deletion)
    asked = at.select("name", "rec", "pos", F.explode(F.array_distinct(F.concat(own, near) if near is not None else own)).alias("kmer"))
    hits = asked.join(colors.select("kmer", "color"), "kmer").select("name", "rec", "pos", "color").distinct()
    return _color_ratios(hits.groupBy("name", "color").agg(F.count("*").alias("n_found")), windows(records, k, name_col, seq_col))
