"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Targets: every source's share of the wanted total by weight, stopped at ``most`` times its size, the
excess shared again by weight until none is above. Each source's documents stand in the order of
a hash of their id, the whole source once for each pass; a copy is taken while its middle word lies below the
target. A source's weight runs over the training linearly, from 1 + ramp to 1 - ramp; the integral
of this schedule is its cumulative demand, and inverting it gives a copy's training position.

Documents and sources are summed within ranges of a unique order and offset by range, so neither a hot source nor a
hot id, nor the number of sources, is gathered in one task.

Null and empty texts have size 0. Null sources form one source, the last. Repeated rows are handled each; equal ones can
change places. Long texts count whole. An empty table gives an empty table. Sums are in whole numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .rules import words_of
from .scratch import in_ranges, keyed, materialize

WEIGHTS = (5, 2, 1)
RAMPS = (0.5, 0.0, -0.5)
WIDE = "decimal(38,0)"


def running(table: DataFrame, order: list[Column | str], of: list[str], name: str) -> DataFrame:
    """``table`` with ``<c>_before`` for each column: its sum over all rows that stand before in the order. Ranges, not one window."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = materialize(table.repartitionByRange(*by).withColumn("r_id", F.spark_partition_id()), name)
    sums = rows.groupBy("r_id").agg(*[F.sum(c).cast(WIDE).alias(c) for c in of])
    upto = W.orderBy("r_id").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    offsets = sums.select(F.col("r_id").alias("o_id"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).cast(WIDE).alias(f"o_{c}") for c in of])
    inside = W.partitionBy("r_id").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).cast(WIDE).alias(f"i_{c}") for c in of]).join(offsets, F.col("r_id") == F.col("o_id"))
    return out.select(*table.columns, *[(F.col(f"i_{c}") + F.col(f"o_{c}")).cast(WIDE).alias(f"{c}_before") for c in of])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``source, source_size, target, ramp`` of ``sizes(source, source_size)``; share: the wanted total as a fraction of all sizes.

    Weights are dealt to the sources by code point, null last.
    """
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.pmod(F.col("place"), F.lit(len(values))).cast("int"))
    ranked = running(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], ["one"], "source-places")
    s = ranked.select("source", "source_size", F.col("one_before").cast("long").alias("place"))
    s = s.withColumn("w", pick(weights, "long")).withColumn("ramp", pick(ramps, "double")).withColumn("cap", F.col("source_size") * most)
    # In the order of cap / weight a source is capped exactly if its cap lies below its share of what those before it left.
    s = materialize(running(s, [F.col("cap") / F.col("w"), F.col("place")], ["cap", "w"], "source-caps"), "sources")
    up, down = share
    whole = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast(WIDE).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()  # one row
    want, w_all = int(whole["size"]) * up, int(whole["w"])
    small = lambda c: c.cast("decimal(18,0)")
    capped = F.col("cap").cast("decimal(19,0)") * small(down * (F.lit(w_all) - F.col("w_before").cast("long"))) < (F.lit(want).cast("decimal(22,0)") - F.col("cap_before") * down).cast("decimal(22,0)") * F.col("w").cast("decimal(15,0)")
    s = s.withColumn("capped", capped)
    taken = s.where("capped").agg(F.coalesce(F.sum("cap"), F.lit(0)).cast(WIDE).alias("cap"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()  # one row
    rest, over = want - int(taken["cap"]) * down, max(1, (w_all - int(taken["w"])) * down)
    free = (F.lit(rest).cast("decimal(22,0)") * F.col("w").cast("decimal(15,0)")).cast("double") / F.lit(float(over))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free).alias("target"), "ramp")


def invert(demand: Column, ramp: Column) -> Column:
    """The time at which a source with this ramp has met this part of its demand: the integral is (1 + r) t - r t^2."""
    t = ((1 + ramp) - F.sqrt((1 + ramp) * (1 + ramp) - 4 * ramp * demand)) / (2 * ramp)
    return F.when(ramp == 0, demand).otherwise(t)


def mix(docs: DataFrame, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id[, *carry], size, source_size, target, copies, taken, positions`` of every row.

    ``positions``: the training position, from 0 to 1, of each copy taken. ``carry``: columns to hand on, such as a row's key.
    """
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), *kept, F.col(source_col).alias("source"), F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("size"))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("row", F.monotonically_increasing_id())
    order = ["h", "id", "size", "row"]
    rows = in_ranges(materialize(rows, "sizes"), ["source", *order], "ranged-sizes")
    sums = materialize(rows.groupBy("source", "p_id").agg(F.sum("size").alias("n")), "range-sums")
    before = sums.select(F.col("source").alias("b_source"), F.col("p_id").alias("b_id"), (F.sum("n").over(W.partitionBy("source").orderBy("p_id")) - F.col("n")).alias("b_before"))
    sources = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), most=most).withColumnRenamed("source", "s_source")
    # One table by (source, range), so that the rows are joined once and a hot source is spread over its ranges.
    cells = before.join(sources, before["b_source"].eqNullSafe(sources["s_source"])).drop("s_source")
    inside = F.sum("size").over(W.partitionBy("source", "p_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    at = rows.withColumn("inside", inside).join(cells, rows["source"].eqNullSafe(cells["b_source"]) & (rows["p_id"] == cells["b_id"]))
    begin = F.col("b_before") + F.col("inside")
    twice = [2 * (begin + k * F.col("source_size")) + F.col("size") for k in range(most)]
    copies = sum(((m < 2 * F.col("target")).cast("int") for m in twice), F.lit(0))
    places = F.array(*[invert((m / F.lit(2.0)) / F.col("target"), F.col("ramp")) for m in twice])
    out = at.withColumn("copies", copies).withColumn("positions", F.slice(F.when(F.col("target") > 0, places).otherwise(F.array().cast("array<double>")), 1, F.col("copies")))
    named = [F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("id").alias(id_col), *named, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "positions")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, range-sorted by training position."""
    rows, at = keyed(docs)
    mixed = mix(rows, id_col=at[id_col], text_col=at[text_col], source_col=at[source_col], carry=("row_file", "row_at"))
    copies = materialize(mixed.select(F.col("row_file").alias("c_file"), F.col("row_at").alias("c_at"), F.explode("positions").alias("c_position")), "copies")
    drawn = rows.join(copies, (F.col("row_file") == F.col("c_file")) & (F.col("row_at") == F.col("c_at")))
    by = ["c_position", "row_file", "row_at"]
    return drawn.repartitionByRange(*by).sortWithinPartitions(*by).select(*at.values()).toDF(*docs.columns)
