"""What the operators share: written tables, row keys, columns that can't clash, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.stage import forget, in_ranges, materialize, ship


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of names that can't clash, and the new name of each old one; ``toDF`` brings the old ones back."""
    names = [f"in_{i}_" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def _bare_scan(df: DataFrame) -> bool:
    """Whether the rows are those of files, one for one."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().lower()


def keyed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Like ``shield``, with ``row_file, row_at``: two longs that name a row, the same whenever the plan is run.

    Rows of Parquet files are named by file and place, without a copy; other plans are written first.
    """
    names = [f"in_{i}_" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    if _bare_scan(df) and "_metadata" not in df.columns:
        named = df.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()], F.xxhash64("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_at"))
        return named, at
    return materialize(df.toDF(*names).withColumn("row_file", F.lit(0).cast("long")).withColumn("row_at", F.monotonically_increasing_id()), "keyed"), at


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound what one Arrow batch may hold, so that long texts can't fill a Python worker; send the package.

    The settings are read when a plan runs, so they stay in the session; a smaller number of rows is left alone.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back the memory it does not use: workers stay, and the next stage needs it."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return ran


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: bound as the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


__all__ = ["bounded_batches", "forget", "in_ranges", "keyed", "lean", "let", "materialize", "shield"]
