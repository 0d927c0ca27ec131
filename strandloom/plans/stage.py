"""Written tables that cut lineage in iterative plans; they lie in the folder of ``spark.checkpoint.dir``.

A lost executor costs nothing that has been written, and no plan is evaluated twice. Where the setting is
missing, a local master takes a folder under /tmp; a cluster is refused, since its machines share no local folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = "/tmp/checkpoints/strandloom"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for table in tables:
        session, folder = table.sparkSession, shared_dir(table.sparkSession)
        for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(name)
            if "/".join(name.split("/")[:-1]).rstrip("/").endswith(folder.rpartition(":")[2].lstrip("/")):
                path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context: they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_strandloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._strandloom_shipped = True


def ship_texts(spark: SparkSession) -> None:
    """``ship``, and bound the bytes of an Arrow batch, so that long records fill neither the JVM's buffers nor a worker. The setting stays in the session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a bare scan out where it has fewer partitions than there are cores (one small file is one task).

    For scans only: asking a plan with a shuffle for its partitions would run it.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def in_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in ranges of ``order``, each a ``p_id``: sums within a range and offsets by range replace windows over a hot key.

    Where the last column of ``order`` differs in each row, no key is too hot to be split.
    """
    return materialize(df.repartitionByRange(*order).withColumn("p_id", F.spark_partition_id()), name)


def number_rows(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Gapless numbers in the order of the columns: range-sorted, counted by partition, offset; no global window."""
    table = in_ranges(df, order, "numbered")
    counts = table.groupBy("p_id").count()
    before = counts.select(F.col("p_id").alias("b_id"), (F.sum("count").over(W.orderBy("p_id")) - F.col("count")).alias("b_before"))  # a row a partition
    inside = F.row_number().over(W.partitionBy("p_id").orderBy(*order)) - 1
    out = table.withColumn("p_in", inside).join(before, F.col("p_id") == F.col("b_id"))
    return out.select((F.col("b_before") + F.col("p_in") + first).cast("long").alias(name), *df.columns)
