"""Resharding by minimum-cost flow.

From the bytes of the old shards and the capacities of the new ones a flow is solved that moves the
fewest bytes. Its amounts cut each old shard, in the order of a hash of the id, into ranges; a
document goes where its middle byte falls. Only the sizes by shard reach the driver; prefix sums are
taken within ranges of a unique order, so no shard and no id is gathered in one task.

``rewrite`` then writes the files of the shards that gain or lose rows into a folder of a new version. A manifest tells
for each shard where its files lie; it is written last, so a reader sees the old shards or the new ones.

Null texts have size 1. Null ids hash like a value of their own; equal rows take neighbouring slots and can change
places. Long texts count whole; a text longer than a shard's room goes where its middle byte falls.
An empty table gives an empty table. Reruns agree. Of the columns only the id and text are read by ``reshard``.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import in_ranges, keyed, materialize


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each supply to each demand of least total cost; both sums are equal. Successive shortest paths."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, room, cost, place of the reverse

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, min(supply[i], demand[j]), cost[i][j])
    potential = [0] * len(graph)
    while True:
        far: list[float] = [float("inf")] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room > 0 and (e := d + price + potential[a] - potential[b]) < far[b]:
                    far[b], came[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        if came[sink] is None:
            break
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        room, b = None, sink
        while b != source:
            a, k = came[b]
            room = graph[a][k][1] if room is None else min(room, graph[a][k][1])
            b = a
        b = sink
        while b != source:
            a, k = came[b]
            graph[a][k][1] -= room
            graph[b][graph[a][k][3]][1] += room
            b = a
    out = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, _, _, back in graph[i]:
            if n <= b < n + m:
                out[i][b - n] = graph[b][back][1]
    return out


def even(total: int, shards: int) -> list[int]:
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def ranges(sizes: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, first byte, end byte, new shard): bytes that stay come first."""
    old = sorted(sizes)
    cost = [[0 if i == j else 1 for j in range(len(capacities))] for i in old]
    flow = min_cost_flow([sizes[i] for i in old], capacities, cost)
    out = []
    for i, row in zip(old, flow, strict=True):
        at = 0
        for j in sorted(range(len(capacities)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def even_or_scaled(total: int, shards: int, capacities: list[int] | None) -> list[int]:
    if capacities is None:
        return even(total, shards)
    whole = sum(capacities)
    ends = [total * sum(capacities[: i + 1]) // whole for i in range(len(capacities))]
    return [b - a for a, b in zip([0, *ends], ends)]


def reshard(docs: DataFrame, old_shard: Column, shards: int = 16, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, *carry, size, text_crc32, old_shard, shard, slot`` of every row.

    ``old_shard``: a number below a small bound, the shard a row is in; null counts as 0. ``capacities``: bytes of each new
    shard, equal ones by default; they are scaled to the total. ``carry``: columns to hand on, such as a row's key.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), *kept, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), F.xxhash64(id_col).alias("h"))
    order = ["h", "id", "size", "text_crc32", "row"]
    rows = in_ranges(rows.withColumn("row", F.monotonically_increasing_id()), ["old_shard", *order], "shard-rows")
    sums = rows.groupBy("old_shard", "p_id").agg(F.sum("size").alias("bytes"))
    sizes = {r[0]: r[1] for r in sums.groupBy("old_shard").agg(F.sum("bytes")).collect()}  # a row for each old shard
    total = sum(sizes.values())
    cuts = spark.createDataFrame(ranges(sizes, even_or_scaled(total, shards, capacities)) if total else [(-1, 0, 0, 0)], "c_old int, c_from bigint, c_to bigint, shard int")

    before = sums.select(F.col("old_shard").alias("b_old"), F.col("p_id").alias("b_id"), (F.sum("bytes").over(W.partitionBy("old_shard").orderBy("p_id")) - F.col("bytes")).alias("b_before"))
    inside = F.sum("size").over(W.partitionBy("old_shard", "p_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    at = rows.withColumn("inside", inside).join(before, (F.col("old_shard") == F.col("b_old")) & (F.col("p_id") == F.col("b_id")))
    at = at.withColumn("middle", F.col("b_before") + F.col("inside") + F.expr("size div 2"))
    # At most old shards x new shards ranges: small by construction.
    placed = at.join(F.broadcast(cuts), (F.col("old_shard") == F.col("c_old")) & (F.col("middle") >= F.col("c_from")) & (F.col("middle") < F.col("c_to")))
    placed = materialize(placed.select("id", *[f"carry_{i}" for i in range(len(carry))], "size", "text_crc32", "old_shard", "shard", "p_id", *[c for c in order if c in ("h", "row")]), "placed")

    n = placed.groupBy(F.col("shard").alias("s_shard"), F.col("old_shard").alias("s_old"), F.col("p_id").alias("s_id")).agg(F.count("*").alias("s_n"))
    n = n.select("s_shard", "s_old", "s_id", (F.sum("s_n").over(W.partitionBy("s_shard").orderBy("s_old", "s_id")) - F.col("s_n")).alias("s_before"))
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("shard", "old_shard", "p_id").orderBy(*order)) - 1)
    out = ranked.join(n, (F.col("shard") == F.col("s_shard")) & (F.col("old_shard") == F.col("s_old")) & (F.col("p_id") == F.col("s_id")))
    named = [F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("id").alias(id_col), *named, "size", "text_crc32", "old_shard", "shard", (F.col("s_before") + F.col("r")).cast("long").alias("slot"))


def read_manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """(version, ``shard: folder``) of the newest version, (0, nothing) before the first; shards without rows are not in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return 0, {}
    rows = spark.read.parquet(f"{path}/manifest").collect()  # a row a shard and version
    newest = max(r["version"] for r in rows)
    return newest, {r["shard"]: r["folder"] for r in rows if r["version"] == newest and r["folder"] is not None}


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest version, with their ``shard``."""
    by_version: dict[str, list[str]] = {}
    for folder in read_manifest(spark, path)[1].values():
        by_version.setdefault(folder.rpartition("/")[0], []).append(folder)
    out = None
    for base, folders in sorted(by_version.items()):
        part = spark.read.option("basePath", base).parquet(*sorted(folders))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no shard of {path} has rows")
    return out


def rewrite(docs: DataFrame, old_col: str, path: str, shards: int = 16, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict[int, str]:
    """Reshard the stored rows ``docs`` (``old_col``: the shard a row is in) and rewrite the files that this affects.

    Files lie under ``path/v<version>-<name>/shard=N`` and hold the columns of ``docs`` (but for ``shard``) and ``slot``. Shards that
    neither gain nor lose rows keep the files that the manifest names; a shard that loses all its rows leaves the manifest.
    Old files are not touched, so readers of the former version and failed jobs do no harm. Rows are told apart by file
    and place, so ids may repeat or be null. Returns the new manifest.
    """
    spark = docs.sparkSession
    version, old = read_manifest(spark, path)
    rows, at = keyed(docs)
    placed = materialize(reshard(rows, F.col(at[old_col]), shards, capacities, at[id_col], at[text_col], carry=("row_file", "row_at")), "resharded")
    flows = placed.groupBy("old_shard", "shard").count().collect()  # at most old shards x new shards rows
    touched = {s for r in flows if r["old_shard"] != r["shard"] for s in (r["old_shard"], r["shard"])}
    stay = {s: f for s, f in old.items() if s not in touched}
    made = {r["shard"] for r in flows} - set(stay)
    folder = f"{path}/v{version + 1}-{uuid.uuid4().hex[:8]}"
    if made:
        place = placed.where(F.col("shard").isin(*made)).select(F.col("row_file").alias("p_file"), F.col("row_at").alias("p_at"), "shard", "slot")
        joined = rows.join(place, (F.col("row_file") == F.col("p_file")) & (F.col("row_at") == F.col("p_at")))
        names = [c for c in docs.columns if c not in ("shard", "slot")]
        joined.select(*[F.col(at[c]).alias(c) for c in names], "slot", "shard").write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    where = stay | {s: f"{folder}/shard={s}" for s in made}
    manifest = [(version + 1, s, f) for s, f in sorted(where.items())] or [(version + 1, -1, None)]
    spark.createDataFrame(manifest, "version bigint, shard int, folder string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # published at once
    return where
