"""URL filters from dated lists, in DataFrame functions only.

A list entry says that from a day on a key is blocked or allowed. A key is a host with all below it
("example.org") or a host with the start of a path ("example.org/de"), which holds for that host alone. Entries of a key become
intervals that do not overlap; every capture meets the entries active at its fetch time by a join on
its keys. The longest key decides. A capture offers the keys of those lengths that the list has, whatever they are.
User information before the last '@' and dots at a host's end don't count.

Captures without a URL or a fetch time, and URLs without a host, match nothing. Entries without a
key or a day are ignored; of several on one day for a key, block wins. Repeated captures come
out each, with all their columns under names that can't clash. URLs count whole, however long. Empty tables are fine on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import materialize, shield


AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, AUTHORITY + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), r"\.+$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY + r"[^/?#]*([^?#]*)", 1)


def keys_of(url: Column, labels: list[int], depths: list[int]) -> Column:
    """The last so many labels of a URL's host, and its host with the first so many path parts; null without a host."""
    names = F.split(host_of(url), r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    whole = lambda counts: F.array(*[F.lit(n) for n in counts]).cast("array<int>")
    tails = F.transform(F.filter(whole(labels), lambda n: n <= F.size(names)), lambda n: F.array_join(F.slice(names, -n, n), "."))
    heads = F.transform(F.filter(whole(depths), lambda n: n <= F.size(parts)), lambda n: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(tails, heads)))


def lengths_of(spans: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels of host keys and of parts of path keys in ``spans``."""
    labels = F.when(~F.contains("key", F.lit("/")), F.size(F.split("key", r"\.")))
    counts = spans.select(labels.alias("labels"), F.when(F.contains("key", F.lit("/")), F.size(F.split("key", "/")) - 1).alias("depth")).distinct().collect()  # a row for each length
    return sorted({r["labels"] for r in counts if r["labels"]}), sorted({r["depth"] for r in counts if r["depth"]})


def validity(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` of ``entries(key, day, action)``: each entry until the key's next one."""
    clean = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull()).groupBy(F.concat(F.regexp_replace(F.lower(F.regexp_extract("key", "^[^/]*", 0)), r"\.+$", ""), F.regexp_extract("key", "/.*$", 0)).alias("key"), "day").agg(F.max(F.coalesce("action", F.lit("block"))).alias("action"))
    return clean.select("key", "action", F.col("day").alias("since"), F.lead("day").over(W.partitionBy("key").orderBy("day")).alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``matched_key``, ``since`` and ``blocked`` added (columns of these names are replaced)."""
    names = [c for c in captures.columns if c not in ("matched_key", "since", "blocked")]
    inner, at = shield(captures.select(*names))
    rows = materialize(inner.withColumn("u_row", F.monotonically_increasing_id()), "captures")
    spans = materialize(validity(entries.select("key", "day", "action")), "spans")
    asked = rows.select("u_row", F.col(at[time_col]).alias("u_time"), F.explode(keys_of(F.col(at[url_col]), *lengths_of(spans))).alias("u_key"))
    active = (F.col("u_key") == F.col("key")) & (F.col("u_time") >= F.col("since")) & (F.col("until").isNull() | (F.col("u_time") < F.col("until")))
    best = asked.join(spans, active).groupBy(F.col("u_row").alias("b_row")).agg(F.max(F.struct(F.length("key").alias("n"), "key", "since", "action")).alias("m"))
    out = rows.join(best, F.col("u_row") == F.col("b_row"), "left")
    added = (F.col("m.key").alias("matched_key"), F.col("m.since").alias("since"), F.coalesce(F.col("m.action") == "block", F.lit(False)).alias("blocked"))
    return out.select(*inner.columns, *added).toDF(*names, "matched_key", "since", "blocked")
