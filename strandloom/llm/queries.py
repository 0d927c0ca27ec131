"""The queries opN_* and their SQL. Each applies its operator to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.stage import shared_dir

from . import media, mixing, neardup, packing, quality, rules, secrets, sharding, tokens, urlfilter


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine; the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: the day and the fate of a host follow from its MD5.

    Of 16 first digits, hosts with 0 to 7 are blocked from a day on, those with 0 to 3 allowed again 90 days
    later, those with 0 and 1 blocked again after 45 more; those with 8 and 9 are blocked on their /de pages;
    example.org is blocked as a whole for the last quarter, and hosts with f are allowed there.
    """
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digit = F.conv(F.substring(F.md5("host"), 1, 1), 16, 10).cast("int")
    first = F.date_add(F.to_date(F.lit("2024-01-01")), digit * 10)
    org = F.to_date(F.lit("2024-10-01"))
    entry = lambda when, key, day, action: F.when(when, F.struct(key.alias("key"), day.alias("day"), F.lit(action).alias("action")))
    made = F.array(
        entry(digit < 8, F.col("host"), first, "block"),
        entry(digit < 4, F.col("host"), F.date_add(first, 90), "allow"),
        entry(digit < 2, F.col("host"), F.date_add(first, 135), "block"),
        entry((digit == 8) | (digit == 9), F.concat("host", F.lit("/de")), first, "block"),
        entry(digit == 15, F.col("host"), org, "allow"),
        entry(F.col("host").endswith("example.org"), F.lit("example.org"), org, "block"),
    )
    return hosts.select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.*").distinct()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are captures fetched on a day of 2024 that follows from their id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("page_id", F.lit(366)).cast("int")))
    return urlfilter.filter_urls(captures, list_entries(pages)).select("page_id", "matched_key", F.col("since").cast("string").alias("since"), "blocked")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as mu-law; the payload's A-law, ADPCM and resampled PCM files are made, read back and digested too."""
    return media.decode_media(media.store_payloads(_documents(spark, sf_dir)), forms=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.importance_resample(_documents(spark, sf_dir), labels).withColumn("kept", F.lit(True))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary(), keep_ids=False)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions arrive in two batches; the second is scanned with the ledger of the first."""
    rows, _ = secrets.scan_arrivals(secrets.arrivals(_documents(spark, sf_dir), 2))
    kinds = {r.kind: n for n, r in enumerate(secrets.RULES)}
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kinds[kind])).cast("long")
    base = secrets.written(F.filter("spans", lambda s: s["kind"] < 3))
    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards by a hash of the id to 16 of equal bytes: placed, rewritten and read back from the files of the new version."""
    docs, path = _documents(spark, sf_dir).select("doc_id", "text"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.rewrite(docs.withColumn("old_shard", F.pmod(F.xxhash64("doc_id"), F.lit(12)).cast("int")), "old_shard", path)
    text = F.coalesce("text", F.lit(""))
    sized = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    return sharding.read_shards(spark, path).select("doc_id", *sized, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_documents(spark, sf_dir), vocabulary())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the training positions of its copies, range-sorted by the first; rows that the mix leaves out come last."""
    mixed = mixing.mix(_documents(spark, sf_dir))
    at = lambda i: F.get("positions", F.lit(i))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", at(0).alias("first_position"), at(1).alias("second_position"))
    by = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(*by).sortWithinPartitions(*by)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_media, op3_quality, op4_packing, op5_neardup, op6_secrets, op7_rules, op8_resharding, op9_token_counts, op10_mixing)}

_URL = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://"

OP1 = rf"""
WITH p AS (
  SELECT page_id, lower(rtrim(regexp_extract(url, '{_URL}(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '.')) AS host,
         list_filter(string_split(regexp_extract(url, '{_URL}[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
         DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched
  FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 1) AS INTEGER) AS d FROM p WHERE host <> ''),
e AS (
  SELECT host AS key, DATE '2024-01-01' + d * 10 AS day, 'block' AS action FROM h WHERE d < 8
  UNION SELECT host, DATE '2024-01-01' + (d * 10 + 90), 'allow' FROM h WHERE d < 4
  UNION SELECT host, DATE '2024-01-01' + (d * 10 + 135), 'block' FROM h WHERE d < 2
  UNION SELECT host || '/de', DATE '2024-01-01' + d * 10, 'block' FROM h WHERE d IN (8, 9)
  UNION SELECT host, DATE '2024-10-01', 'allow' FROM h WHERE d = 15
  UNION SELECT 'example.org', DATE '2024-10-01', 'block' FROM h WHERE host LIKE '%example.org'),
v AS (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until
      FROM (SELECT key, day, max(action) AS action FROM e GROUP BY 1, 2)),
k AS (
  SELECT page_id, fetched, unnest(list_distinct(
    list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(string_split(host, '.')[-n:], '.')),
      list_transform(range(1, len(parts) + 1), lambda n: host || '/' || array_to_string(parts[1:n], '/'))))) AS key
  FROM p WHERE host <> ''),
m AS (SELECT page_id, max({{'n': length(v.key), 'key': v.key, 'since': v.since, 'action': v.action}}) AS m
      FROM k JOIN v ON k.key = v.key AND k.fetched >= v.since AND (v.until IS NULL OR k.fetched < v.until) GROUP BY page_id)
SELECT p.page_id, m.m.key AS matched_key, CAST(m.m.since AS VARCHAR) AS since, coalesce(m.m.action = 'block', false) AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""

_WORDS = r"list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7 = rf"""
WITH a AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
b AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper,
         list_filter(string_split(t, chr(10)), lambda x: translate(x, {_SPACES}, '') <> '') AS lines, w FROM a),
x AS (SELECT r, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5),
g AS (SELECT x.r, i, array_to_string(w[i:i+4], ' ') AS s FROM x JOIN b ON x.r = b.r),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
c AS (SELECT r, CAST(sum(least(5, i - prev)) AS BIGINT) AS n_repeat_words
      FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -10) AS prev FROM d) GROUP BY r),
f AS (SELECT b.r, doc_id, lang, source, n_words, word_chars, n_symbols, n_upper, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - coalesce(len(list_distinct(lines)), 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM b LEFT JOIN c ON b.r = c.r),
m AS (
  SELECT r, lang, source, 'symbols' AS measure, 100000 * n_symbols // greatest(word_chars, 1) AS v FROM f
  UNION ALL SELECT r, lang, source, 'dup_lines', 100000 * n_dup_lines // greatest(n_lines, 1) FROM f
  UNION ALL SELECT r, lang, source, 'repeats', 100000 * n_repeat_words // greatest(n_words, 1) FROM f
  UNION ALL SELECT r, lang, source, 'upper', 100000 * n_upper // greatest(word_chars, 1) FROM f
  UNION ALL SELECT r, lang, source, 'word_length', 1000 * word_chars // greatest(n_words, 1) FROM f),
z AS (SELECT *, CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT) AS more FROM m),
s AS (SELECT lang, source, measure, more * 32 + (v >> more) AS bin, count(*) AS n FROM z GROUP BY ALL),
l AS (
  SELECT 0 AS level, lang, source, measure, bin, n FROM s
  UNION ALL SELECT 1, lang, NULL, measure, bin, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, measure, bin, sum(n) FROM s GROUP BY ALL),
k (measure, percent, times, least_far) AS (VALUES ('symbols', 75, 4, 250), ('dup_lines', 99, 1, 10000), ('repeats', 99, 1, 5000), ('upper', 75, 12, 100), ('word_length', 75, 10, 100)),
q AS (
  SELECT level, lang, source, measure, percent, times, least_far, max(total) AS total,
         min(CASE WHEN upto * 100 >= total * 50 THEN bin END) AS mid_bin, min(CASE WHEN upto * 100 >= total * percent THEN bin END) AS high_bin
  FROM (SELECT l.*, percent, times, least_far, sum(n) OVER (PARTITION BY level, lang, source, l.measure) AS total,
               sum(n) OVER (PARTITION BY level, lang, source, l.measure ORDER BY bin) AS upto FROM l JOIN k ON l.measure = k.measure) GROUP BY ALL),
e AS (SELECT *, CASE WHEN mid_bin < 64 THEN mid_bin ELSE ((mid_bin % 32 + 33) << (mid_bin // 32 - 1)) - 1 END AS mid,
             CASE WHEN high_bin < 64 THEN high_bin ELSE ((high_bin % 32 + 33) << (high_bin // 32 - 1)) - 1 END AS high FROM q),
u AS (SELECT level, lang, source, measure, total, high + times * greatest(high - mid, least_far) AS fence FROM e),
t AS (
  SELECT a.lang, a.source, a.measure, (a.total * a.fence + 200 * ((b.total * b.fence + 200 * c.fence) // (b.total + 200))) // (a.total + 200) AS fence
  FROM u a JOIN u b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure
           JOIN u c ON c.level = 2 AND a.measure = c.measure WHERE a.level = 0),
o AS (SELECT r, bool_or(v > fence) AS above FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source AND m.measure = t.measure GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT above AS kept
FROM f JOIN o ON f.r = o.r
"""

OP10 = rf"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE -0.5::DOUBLE END AS ramp, 2 * source_size AS cap FROM p),
b AS (SELECT *, 3 * sum(source_size) OVER () AS want, sum(w) OVER () AS w_all,
             coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * 2 * (w_all - w_before) < (want - 2 * cap_before) * w AS capped FROM b),
d AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS cap_sum, coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS w_sum FROM c),
t AS (SELECT source, source_size, ramp, CASE WHEN capped THEN cap::DOUBLE ELSE ((want - 2 * cap_sum) * w)::DOUBLE / (2 * (w_all - w_sum))::DOUBLE END AS target FROM d),
a AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.ramp,
             CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY h, r.doc_id, r.size, r.r) - r.size AS BIGINT) AS start
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (2 * start + size < 2 * target)::INTEGER + (2 * (start + source_size) + size < 2 * target)::INTEGER AS copies,
             ((2 * start + size) / 2.0::DOUBLE) / target AS d1, ((2 * (start + source_size) + size) / 2.0::DOUBLE) / target AS d2 FROM a)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN CASE WHEN ramp = 0 THEN d1 ELSE ((1 + ramp) - sqrt((1 + ramp) * (1 + ramp) - 4 * ramp * d1)) / (2 * ramp) END END AS first_position,
       CASE WHEN copies > 1 THEN CASE WHEN ramp = 0 THEN d2 ELSE ((1 + ramp) - sqrt((1 + ramp) * (1 + ramp) - 4 * ramp * d2)) / (2 * ramp) END END AS second_position
FROM x
"""

_KINDS = {
    "assign": r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
}
_LEAST = {"assign": 6, "access": 20, "hex": 24, "pem": 1, "jwt": 1}


def _op6() -> str:
    parts = []
    for n, (kind, pattern) in enumerate(_KINDS.items()):
        group = 1 if kind == "assign" else 0
        parts.append(f"""
  SELECT r, {n} AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS start, length(hits[i]) AS size
  FROM (SELECT r, hits, gaps, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals, regexp_split_to_array(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')))
  WHERE length(vals[i]) >= {_LEAST[kind]}""")
    name = "CASE kind " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(_KINDS)) + " END"
    word = f"{name} || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg({word}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({word}, ',' ORDER BY start, kind) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r
"""


SQL = {"op1_url_filter": OP1, "op6_secrets": _op6(), "op7_rules": OP7, "op10_mixing": OP10}
