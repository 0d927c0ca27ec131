"""Queries over the driver's tables and the SQL that says the same.

The tables hold no DNA: text is read as DNA (functions.dna.text_to_dna, here of whole Arrow batches). K-mers come out as strings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import colors as C
from strandloom.operators import compact as G
from strandloom.operators import clean, edit, kmers, payload, search, walk, windows_local
from strandloom.sources import fastx, files, gfa

from .graph import Graph
from .stage import number_rows, shared_dir, ship_texts, spread

K = 21
G_K = 31

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs


def _dna(spark: SparkSession, sf_dir: str, table: str, text: str, *keep: str) -> DataFrame:
    ship_texts(spark)
    rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keep, text))
    return rows.select(*keep, F.arrow_udf(windows_local.read_text, "string")(F.col(text)).alias("seq"))


def _documents(spark, sf_dir, *keep):
    return _dna(spark, sf_dir, "documents", "text", *keep)


def _items(spark, sf_dir):
    return _dna(spark, sf_dir, "benchmark", "text", "item_id").withColumnRenamed("item_id", "name")


def _talks(spark, sf_dir):
    return _dna(spark, sf_dir, "conversations", "text", "conv_id").withColumnRenamed("conv_id", "name")


def _read(column: str) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_replace(translate(replace(lower(coalesce({column}, '')), ' ', ''), '{letters}', '{('ACGT' * 7)[:26]}'), '[^ACGT]', 'N', 'g')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _canon(x: str) -> str:
    return f"least({x}, {_rc(x)})"


def _with(name: str, table: str, column: str, k: int, *keep: str, where: str = "true") -> str:
    """CTEs: {name}_s (keep, seq), {name}_t (keep, tile, part: tiles of 1024 starts), {name} (keep, pos, w: windows over ACGT only)."""
    cols = "".join(f"{c}, " for c in keep)
    return f"""
{name}_s AS (SELECT {cols}{_read(column)} AS seq FROM {table} WHERE {where}),
{name}_t AS (SELECT {cols}tile, substring(seq, tile + 1, 1024 + {k - 1}) AS part FROM (SELECT {cols}seq, unnest(range(0, length(seq) - {k} + 1, 1024)) AS tile FROM {name}_s)),
{name}_p AS (SELECT {cols}tile, part, unnest(range(1, length(part) - {k} + 2)) AS p FROM {name}_t),
{name} AS (SELECT {cols}tile + p - 1 AS pos, w FROM (SELECT {cols}tile, p, substring(part, p, {k}) AS w FROM {name}_p) WHERE translate(w, 'ACGT', '') = '')"""


def _docs_sql(k: int, *keep: str, where: str = "true") -> str:
    return _with("d", "documents", "text", k, *keep, where=where)


def _counts_sql(k: int, least: int = 1) -> str:
    return _docs_sql(k) + f",\nk AS MATERIALIZED (SELECT {_canon('w')} AS kmer, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= {least})"


_ITEMS = f"{_with('q', 'benchmark', 'text', K, 'item_id')},\nt AS (SELECT item_id AS name, CAST(sum(greatest(length(seq) - {K - 1}, 0)) AS BIGINT) AS n_query FROM q_s GROUP BY 1)"
_TALKS = f"{_with('q', 'conversations', 'text', K, 'conv_id')},\nt AS (SELECT conv_id AS name, CAST(sum(greatest(length(seq) - {K - 1}, 0)) AS BIGINT) AS n_query FROM q_s GROUP BY 1)"

# ---------------------------------------------------------------- sequence functions


@query(f"""WITH {_docs_sql(K, 'doc_id')} SELECT doc_id, pos, w AS kmer, {_rc('w')} AS twin, {_canon('w')} AS rep, substring(w, 2) || 'A' AS forward_a, 'T' || substring(w, 1, {K - 1}) AS backward_t,
substring(w, 5, 1) AS base_4, substring(w, 1, 4) || 'G' || substring(w, 6) AS set_4 FROM d""")
def kmer_functions(spark, sf_dir):
    """Every window with its twin, canonical form, extensions and edits, by packed arithmetic."""
    x = F.col("oriented")
    at = kmers.positioned(_documents(spark, sf_dir, "doc_id"), K, ["doc_id"])
    s = lambda c: dna.unpack(c, K)
    return at.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), s(x).alias("kmer"), s(dna.twin(x, K)).alias("twin"), s(dna.rep(x, K)).alias("rep"), s(dna.forward(x, 0, K)).alias("forward_a"), s(dna.backward(x, 3, K)).alias("backward_t"),
        F.translate(dna.base_at(x, 4, K).cast("string"), "0123", "ACGT").alias("base_4"), s(dna.set_base(x, 4, 2, K)).alias("set_4"),
    )


@query(f"WITH s AS (SELECT doc_id, {_read('text')} AS seq FROM documents) SELECT doc_id, CAST(length(seq) AS BIGINT) AS n, md5({_rc('seq')}) AS twin, translate(seq, 'ACGT', '') = '' AS is_dna FROM s")
def sequence_functions(spark, sf_dir):
    d = _documents(spark, sf_dir, "doc_id")
    return d.select("doc_id", F.char_length("seq").cast("long").alias("n"), F.md5(dna.reverse_complement(F.col("seq"))).alias("twin"), dna.is_dna(F.col("seq")).alias("is_dna"))


# ---------------------------------------------------------------- k-mers


@query(f"WITH {_counts_sql(K)} SELECT kmer, CAST(n AS BIGINT) AS n FROM k")
def kmer_count(spark, sf_dir):
    """Canonical 21-mers of all documents with their counts."""
    return kmers.count_kmers(_documents(spark, sf_dir), K).select(dna.unpack(F.col("kmer"), K).alias("kmer"), "n")


@query(f"WITH {_counts_sql(K)} SELECT count(*) AS f0, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS f1, CAST(sum(n) AS BIGINT) AS total FROM k")
def kmer_cardinality(spark, sf_dir):
    return kmers.cardinality(_documents(spark, sf_dir), K)


@query(f"WITH {_counts_sql(G_K, 2)} SELECT kmer, CAST(n AS BIGINT) AS n FROM k")
def kmer_ge2(spark, sf_dir):
    """31-mers seen twice or more: the filtered input of a graph."""
    return kmers.count_kmers(_documents(spark, sf_dir), G_K, 2).select(dna.unpack(F.col("kmer"), G_K).alias("kmer"), "n")


@query(f"WITH {_docs_sql(K)} SELECT DISTINCT {_canon('w')} AS kmer FROM d")
def kmer_distinct(spark, sf_dir):
    return kmers.distinct_kmers(_documents(spark, sf_dir), K).select(dna.unpack(F.col("kmer"), K).alias("kmer"))


@query(f"WITH {_counts_sql(K)} SELECT CAST(n AS BIGINT) AS n, count(*) AS kmers FROM k GROUP BY 1")
def kmer_histogram(spark, sf_dir):
    return kmers.spectrum(kmers.count_kmers(_documents(spark, sf_dir), K))


@query(None)
def approx_f0(spark, sf_dir):
    """Distinct k-mers estimated from one mergeable sketch a source."""
    return kmers.join_sketches(kmers.cardinality_sketch(_documents(spark, sf_dir, "source"), K, ["source"]))


@query(None)
def minimizer_counts(spark, sf_dir):
    """Distinct k-mers by minimizer: how even a partitioning by minimizer would be."""
    return kmers.minimizer_table(kmers.distinct_kmers(_documents(spark, sf_dir), K), K).select(dna.unpack(F.col("minimizer"), dna.default_g(K)).alias("minimizer"), "kmers")


# ---------------------------------------------------------------- queries without colors

_FOUND = f"f AS (SELECT q.name, count(*) AS n_found FROM (SELECT {{key}} AS name, {_canon('w')} AS kmer FROM q) q SEMI JOIN k ON q.kmer = k.kmer GROUP BY 1)"


def _found_sql(inputs: str, key: str, select: str, least: int = 2) -> str:
    return f"WITH {_counts_sql(K, least)},{inputs},\n{_FOUND.format(key=key)}\n{select}"


_COUNT = "SELECT t.name, n_query, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found FROM t LEFT JOIN f ON t.name = f.name"
_RATIO = "SELECT t.name, n_query, CASE WHEN n_query > 0 THEN coalesce(n_found, 0) / n_query ELSE 0 END AS ratio FROM t LEFT JOIN f ON t.name = f.name"
_PRESENT = "SELECT t.name, CAST(coalesce(n_found, 0) >= greatest(1, CAST(round(n_query * 0.8::DOUBLE) AS BIGINT)) AS INTEGER) AS present FROM t LEFT JOIN f ON t.name = f.name"


def _solid(spark, sf_dir, k: int = K, least: int = 2):
    return kmers.count_kmers(_documents(spark, sf_dir), k, least).select("kmer")


@query(_found_sql(_ITEMS, "item_id", _COUNT))
def query_count(spark, sf_dir):
    """For each benchmark item, how many of its 21-mers the documents' graph holds."""
    return search.search(_solid(spark, sf_dir), _items(spark, sf_dir), K).select("name", "n_query", "n_found")


@query(_found_sql(_ITEMS, "item_id", _RATIO))
def query_ratio(spark, sf_dir):
    return search.search(_solid(spark, sf_dir), _items(spark, sf_dir), K).select("name", "n_query", "ratio")


@query(_found_sql(_ITEMS, "item_id", _PRESENT))
def query_presence_80(spark, sf_dir):
    return search.presence(_solid(spark, sf_dir), _items(spark, sf_dir), K, 0.8)


@query(_found_sql(_TALKS, "conv_id", _COUNT, 1))
def query_files_count(spark, sf_dir):
    """Conversations as files, their turns as records."""
    return search.search(_solid(spark, sf_dir, least=1), _talks(spark, sf_dir), K).select("name", "n_query", "n_found")


@query(_found_sql(_TALKS, "conv_id", _RATIO, 1))
def query_files_ratio(spark, sf_dir):
    return search.search(_solid(spark, sf_dir, least=1), _talks(spark, sf_dir), K).select("name", "n_query", "ratio")


_POSITIONS = f"WITH {_counts_sql(K, 2)},{_ITEMS}\nSELECT item_id AS name, pos, {_canon('w')} AS kmer, w = {_canon('w')} AS strand FROM q SEMI JOIN k ON {_canon('w')} = k.kmer"


@query(_POSITIONS)
def query_positions(spark, sf_dir):
    """Every position of a benchmark item that lies in the graph, with its strand."""
    at = kmers.positioned(_items(spark, sf_dir), K, ["name"]).join(_solid(spark, sf_dir), "kmer", "left_semi")
    return at.select("name", F.col("pos").cast("long").alias("pos"), dna.unpack(F.col("kmer"), K).alias("kmer"), (F.col("oriented") == F.col("kmer")).alias("strand"))


# ---------------------------------------------------------------- within one edit

_SUB = f"SELECT item_id, pos, substring(w, 1, i - 1) || b || substring(w, i + 1) AS y FROM m, (SELECT unnest(range(1, {K + 1})) AS i), (SELECT unnest(['A','C','G','T']) AS b) WHERE substring(w, i, 1) <> b"
_INS = f"SELECT item_id, pos, substring(w, 1, i) || b || substring(w, i + 1, {K - 1} - i) AS y FROM m, (SELECT unnest(range(0, {K})) AS i), (SELECT unnest(['A','C','G','T']) AS b)"
_DEL = f"SELECT item_id, pos, substring(w2, 1, i - 1) || substring(w2, i + 1) AS y FROM m2, (SELECT unnest(range(1, {K + 2})) AS i)"


def _inexact_sql(*edits: str, exact: bool) -> str:
    hits = "SELECT item_id, pos FROM (" + " UNION ALL ".join(edits) + f") e SEMI JOIN k ON {_canon('y')} = k.kmer"
    if exact:
        hits += f" UNION SELECT item_id, pos FROM q SEMI JOIN k ON {_canon('w')} = k.kmer"
    return f"""WITH {_counts_sql(K, 2)},{_ITEMS},
m AS (SELECT item_id, pos, w FROM q ANTI JOIN k ON {_canon('w')} = k.kmer),
m2 AS (SELECT m.item_id, m.pos, substring(seq, m.pos + 1, {K + 1}) AS w2 FROM m JOIN q_s ON m.item_id = q_s.item_id WHERE length(seq) >= m.pos + {K + 1} AND substring(seq, m.pos + {K + 1}, 1) <> 'N'),
f AS (SELECT item_id AS name, count(DISTINCT pos) AS n_found FROM ({hits}) GROUP BY 1)
{_COUNT}"""


def _inexact(spark, sf_dir, **what):
    return search.search_inexact(_solid(spark, sf_dir), _items(spark, sf_dir), K, **what).select("name", "n_query", "n_found")


@query(_inexact_sql(_SUB, exact=False))
def inexact_sub(spark, sf_dir):
    """Positions without an exact hit that one changed base brings into the graph."""
    return _inexact(spark, sf_dir, insertion=False, deletion=False, exact=False)


@query(_inexact_sql(_INS, exact=False))
def inexact_ins(spark, sf_dir):
    return _inexact(spark, sf_dir, substitution=False, deletion=False, exact=False)


@query(_inexact_sql(_DEL, exact=False))
def inexact_del(spark, sf_dir):
    return _inexact(spark, sf_dir, substitution=False, insertion=False, exact=False)


@query(_inexact_sql(_SUB, _INS, _DEL, exact=True))
def inexact_any(spark, sf_dir):
    return _inexact(spark, sf_dir)


# ---------------------------------------------------------------- colors

_COLORS = f"""{_docs_sql(K, 'source')},
k AS MATERIALIZED (SELECT {_canon('w')} AS kmer FROM d GROUP BY 1 HAVING count(*) >= 2),
c AS MATERIALIZED (SELECT DISTINCT d.source AS color, k.kmer FROM d JOIN k ON {_canon('w')} = k.kmer)"""
_HITS = f"h AS (SELECT item_id AS name, color, count(*) AS n_found FROM q JOIN c ON {_canon('w')} = c.kmer GROUP BY 1, 2)"


def _colored(spark, sf_dir) -> DataFrame:
    return C.count_colors(_documents(spark, sf_dir, "source"), K, "source", 2)


@query(f"WITH {_COLORS} SELECT color, count(*) AS kmers FROM c GROUP BY 1")
def color_kmers(spark, sf_dir):
    """K-mers of the graph by color (source)."""
    return _colored(spark, sf_dir).groupBy("color").agg(F.count("*").alias("kmers"))


@query("SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS color_id, source AS name FROM (SELECT DISTINCT source FROM documents)")
def color_names(spark, sf_dir):
    return C.color_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")


@query(f"WITH {_COLORS} SELECT n_colors, count(*) AS kmers FROM (SELECT kmer, count(*) AS n_colors FROM c GROUP BY 1) GROUP BY 1")
def color_sharing(spark, sf_dir):
    return C.colors_per_kmer(_colored(spark, sf_dir))


@query(f"WITH {_COLORS},{_ITEMS},\n{_HITS}\nSELECT h.name, color, n_query, CAST(n_found AS BIGINT) AS n_found FROM h JOIN t ON h.name = t.name")
def color_count(spark, sf_dir):
    return search.search_colors(_colored(spark, sf_dir), _items(spark, sf_dir), K).select("name", "color", "n_query", "n_found")


@query(f"WITH {_COLORS},{_ITEMS},\n{_HITS}\nSELECT h.name, color, n_found / n_query AS ratio FROM h JOIN t ON h.name = t.name")
def color_ratio(spark, sf_dir):
    return search.search_colors(_colored(spark, sf_dir), _items(spark, sf_dir), K).select("name", "color", "ratio")


def _inexact_colors_sql() -> str:
    hits = " UNION ALL ".join([f"SELECT item_id, pos, w AS y FROM q", _SUB, _INS, _DEL])
    return f"""WITH {_COLORS},{_ITEMS},
m AS (SELECT item_id, pos, w FROM q),
m2 AS (SELECT q.item_id, q.pos, substring(seq, q.pos + 1, {K + 1}) AS w2 FROM q JOIN q_s ON q.item_id = q_s.item_id WHERE length(seq) >= q.pos + {K + 1} AND substring(seq, q.pos + {K + 1}, 1) <> 'N'),
h AS (SELECT item_id AS name, color, count(DISTINCT pos) AS n_found FROM ({hits}) e JOIN c ON {_canon('y')} = c.kmer GROUP BY 1, 2)
SELECT h.name, color, n_query, CAST(n_found AS BIGINT) AS n_found FROM h JOIN t ON h.name = t.name"""


@query(_inexact_colors_sql())
def color_inexact(spark, sf_dir):
    """Positions of each benchmark item that hit a color exactly or by one edit."""
    return search.search_colors_inexact(_colored(spark, sf_dir), _items(spark, sf_dir), K).select("name", "color", "n_query", "n_found")


SOURCES = [f"src{i}" for i in range(20)]


def _colors_of(spark, sf_dir) -> list:
    """The table's sources, a null one last; shorter names first, so that numbered ones are in the order of their numbers."""
    names = [r.name for r in C.color_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source").collect()]  # one row a source
    return sorted(names, key=lambda c: (c is None, len(c or ""), c or ""))


def _matrix(value: str, kind: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN color = '{s}' THEN {value} END), 0) AS {kind}) AS {s}" for s in SOURCES)


@query(f"WITH {_COLORS},{_ITEMS},\n{_HITS}\nSELECT t.name, {_matrix('n_found', 'BIGINT')} FROM t LEFT JOIN h ON t.name = h.name GROUP BY 1")
def color_count_matrix(spark, sf_dir):
    """The result matrix: a row a query, a column a color (each source of the table)."""
    items = _items(spark, sf_dir)
    return search.color_matrix(search.search_colors(_colored(spark, sf_dir), items, K), items, _colors_of(spark, sf_dir))


_PRESENT_COLORS = "p AS (SELECT h.name, color FROM h JOIN t ON h.name = t.name WHERE n_found >= greatest(1, CAST(round(n_query * 0.5::DOUBLE) AS BIGINT)))"


@query(f"WITH {_COLORS},{_ITEMS},\n{_HITS},\n{_PRESENT_COLORS}\nSELECT name, color FROM p")
def color_presence(spark, sf_dir):
    return search.color_presence(_colored(spark, sf_dir), _items(spark, sf_dir), K, 0.5)


@query(f"WITH {_COLORS},{_ITEMS},\n{_HITS},\n{_PRESENT_COLORS.replace('0.5::', '0.01::')}\nSELECT name, color FROM p")
def color_presence_some(spark, sf_dir):
    """Colors that hold a hundredth of an item's k-mers, and one at least."""
    return search.color_presence(_colored(spark, sf_dir), _items(spark, sf_dir), K, 0.01)


@query(f"WITH {_COLORS},{_ITEMS},\n{_HITS},\n{_PRESENT_COLORS}\nSELECT t.name, {_matrix('1', 'INTEGER')} FROM t LEFT JOIN p ON t.name = p.name GROUP BY 1")
def color_presence_matrix(spark, sf_dir):
    """1 where a color has half of a query's k-mers or more, else 0."""
    items = _items(spark, sf_dir)
    there = search.color_presence(_colored(spark, sf_dir), items, K, 0.5).withColumn("there", F.lit(1))
    return search.color_matrix(there, items, _colors_of(spark, sf_dir), "there")


@query(f"""WITH {_COLORS},{_ITEMS},\n{_HITS},\n{_PRESENT_COLORS}
SELECT t.name, coalesce(n, 0) AS n_colors, CAST(coalesce(n, 0) >= 2 AS INTEGER) AS present FROM t LEFT JOIN (SELECT name, count(*) AS n FROM p GROUP BY 1) p ON t.name = p.name""")
def color_presence_min2(spark, sf_dir):
    return search.presence_in_colors(_colored(spark, sf_dir), _items(spark, sf_dir), K, 0.5, 2)


@query(f"WITH {_COLORS} SELECT kmer FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT color) FROM c)")
def core_kmers(spark, sf_dir):
    """K-mers that every color has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.agg((F.countDistinct("source") + F.coalesce(F.max(F.col("source").isNull().cast("int")), F.lit(0))).alias("n_all"))  # a null source is a color too
    each = _colored(spark, sf_dir).groupBy("kmer").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(n), F.col("n") == F.col("n_all")).select(dna.unpack(F.col("kmer"), K).alias("kmer"))  # one row


@query(f"""WITH {_COLORS} SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1""")
def color_bitmaps(spark, sf_dir):
    """Size of each k-mer's color set, counted in its bitmap."""
    from strandloom.operators.colors import color_table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = _colored(spark, sf_dir).join(color_table(docs, "source"), F.col("color").eqNullSafe(F.col("name"))).select("kmer", "color_id")
    maps = C.color_bitmaps(ids).groupBy("kmer").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
    return maps.select(dna.unpack(F.col("kmer"), K).alias("kmer"), "n")


# ---------------------------------------------------------------- edges and unitigs

_ORI = f"o AS MATERIALIZED (SELECT kmer AS x FROM k UNION SELECT {_rc('kmer')} FROM k)"


def _edges_sql(k: int, least: int) -> str:
    return f"{_counts_sql(k, least)},\n{_ORI},\ne AS MATERIALIZED (SELECT a.x, b.x AS y FROM o a JOIN o b ON substring(a.x, 2) = substring(b.x, 1, {k - 1}))"


ROUNDS = 11


def _unitigs_sql(kmers_sql: str, k: int, prefix: str = "") -> str:
    """CTEs up to {prefix}u(head, seq, n_kmers, is_cycle) from k(kmer); paths of up to 2^ROUNDS k-mers."""
    p = prefix
    out = [kmers_sql] if kmers_sql else []
    out.append(f"{p}o AS MATERIALIZED (SELECT kmer AS x FROM {p}k UNION SELECT {_rc('kmer')} FROM {p}k)")
    out.append(f"{p}j AS (SELECT j, count(l) AS nl, count(r) AS nr, min(l) AS l, min(r) AS r FROM (SELECT substring(x, 2) AS j, x AS l, NULL AS r FROM {p}o UNION ALL SELECT substring(x, 1, {k - 1}), NULL, x FROM {p}o) GROUP BY 1)")
    out.append(f"{p}l AS MATERIALIZED (SELECT l AS a, r AS b FROM {p}j WHERE nl = 1 AND nr = 1 AND {_canon('l')} <> {_canon('r')})")
    out.append(f"{p}p0 AS MATERIALIZED (SELECT b AS x, a AS p, 1 AS d, least(a, b) AS m FROM {p}l)")
    for i in range(ROUNDS):
        out.append(f"{p}p{i + 1} AS MATERIALIZED (SELECT s.x, coalesce(t.p, s.p) AS p, s.d + coalesce(t.d, 0) AS d, least(s.m, coalesce(t.m, s.m)) AS m FROM {p}p{i} s LEFT JOIN {p}p{i} t ON s.p = t.x)")
    last = f"{p}p{ROUNDS}"
    out.append(f"{p}ring AS MATERIALIZED (SELECT x, m FROM {last} SEMI JOIN {p}p0 ON {last}.p = {p}p0.x)")
    out.append(f"{p}own AS MATERIALIZED (SELECT a.x, a.m FROM {p}ring a JOIN {p}ring b ON a.x = {_rc('b.x')} WHERE a.m < b.m)")
    out.append(f"{p}c0 AS MATERIALIZED (SELECT b AS x, a AS p, 1 AS d FROM {p}l JOIN {p}own ON b = {p}own.x WHERE b <> m)")
    for i in range(ROUNDS):
        out.append(f"{p}c{i + 1} AS MATERIALIZED (SELECT s.x, coalesce(t.p, s.p) AS p, s.d + coalesce(t.d, 0) AS d FROM {p}c{i} s LEFT JOIN {p}c{i} t ON s.p = t.x)")
    out.append(f"""{p}mem AS MATERIALIZED (
  SELECT p AS head, d, x, false AS is_cycle FROM {last} ANTI JOIN {p}ring ON {last}.x = {p}ring.x
  UNION ALL SELECT DISTINCT p, 0, p, false FROM {last} ANTI JOIN {p}ring ON {last}.x = {p}ring.x
  UNION ALL SELECT p, d, x, true FROM {p}c{ROUNDS} UNION ALL SELECT x, 0, x, true FROM {p}own WHERE x = m
  UNION ALL SELECT kmer, 0, kmer, false FROM {p}k WHERE kmer NOT IN (SELECT x FROM {p}p0 UNION ALL SELECT p FROM {p}p0 UNION ALL SELECT {_rc('x')} FROM {p}p0 UNION ALL SELECT {_rc('p')} FROM {p}p0))""")
    out.append(f"""{p}u AS MATERIALIZED (SELECT * FROM (
  SELECT head, head || coalesce(string_agg(right(x, 1), '' ORDER BY d) FILTER (d > 0), '') AS seq, CAST(count(*) AS INTEGER) AS n_kmers, bool_or(is_cycle) AS is_cycle, arg_max(x, d) AS tail
  FROM {p}mem GROUP BY head) WHERE is_cycle OR n_kmers = 1 OR head < {_rc('tail')})""")
    return ",\n".join(out)


def _graph(spark, sf_dir, k: int = G_K, least: int = 2) -> Graph:
    return Graph.build(k, seq=_documents(spark, sf_dir), min_count=least)


_U31 = _unitigs_sql(_counts_sql(G_K, 2), G_K)


@query(f"WITH {_edges_sql(G_K, 2)} SELECT x, y FROM e")
def kmer_edges(spark, sf_dir):
    """Edges of the de Bruijn graph between oriented 31-mers."""
    e = G.kmer_edges(_solid(spark, sf_dir, G_K), G_K)
    return e.select(dna.unpack(F.col("x"), G_K).alias("x"), dna.unpack(F.col("y"), G_K).alias("y"))


@query(f"WITH {_edges_sql(G_K, 2)} SELECT n_out, count(*) AS kmers FROM (SELECT o.x, count(y) AS n_out FROM o LEFT JOIN e ON o.x = e.x GROUP BY 1) GROUP BY 1")
def degree_hist(spark, sf_dir):
    """Oriented 31-mers by number of successors."""
    solid = Graph(G_K, _solid(spark, sf_dir, G_K)).kmers
    n = G.kmer_edges(solid, G_K).groupBy("x").agg(F.count("*").alias("n"))
    every = G.oriented(solid, G_K)
    return every.join(n, "x", "left").select(F.coalesce("n", F.lit(0)).alias("n_out")).groupBy("n_out").agg(F.count("*").alias("kmers"))


@query(f"WITH {_U31} SELECT seq, n_kmers, is_cycle FROM u")
def unitigs(spark, sf_dir):
    """Unitigs of the graph of 31-mers seen twice or more."""
    return _graph(spark, sf_dir).unitigs.select("seq", "n_kmers", "is_cycle")


@query(f"WITH {_U31} SELECT count(*) AS unitigs, CAST(sum(n_kmers) AS BIGINT) AS kmers, CAST(sum(length(seq)) AS BIGINT) AS length, CAST(sum(is_cycle::INTEGER) AS BIGINT) AS cycles, max(n_kmers) AS longest FROM u")
def unitig_stats(spark, sf_dir):
    return _graph(spark, sf_dir).stats()


@query(f"WITH {_U31} SELECT CAST(n_kmers AS BIGINT) AS n_kmers, count(*) AS unitigs FROM u GROUP BY 1")
def unitig_lengths(spark, sf_dir):
    return _graph(spark, sf_dir).unitigs.groupBy(F.col("n_kmers").cast("long").alias("n_kmers")).agg(F.count("*").alias("unitigs"))


def _ends_sql(k: int, u: str = "u") -> str:
    return f"""z AS MATERIALIZED (SELECT head AS id, '+' AS s, right(seq, {k - 1}) AS o, left(seq, {k - 1}) AS i FROM {u} UNION ALL SELECT head, '-', {_rc(f'left(seq, {k - 1})')}, {_rc(f'right(seq, {k - 1})')} FROM {u}),
ue AS MATERIALIZED (SELECT a.id AS src, a.s AS src_strand, b.id AS dst, b.s AS dst_strand FROM z a JOIN z b ON a.o = b.i),
dg AS MATERIALIZED (SELECT u.head, u.seq, u.n_kmers, coalesce(n, 0) AS n FROM {u} u LEFT JOIN (SELECT src, count(*) AS n FROM ue GROUP BY 1) ue ON u.head = ue.src)"""


@query(f"WITH {_U31},\n{_ends_sql(G_K)} SELECT src, src_strand, dst, dst_strand FROM ue")
def unitig_edges(spark, sf_dir):
    """Edges between unitigs, each named by its first k-mer."""
    g = _graph(spark, sf_dir)
    heads = g.unitigs.select("unitig_id", dna.unpack(F.col("head"), G_K).alias("h"))
    a = heads.select(F.col("unitig_id").alias("src"), F.col("h").alias("a"))
    b = heads.select(F.col("unitig_id").alias("dst"), F.col("h").alias("b"))
    return g.edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), "src_strand", F.col("b").alias("dst"), "dst_strand")


@query(f"WITH {_U31},\n{_ends_sql(G_K)} SELECT seq FROM dg WHERE n = 1 AND n_kmers < {G_K}")
def tips(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.unitigs.join(clean.to_remove(g.unitigs, g.edges, G_K, clip_tips=True), "unitig_id", "left_semi").select("seq")


@query(f"WITH {_U31},\n{_ends_sql(G_K)} SELECT seq FROM dg WHERE n = 0 AND n_kmers < {G_K}")
def isolated(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.unitigs.join(clean.to_remove(g.unitigs, g.edges, G_K, delete_isolated=True), "unitig_id", "left_semi").select("seq")


def _simplified_sql(wanted: str) -> str:
    left = f"vk AS MATERIALIZED (SELECT {_canon('x')} AS kmer FROM mem SEMI JOIN (SELECT head FROM dg WHERE NOT (n IN ({wanted}) AND n_kmers < {G_K})) d ON mem.head = d.head)"
    return f"WITH {_U31},\n{_ends_sql(G_K)},\n{left},\n{_unitigs_sql('', G_K, 'v')} SELECT seq, n_kmers, is_cycle FROM vu"


def _simplified(spark, sf_dir, clip, lone):
    return _graph(spark, sf_dir).simplify(clip, lone).unitigs.select("seq", "n_kmers", "is_cycle")


@query(_simplified_sql("1"))
def simplify_clip(spark, sf_dir):
    return _simplified(spark, sf_dir, True, False)


@query(_simplified_sql("0"))
def simplify_isolated(spark, sf_dir):
    return _simplified(spark, sf_dir, False, True)


@query(_simplified_sql("0, 1"))
def simplify_both(spark, sf_dir):
    return _simplified(spark, sf_dir, True, True)


# ---------------------------------------------------------------- editing


def _side(name: str, where: str) -> str:
    return f"{_with(name, 'documents', 'text', G_K, where=where)},\n{name}k AS MATERIALIZED (SELECT {_canon('w')} AS kmer FROM {name} GROUP BY 1 HAVING count(*) >= 2)"


_EN, _REST = "lang = 'en'", "lang IS DISTINCT FROM 'en'"
_TWO = f"{_side('a', _EN)},\n{_side('b', _REST)}"


def _two(spark, sf_dir):
    docs = _documents(spark, sf_dir, "lang")
    en = F.col("lang").eqNullSafe("en")
    return Graph.build(G_K, seq=docs.where(en)), Graph.build(G_K, seq=docs.where(~en))


@query(f"WITH {_TWO},\nk AS MATERIALIZED (SELECT kmer FROM ak UNION SELECT kmer FROM bk),\n{_unitigs_sql('', G_K)} SELECT seq, n_kmers, is_cycle FROM u")
def merge_two_sources(spark, sf_dir):
    """The graphs of the English and the other documents, merged and compacted."""
    a, b = _two(spark, sf_dir)
    return a.merge(b).unitigs.select("seq", "n_kmers", "is_cycle")


@query(f"WITH {_TWO} SELECT (SELECT count(*) FROM ak ANTI JOIN bk ON ak.kmer = bk.kmer) AS only_a, (SELECT count(*) FROM bk ANTI JOIN ak ON ak.kmer = bk.kmer) AS only_b")
def graph_equal(spark, sf_dir):
    """K-mers of one graph only: none on both sides exactly if the graphs are equal."""
    a, b = _two(spark, sf_dir)
    return edit.difference_size(a.kmers, b.kmers)


@query(f"WITH {_TWO} SELECT 'intersect' AS op, count(*) AS n FROM ak SEMI JOIN bk ON ak.kmer = bk.kmer UNION ALL SELECT 'subtract', count(*) FROM ak ANTI JOIN bk ON ak.kmer = bk.kmer")
def graph_set_ops(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(edit.intersect(a.kmers, b.kmers), "intersect").union(n(edit.subtract(a.kmers, b.kmers), "subtract"))


_ADDED = f"{_counts_sql(G_K, 2).replace('k AS MATERIALIZED', 'dk AS MATERIALIZED')},{_with('q', 'benchmark', 'text', G_K)}"


@query(f"WITH {_ADDED},\nk AS MATERIALIZED (SELECT kmer FROM dk UNION SELECT {_canon('w')} FROM q),\n{_unitigs_sql('', G_K)} SELECT seq, n_kmers, is_cycle FROM u")
def add_sequence(spark, sf_dir):
    """The graph with the benchmark items added, whatever their k-mers' counts."""
    return _graph(spark, sf_dir).add(_items(spark, sf_dir)).unitigs.select("seq", "n_kmers", "is_cycle")


@query(f"WITH {_ADDED},\nk AS MATERIALIZED (SELECT kmer FROM dk EXCEPT SELECT {_canon('w')} FROM q),\n{_unitigs_sql('', G_K)} SELECT seq, n_kmers, is_cycle FROM u")
def remove_sequence(spark, sf_dir):
    return _graph(spark, sf_dir).remove(_items(spark, sf_dir)).unitigs.select("seq", "n_kmers", "is_cycle")


@query(f"WITH {_U31},\nvk AS MATERIALIZED (SELECT {_canon('x')} AS kmer FROM mem SEMI JOIN (SELECT head FROM u WHERE n_kmers >= 32) d ON mem.head = d.head),\n{_unitigs_sql('', G_K, 'v')} SELECT seq, n_kmers, is_cycle FROM vu")
def remove_unitig(spark, sf_dir):
    """The graph without its unitigs of fewer than 32 k-mers."""
    g = _graph(spark, sf_dir)
    return g.remove_unitigs(g.unitigs.where("n_kmers < 32")).unitigs.select("seq", "n_kmers", "is_cycle")


_PAGES = f"{_counts_sql(G_K, 2).replace('k AS MATERIALIZED', 'dk AS MATERIALIZED')},{_with('q', 'pages', 'html', G_K)},\nqk AS (SELECT {_canon('w')} AS kmer FROM q GROUP BY 1 HAVING count(*) >= 2)"


@query(f"WITH {_PAGES} SELECT count(*) AS kmers FROM (SELECT kmer FROM dk UNION SELECT kmer FROM qk)")
def update_with_pages(spark, sf_dir):
    """The graph updated with new inputs: the pages, filtered on their own."""
    pages = _dna(spark, sf_dir, "pages", "html")
    return _graph(spark, sf_dir).update(seq=pages).kmers.agg(F.count("*").alias("kmers"))


@query(f"""WITH {_docs_sql(G_K, 'lang')},
k AS (SELECT DISTINCT {_canon('w')} AS kmer, lang FROM d), l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents))
SELECT CAST(id + side * 100 AS INTEGER) AS color_id, count(*) AS kmers FROM k JOIN l ON k.lang = l.lang, (SELECT unnest([0, 1]) AS side) GROUP BY 1""")
def merge_colors(spark, sf_dir):
    """A colored graph merged with itself: the colors of the second are appended."""
    docs = _documents(spark, sf_dir, "lang")
    pairs = kmers.kmers(docs, G_K, keep=["lang"]).distinct().join(C.color_table(docs, "lang"), F.col("lang") == F.col("name")).select("kmer", "color_id")
    return edit.merge_colors(pairs, pairs, 100).groupBy("color_id").agg(F.count("*").alias("kmers"))


@query(None)
def checksum(spark, sf_dir):
    return edit.checksum(_solid(spark, sf_dir, G_K))


# ---------------------------------------------------------------- mappings

_FINDS = f"""{_with('q', 'benchmark', 'text', G_K, 'item_id')},
f AS (SELECT item_id, pos, mem.head, mem.d, w = mem.x AS strand FROM q JOIN (SELECT mem.* FROM mem SEMI JOIN u ON mem.head = u.head) mem ON {_canon('w')} = {_canon('mem.x')})"""


_MAPPED = f"{_U31},{_FINDS}"


@query(f"WITH {_MAPPED} SELECT item_id AS name, pos, head, CAST(d AS BIGINT) AS dist, strand FROM f")
def find_kmers(spark, sf_dir):
    """Where each 31-mer of the benchmark items lies: unitig (by its first k-mer), place and strand."""
    g = _graph(spark, sf_dir)
    heads = g.unitigs.select("unitig_id", dna.unpack(F.col("head"), G_K).alias("head"))
    return g.find(_items(spark, sf_dir)).join(heads, "unitig_id").select("name", F.col("pos").cast("long").alias("pos"), "head", F.col("dist").cast("long").alias("dist"), "strand")


@query(f"WITH {_MAPPED} SELECT item_id AS name, pos, f.head, CAST(d AS BIGINT) AS dist, strand FROM f JOIN u ON f.head = u.head WHERE d = 0 OR d = n_kmers - 1")
def find_ends(spark, sf_dir):
    g = _graph(spark, sf_dir)
    heads = g.unitigs.select("unitig_id", dna.unpack(F.col("head"), G_K).alias("head"))
    return g.find(_items(spark, sf_dir), ends_only=True).join(heads, "unitig_id").select("name", F.col("pos").cast("long").alias("pos"), "head", F.col("dist").cast("long").alias("dist"), "strand")


_RUN = """
g AS (SELECT item_id, pos, head, d, strand, CASE WHEN strand THEN pos - d ELSE pos + d END AS diag FROM f),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY item_id, head, strand, diag ORDER BY pos) AS run FROM g),
m AS (SELECT item_id AS name, min(pos) AS pos, head, CAST(min(d) AS BIGINT) AS dist, count(*) AS len, strand FROM r GROUP BY item_id, head, strand, diag, run)"""
_RUNS = f"{_MAPPED},{_RUN}"


@query(f"WITH {_RUNS} SELECT name, pos, head, dist, len, strand FROM m")
def mapping_runs(spark, sf_dir):
    """Maximal runs of the benchmark items along unitigs."""
    g = _graph(spark, sf_dir)
    heads = g.unitigs.select("unitig_id", dna.unpack(F.col("head"), G_K).alias("head"))
    return g.mappings(_items(spark, sf_dir)).join(heads, "unitig_id").select("name", F.col("pos").cast("long").alias("pos"), "head", F.col("dist").cast("long").alias("dist"), "len", "strand")


_PIECE = f"substring(u.seq, CAST(dist + 1 AS BIGINT), CAST(len + {G_K - 1} AS BIGINT))"


@query(f"""WITH {_RUNS}, x AS (SELECT name, pos, CASE WHEN strand THEN {_PIECE} ELSE {_rc(_PIECE)} END AS mapped, left(u.seq, {G_K}) AS head, right(u.seq, {G_K}) AS tail, dist = 0 AND len = n_kmers AS whole FROM m JOIN u ON m.head = u.head)
SELECT name, pos, mapped, left(mapped, {G_K}) AS mapped_head, right(mapped, {G_K}) AS mapped_tail, head, tail, whole FROM x""")
def mapping_accessors(spark, sf_dir):
    """Sequence, ends and unitig ends of each mapping."""
    g = _graph(spark, sf_dir)
    return g.accessors(g.mappings(_items(spark, sf_dir))).select("name", F.col("pos").cast("long").alias("pos"), "mapped", "mapped_head", "mapped_tail", "head", "tail", "whole")


# ---------------------------------------------------------------- unitigs with data and colors

_UDATA = f"{_U31}, w AS (SELECT u.head, u.seq, u.n_kmers, mem.x, mem.d FROM u JOIN mem ON u.head = mem.head)"


@query(f"WITH {_UDATA} SELECT seq, CAST(sum(n) AS BIGINT) AS total, min(n) >= 3 AS is_full FROM w JOIN k ON {_canon('w.x')} = k.kmer GROUP BY 1")
def unitig_coverage(spark, sf_dir):
    """Summed k-mer counts of each unitig, and whether each k-mer is seen three times or more."""
    counts = kmers.count_kmers(_documents(spark, sf_dir), G_K, 2)
    g = Graph(G_K, counts.select("kmer"))
    return payload.coverage(g.index, counts, 3).join(g.unitigs.select("unitig_id", "seq"), "unitig_id").select("seq", "total", "is_full")


@query(f"WITH {_UDATA} SELECT seq, CAST(max(n) AS BIGINT) AS most FROM w JOIN k ON {_canon('w.x')} = k.kmer GROUP BY 1")
def unitig_data(spark, sf_dir):
    """User data merged over the k-mers of a unitig: here the highest count."""
    counts = kmers.count_kmers(_documents(spark, sf_dir), G_K, 2).withColumnRenamed("n", "most")
    g = Graph(G_K, counts.select("kmer"))
    return g.with_data(counts, payload.Payload("most", F.max("most"), 0)).select("seq", "most")


_UCOLORS = f"""{_docs_sql(G_K, 'lang')},
k AS MATERIALIZED (SELECT {_canon('w')} AS kmer FROM d GROUP BY 1 HAVING count(*) >= 2),
{_unitigs_sql('', G_K)},
c AS (SELECT DISTINCT lang AS color, {_canon('w')} AS kmer FROM d)"""


@query(f"WITH {_UCOLORS} SELECT seq, color, count(*) AS n, count(*) = max(n_kmers) AS \"full\" FROM u JOIN mem ON u.head = mem.head JOIN c ON {_canon('mem.x')} = c.kmer GROUP BY 1, 2")
def unitig_colors(spark, sf_dir):
    """Colors (languages) of each unitig, and whether all its k-mers have them."""
    docs = _documents(spark, sf_dir, "lang")
    g = Graph.build(G_K, seq=docs, color_col="lang")
    return C.unitig_colors(g.index, g.colors).join(g.unitigs.select("unitig_id", "seq"), "unitig_id").select("seq", "color", "n", "full")


_MCOLORS = f"""{_UCOLORS},{_FINDS},{_RUN},
mc AS (SELECT m.name, m.pos, m.head, m.dist, m.len, m.strand, color, count(*) AS n
  FROM m JOIN mem ON m.head = mem.head AND mem.d >= m.dist AND mem.d < m.dist + m.len JOIN c ON {_canon('mem.x')} = c.kmer GROUP BY ALL)"""


def _mapping_colors(spark, sf_dir, every: bool):
    docs = _documents(spark, sf_dir, "lang")
    g = Graph.build(G_K, seq=docs, color_col="lang")
    heads = g.unitigs.select("unitig_id", dna.unpack(F.col("head"), G_K).alias("head"))
    found = C.mapping_colors(g.index, g.colors, g.mappings(_items(spark, sf_dir)), every)
    return found.join(heads, "unitig_id").select("name", F.col("pos").cast("long").alias("pos"), "head", F.col("dist").cast("long").alias("dist"), "len", "strand", "color")


@query(f"WITH {_MCOLORS} SELECT name, pos, head, dist, len, strand, color FROM mc")
def mapping_colors(spark, sf_dir):
    """Colors on some k-mer of each mapping of the benchmark items."""
    return _mapping_colors(spark, sf_dir, False)


@query(f"WITH {_MCOLORS} SELECT name, pos, head, dist, len, strand, color FROM mc WHERE n = len")
def mapping_colors_every(spark, sf_dir):
    """Colors on every k-mer of each mapping."""
    return _mapping_colors(spark, sf_dir, True)


@query(None)
def find_minimizers(spark, sf_dir):
    """Unitigs and places that the minimizers of the benchmark items lead to; tested against brute force."""
    g = _graph(spark, sf_dir)
    asked = kmers.distinct_kmers(_items(spark, sf_dir), G_K).select(dna.minimizer(F.col("kmer"), G_K, g.g).alias("minimizer"))
    return g.find_minimizers(asked).select(dna.unpack(F.col("minimizer"), g.g).alias("minimizer"), "unitig_id", "pos")


# ---------------------------------------------------------------- files, written and read again


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH s AS (SELECT doc_id, {_read('text')} AS seq FROM documents) SELECT CAST(doc_id AS VARCHAR) AS name, CAST(length(seq) AS BIGINT) AS n, md5(seq) AS seq FROM s")
def fasta_round_trip(spark, sf_dir):
    """All documents as gzipped FASTA, scanned again."""
    path = _folder(spark, "fasta")
    fastx.write_fasta(_documents(spark, sf_dir, "doc_id"), path, "doc_id")
    return fastx.read_fasta(spark, path).select("name", F.char_length("seq").cast("long").alias("n"), F.md5("seq").alias("seq"))


@query(f"WITH s AS (SELECT doc_id, {_read('text')} AS seq FROM documents) SELECT CAST(doc_id AS VARCHAR) AS name, md5(seq) AS seq, md5(translate(seq, 'ACGTN', '@ABC#')) AS qual FROM s")
def fastq_round_trip(spark, sf_dir):
    """All documents as FASTQ, a quarter of the qualities beginning with '@', scanned again."""
    path = _folder(spark, "fastq")
    d = _documents(spark, sf_dir, "doc_id")
    d.select(F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), F.translate("seq", "ACGTN", "@ABC#"))).write.text(path)
    return fastx.read_fastq(spark, path).select("name", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query(f"WITH {_U31} SELECT seq, n_kmers, is_cycle FROM u")
def gfa_round_trip(spark, sf_dir):
    """The graph as gzipped GFA, read again and compacted."""
    path = _folder(spark, "gfa")
    _graph(spark, sf_dir).to_gfa(path)
    segments, _, tags = gfa.read_gfa(spark, path)
    return Graph.from_segments(segments, int(tags["KL"]), int(tags["ML"])).unitigs.select("seq", "n_kmers", "is_cycle")


@query(f"WITH {_UCOLORS} SELECT seq, color, count(*) AS n, count(*) = max(n_kmers) AS \"full\" FROM u JOIN mem ON u.head = mem.head JOIN c ON {_canon('mem.x')} = c.kmer GROUP BY 1, 2")
def graph_round_trip(spark, sf_dir):
    """The colored graph saved with its index and colors, and loaded as it was."""
    path = _folder(spark, "graph")
    Graph.build(G_K, seq=_documents(spark, sf_dir, "lang"), color_col="lang").save(path)
    g = Graph.load(spark, path)
    return C.unitig_colors(g.index, g.colors).join(g.unitigs.select("unitig_id", "seq"), "unitig_id").select("seq", "color", "n", "full")


@query(_found_sql(_ITEMS, "item_id", _COUNT))
def tsv_round_trip(spark, sf_dir):
    """A query's result as tab-separated text, read again."""
    path = _folder(spark, "tsv")
    files.write_tsv(query_count(spark, sf_dir), path)
    return spark.read.option("sep", "\t").option("header", True).csv(path, schema="name bigint, n_query bigint, n_found bigint")


# ---------------------------------------------------------------- output formats and walks


@query(f"""WITH {_U31},\n{_ends_sql(G_K)},
i AS (SELECT head, seq, row_number() OVER (ORDER BY {_canon('head')}) AS n FROM u)
SELECT 'H' || chr(9) || 'VN:Z:1.0' || chr(9) || 'BV:Z:1.0' || chr(9) || 'KL:Z:{G_K}' || chr(9) || 'ML:Z:{dna.default_g(G_K)}' AS value
UNION ALL SELECT 'S' || chr(9) || n || chr(9) || seq FROM i
UNION ALL SELECT 'L' || chr(9) || a.n || chr(9) || src_strand || chr(9) || b.n || chr(9) || dst_strand || chr(9) || '{G_K - 1}M' FROM ue JOIN i a ON src = a.head JOIN i b ON dst = b.head""")
def gfa_lines(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return gfa.gfa_lines(g.unitigs, g.edges, G_K, g.g).select("value")


@query(f"WITH {_U31} SELECT '>' || (row_number() OVER (ORDER BY {_canon('head')}) - 1) || chr(10) || seq AS value FROM u")
def fasta_lines(spark, sf_dir):
    return fastx.fasta_lines(number_rows(_graph(spark, sf_dir).unitigs, ["unitig_id"], "number")).select("value")


@query(f"""WITH RECURSIVE {_U31},\n{_ends_sql(G_K)},
r AS (SELECT head AS id, {_canon('head')} AS c FROM u),
walk AS (SELECT id, c FROM r UNION SELECT ue.dst, walk.c FROM walk JOIN ue ON walk.id = ue.src)
SELECT seq, component FROM (SELECT id, min(c) AS component FROM walk GROUP BY 1) w JOIN u ON u.head = w.id""")
def components(spark, sf_dir):
    """Connected components, each named by its least canonical first k-mer."""
    g = _graph(spark, sf_dir)
    return g.components().join(g.unitigs.select("unitig_id", "seq"), "unitig_id").select("seq", dna.unpack(F.col("component"), G_K).alias("component"))


@query(f"""WITH RECURSIVE {_U31},\n{_ends_sql(G_K)},
walk AS (SELECT head AS id, 0 AS level FROM u WHERE {_canon('head')} = (SELECT min({_canon('head')}) FROM u JOIN dg USING (head) WHERE n > 1)
  UNION SELECT ue.dst, level + 1 FROM walk JOIN ue ON walk.id = ue.src WHERE level < 6)
SELECT seq, CAST(min(level) AS BIGINT) AS level FROM walk JOIN u ON u.head = walk.id GROUP BY 1""")
def bfs_levels(spark, sf_dir):
    """Breadth-first levels around the first unitig with two neighbours or more. The SQL ends at level 6, the query does not."""
    g = _graph(spark, sf_dir)
    start = g.degrees().where("n_in + n_out > 1").agg(F.min("unitig_id").alias("unitig_id"))
    return walk.bfs(g.edges, start).join(g.unitigs.select("unitig_id", "seq"), "unitig_id").select("seq", F.col("level").cast("long").alias("level"))


@query(f"WITH {_U31},\n{_ends_sql(G_K)} SELECT src, src_strand, dst AS neighbour, dst_strand AS neighbour_strand FROM ue WHERE src_strand = '+'")
def successors(spark, sf_dir):
    """Successors of every unitig on its forward strand."""
    g = _graph(spark, sf_dir)
    heads = g.unitigs.select("unitig_id", dna.unpack(F.col("head"), G_K).alias("h"))
    n = walk.neighbours(g.edges, g.unitigs.select("unitig_id", F.lit("+").alias("strand")))
    n = n.join(heads.withColumnRenamed("h", "src"), "unitig_id").join(heads.select(F.col("unitig_id").alias("neighbour"), F.col("h").alias("b")), "neighbour")
    return n.select("src", F.col("strand").alias("src_strand"), F.col("b").alias("neighbour"), "neighbour_strand")


@query(None)
def superbubbles(spark, sf_dir):
    """All superbubbles, from both ends; tested against a brute-force walk on small graphs."""
    return _graph(spark, sf_dir).superbubbles()


