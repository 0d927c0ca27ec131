"""Quality rules with adaptive thresholds, in DataFrame functions only.

Counts of every whole text give a few measures in whole numbers. A sketch of each measure for each
language and source counts its rows in bins whose width grows with the value (32 bins for each doubling, so a quantile
is off by 1 in 32 at most); sketches merge by adding counts, over a language and over all. The threshold of a group
is read from its sketch: an upper quantile, and from there a number of times that quantile's distance from the
median. A group's threshold is drawn to its language's, and that to the one of all rows, as if SHRINK rows more had
been seen there; so few rows of a group decide little and no group has a rule of its own kind.

Null and empty texts have no words and fail the base. Null languages and sources form groups of
their own. Long texts count whole. Repeated rows are judged each. An empty table gives an empty table. Columns other
than id, language, source and text are not carried, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import let, materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: measure: percent of the upper quantile, how many times its distance from the median is added, least distance (a bin's width
#: where a value can lie that far from a median of 0). Shares are in 100,000ths, the length of words in thousandths of a character.
MEASURES = {"symbols": (75, 4, 250), "dup_lines": (99, 1, 10_000), "repeats": (99, 1, 5_000), "upper": (75, 12, 100), "word_length": (75, 10, 100)}
SHARE, LENGTH = 100_000, 1000
SHRINK = 200
FINE = 5  # bits of a value that a bin tells apart


def words_of(text: Column) -> Column:
    flat = F.translate(text, SPACE, " " * len(SPACE))
    return F.array_remove(F.split(flat, " "), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text holds twice or more."""

    def covered(order: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(order, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(order, i + 1)["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(order, same), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    def of_hashes(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, covered))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with its counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    both = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    gone = lambda chars: (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*keep, both.alias("m_words"), dup.alias("m_lines"), F.char_length(bare).cast("long").alias("word_chars"), gone(SYMBOLS).alias("n_symbols"), gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"))
    return rows.select(*keep, "m_words.n_words", "word_chars", "n_symbols", "m_lines.n_dup_lines", "m_words.n_repeat_words", "m_lines.n_lines", "n_upper")


def measures() -> dict[str, Column]:
    share = lambda a, b, unit: F.expr(f"({unit} * {a}) div greatest({b}, 1)")
    return {
        "symbols": share("n_symbols", "word_chars", SHARE),
        "dup_lines": share("n_dup_lines", "n_lines", SHARE),
        "repeats": share("n_repeat_words", "n_words", SHARE),
        "upper": share("n_upper", "word_chars", SHARE),
        "word_length": share("word_chars", "n_words", LENGTH),
    }


def bin_of(value: str) -> Column:
    """Values below 2^(FINE+1) are their own bin; above, the leading FINE + 1 bits tell the bin."""
    return F.expr(f"greatest(length(bin({value})) - {FINE + 1}, 0) * {1 << FINE} + shiftright({value}, greatest(length(bin({value})) - {FINE + 1}, 0))").cast("int")


def top_of(bin_: str) -> Column:
    """The largest value of a bin."""
    return F.expr(f"CASE WHEN {bin_} < {2 << FINE} THEN CAST({bin_} AS BIGINT) ELSE shiftleft(CAST({bin_} % {1 << FINE} + {(1 << FINE) + 1} AS BIGINT), {bin_} div {1 << FINE} - 1) - 1 END")


def sketches(counts: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, measure, bin, n``: the mergeable sketch."""
    cells = F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("long").alias("v")) for k, v in measures().items()])
    return counts.select(*groups, F.explode(cells).alias("c")).select(*groups, "c.measure", F.col("c.v").alias("v")).groupBy(*groups, "measure", bin_of("v").alias("bin")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, measure, rows, fence`` of a sketch on its own."""
    of = lambda i: F.coalesce(*[F.when(F.col("measure") == k, F.lit(v[i])) for k, v in MEASURES.items()])
    w = W.partitionBy(*groups, "measure")  # a row a bin
    run = sketch.withColumn("rows", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bin")))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("bin")))
    quantiles = run.groupBy(*groups, "measure").agg(F.max("rows").alias("rows"), at(50).alias("b_mid"), at(of(0)).alias("b_high"))
    edges = quantiles.select(*groups, "measure", "rows", top_of("b_mid").alias("mid"), top_of("b_high").alias("high"))
    return edges.select(*groups, "measure", "rows", (F.col("high") + of(1) * F.greatest(F.col("high") - F.col("mid"), of(2))).cast("long").alias("fence"))


def thresholds(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``t_lang, t_source`` and a threshold for each measure."""
    fine = materialize(sketches(counts.withColumnsRenamed({lang: "t_lang", source: "t_source"}), ["t_lang", "t_source"]), "sketches")
    a = fences(fine, ["t_lang", "t_source"])
    b = fences(merge(fine, ["t_lang"]), ["t_lang"]).select(F.col("t_lang").alias("b_lang"), F.col("measure").alias("b_measure"), F.col("rows").alias("b_rows"), F.col("fence").alias("b_fence"))
    c = fences(merge(fine, []), []).select(F.col("measure").alias("c_measure"), F.col("fence").alias("c_fence"))
    joined = a.join(b, a["t_lang"].eqNullSafe(b["b_lang"]) & (a["measure"] == b["b_measure"])).join(c, F.col("measure") == F.col("c_measure"))
    drawn = lambda fence, rows, to: f"(CAST({rows} AS DECIMAL(20,0)) * {fence} + {SHRINK} * {to}) div ({rows} + {SHRINK})"
    limit = F.expr(drawn("fence", "rows", f"({drawn('b_fence', 'b_rows', 'c_fence')})"))
    return joined.groupBy("t_lang", "t_source").agg(*[F.max(F.when(F.col("measure") == k, limit)).alias(f"t_{k}") for k in MEASURES])


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id``, lang, source, counts, ``base_failed``, ``kept`` of every row."""
    counts = materialize(measure(docs.select(F.col(id_col), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text_col).alias("text"))), "counts")
    limits = thresholds(counts)
    rows = counts.join(limits, counts["lang"].eqNullSafe(limits["t_lang"]) & counts["source"].eqNullSafe(limits["t_source"]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    over = F.lit(False)
    for k, v in measures().items():
        over = over | (v > F.col(f"t_{k}"))
    return rows.select(*counts.columns, failed.alias("base_failed"), (~failed & ~over).alias("kept"))
