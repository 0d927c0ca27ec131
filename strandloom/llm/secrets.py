"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger lists the
(blob, rule version) pairs that have been scanned, with their spans. A scan takes one row of every
blob whose pair is not in the ledger, so copies and old versions cost nothing, and joins the
findings back to all rows that hold the blob.

A text is moved once, to its blob's first row; where it is redacted, only texts that a quick test of the
rules lets through are joined with the findings, the others pass.

Null texts are empty texts; empty texts have no spans. Repeated rows come out each. Rows with a null
id are handled like others. Positions are code points, the end exclusive. Long texts are scanned whole. An empty table gives
an empty table and an empty ledger. ``scan`` reads the id and text columns only; ``redacted`` carries all columns
under names that can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keyed, let, materialize

SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters or more.

    ``hints``: every text with a match holds one of these, ``fold``: in small letters; without hints the pattern itself is the quick test.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    fold: bool = False


#: The first three are the base; their runs of a class are maximal, so a least length can stand in the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "api_key", "apikey"), fold=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hints=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", hints=("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyJ",)),
)
RULE_VERSION = "v1"


def may_match(text: Column, rule: Rule) -> Column:
    """A quick test that holds for every text with a match."""
    if not rule.hints:
        return text.rlike(rule.pattern)

    def held(t: Column) -> Column:
        there = F.lit(False)
        for h in rule.hints:
            there = there | F.contains(t, F.lit(h))
        return there

    return let(F.lower(text), held) if rule.fold else held(text)


def find(text: Column, number: int, rule: Rule) -> Column:
    """Spans of one rule: what lies between matches and the matches themselves give the positions."""
    pattern = F.lit(rule.pattern)
    hits, values = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(
        F.transform(hits, F.char_length).alias("hit"),
        F.transform(values, F.char_length).alias("value"),
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(hits)), F.char_length).alias("gap"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    there = may_match(text, rule)
    named = parts.cast("array<struct<hit:int,value:int,gap:int>>")
    return F.when(there, F.aggregate(named, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then rule."""
    return F.array_sort(F.concat(*[find(text, n, r) for n, r in enumerate(rules)]))


def with_blob(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), text.alias("body"), F.sha2(text, 256).alias("blob"))


def of_version(ledger: DataFrame, version: str) -> DataFrame:
    return ledger.where(F.col("rule_version") == version).select("blob", "rule_version", F.col("spans").cast(SPAN).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``path, blob, spans`` of every row, the ledger's new rows ``blob, rule_version, spans``)."""
    versions = with_blob(docs, id_col, text_col)
    paths = materialize(versions.select("path", "blob"), "paths")
    first = paths.groupBy("blob").agg(F.min("path").alias("first"))
    if ledger is not None:
        first = first.join(of_version(ledger, version).select("blob"), "blob", "left_anti")
    first = first.withColumnRenamed("blob", "f_blob")
    # Copies of a blob differ in their path, so the pair spreads a hot blob.
    unseen = versions.join(first, (versions["blob"] == first["f_blob"]) & versions["path"].eqNullSafe(first["first"]), "left_semi")
    found = unseen.select("blob", spans_of(F.col("body"), rules).alias("spans")).dropDuplicates(["blob"])
    new = materialize(found.select("blob", F.lit(version).alias("rule_version"), "spans"), "ledger")
    known = new if ledger is None else new.unionByName(of_version(ledger, version))
    hits = known.where(F.size("spans") > 0).select(F.col("blob").alias("h_blob"), "spans")
    rows = paths.join(hits, paths["blob"] == hits["h_blob"], "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return rows.withColumnRenamed("path", id_col), new


def arrivals(docs: DataFrame, parts: int, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` as so many batches that arrive one after the other; together they hold each row once."""
    batch = F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts))
    return [docs.where(batch == n) for n in range(parts)]


def scan_arrivals(batches: list[DataFrame], rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``scan`` of one batch after the other with the ledger so far: a blob that an earlier batch held is not scanned again."""
    rows = ledger = None
    for docs in batches:
        got, new = scan(docs, ledger, rules, version, id_col, text_col)
        rows = got if rows is None else rows.unionByName(got)
        ledger = new if ledger is None else ledger.unionByName(new)
    return rows, ledger


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap, F.get(kinds, s["kind"]))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, zero, step, rest)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with secrets replaced; a column ``n_chars``, where there is one, follows the text."""
    rows, at = keyed(docs)
    text, chars = F.col(at[text_col]), at.get("n_chars")
    body, names = F.coalesce(text, F.lit("")), list(at.values())
    suspect = F.lit(False)
    for r in rules:
        suspect = suspect | may_match(body, r)
    # Only what a rule may match is scanned and joined; the findings of a blob go to all rows that hold it.
    asked = rows.where(suspect)
    _, new = scan(asked.select(F.struct("row_file", "row_at").alias("k"), body.alias("t")), rules=rules, id_col="k", text_col="t")
    hits = new.where(F.size("spans") > 0).select(F.col("blob").alias("h_blob"), F.col("spans").alias("h_spans"))
    joined = asked.join(hits, F.sha2(body, 256) == F.col("h_blob"), "left")
    clean = F.when(F.col("h_spans").isNull(), text).otherwise(redact(text, F.col("h_spans"), rules))
    done = joined.select(*[clean.alias(c) if c == at[text_col] else F.col(c) for c in names], F.col("h_spans").isNotNull().alias("h_new"))
    if chars and chars != at[text_col]:
        length = F.char_length(F.col(at[text_col])).cast(docs.schema["n_chars"].dataType)
        done = done.withColumn(chars, F.when(F.col("h_new"), length).otherwise(F.col(chars)))
    return rows.where(~suspect).select(*names).union(done.select(*names)).toDF(*docs.columns)


__all__ = ["RULES", "Rule", "arrivals", "find", "redact", "redacted", "scan", "scan_arrivals", "spans_of", "written"]
