"""Quality selection by importance resampling over hashed n-grams.

Two generative models are counted over hashed features of all texts: one of the raw corpus, one
of the target (texts labelled good). The log importance weight of a text is the sum, over its
features, of the log ratio of target to raw probability; Gumbel noise from a hash of the id is
added and the k largest keys are kept: a sample without replacement in proportion to weight.

Features of a word: its bytes (unigram); itself and the word before (bigram); its shape (kinds of characters, length
class) with how far back the same word stood; and the pair of neighbouring shapes. Each has a table of BINS hashed bins. k is the
number of texts whose weight lies above the cut that separates the labelled sample best; where no label tells
good from bad, all texts are kept.

The labelled sample is bounded by ``max_labels`` (smallest hashes of the id first). Everything else
covers all texts, whole; a long text is read in parts that know the words before them. Null and empty texts have no features,
weight 0. A null id is hashed like a value of its own. Equal ids share their noise; ties at the k-th key are all kept.
Without labels, or with an empty table, the result is the input's rows, all kept. With ``keep_columns`` all columns are
carried under names that can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches, lean, materialize, shield

BINS = 1 << 16
TABLES = 4
BLOCK = 1 << 18  # bytes of text that are turned into features at once
BACK = 4  # words that a word's shape looks back
EARLY = BACK + 1  # words that its features look back, for the shape before it counts too
MIX = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """Bits for the kind of each byte; white space is 0."""
    out = np.full(256, 64, np.uint8)
    for bit, chars in ((1, range(65, 91)), (2, [*range(97, 123), *range(128, 256)]), (4, range(48, 58)), (8, b"#*$%&|<>"), (16, b"!?"), (32, b".,;:")):
        out[list(chars)] = bit
    out[[32, *range(9, 14)]] = 0
    return out


KINDS = _kinds()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x100000001B3
UP = _powers(256, BASE)


def _bin(h: np.ndarray, table: int) -> np.ndarray:
    """Bin of a hash in one of the tables."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    return (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64) + table * BINS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature bins of the words in ``data`` (TABLES x words), first words of texts, texts that have any.

    ``offsets`` bound the texts; words do not cross them.
    """
    kinds = KINDS[data]
    inside = kinds != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty((TABLES, 0), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    length = np.add.reduceat(inside, at, dtype=np.int64)
    flags = np.bitwise_or.reduceat(kinds, at).astype(np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(at, np.diff(np.append(at, len(data)))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.append(at, len(data))))])
    word = np.add.reduceat(np.where(inside, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * UP[place & 255], at)

    text = np.searchsorted(offsets, at, side="right") - 1
    back = np.zeros(len(at), np.uint64)
    for d in range(BACK, 0, -1):
        if len(at) > d:
            back[d:][(word[d:] == word[:-d]) & (text[d:] == text[:-d])] = d
    shape = (flags * np.uint64(8) + np.minimum(length, 31).astype(np.uint64) // np.uint64(4)) * np.uint64(8) + back
    before = np.empty_like(shape)
    before[1:] = shape[:-1] + np.uint64(1)
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    before[starts] = 0
    last = np.empty_like(word)
    last[1:] = word[:-1]
    last[starts] = 0
    bins = np.stack([_bin(word, 0), _bin(shape, 1), _bin(shape * np.uint64(1 << 20) + before, 2), _bin((last ^ (last >> np.uint64(29))) * MIX + word, 3)])
    return bins, starts, text[starts]


def _parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes, words to leave out) of one long text: each part begins EARLY words early, so that its own words know what stood before."""
    at = begin = skip = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and KINDS[data[end]]:
            gap = np.flatnonzero(KINDS[data[end : end + BLOCK]] == 0)
            end = end + int(gap[0]) if len(gap) else min(len(data), end + BLOCK)
        yield data[begin:end], skip
        at, reach = end, 4096
        while True:
            begin = max(0, end - reach)
            inside = KINDS[data[begin:end]] != 0
            heads = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # of words that begin after the first byte
            if len(heads) >= EARLY or begin == 0:
                break
            reach *= 8
        if len(heads) >= EARLY:
            begin, skip = begin + int(heads[-EARLY]), EARLY
        else:
            skip = len(heads) + int(inside[0]) if len(inside) else 0


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, bytes, offsets, words to leave out) of runs of texts of about BLOCK bytes, or of parts of a longer one."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, len(texts))
        if offsets[j] - offsets[i] > BLOCK:
            for part, skip in _parts(data[offsets[i] : offsets[j]]):
                yield i, part, np.array([0, len(part)]), skip
        elif offsets[j] > offsets[i]:
            yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
        i = j


def _featured(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, first words, texts) block by block."""
    for i, data, offsets, skip in _blocks(texts.fill_null("")):
        bins, starts, text = features(data, offsets)
        if skip:
            bins = bins[:, skip:]
        if bins.shape[1]:
            yield bins, starts, i + text


def count_features(rows: DataFrame) -> DataFrame:
    """``f, n``: counts of bins over all ``rows(text, good)``; those of good texts again from TABLES * BINS on."""
    bounded_batches(rows.sparkSession)
    size = TABLES * BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for b in batches:
            good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for bins, starts, text in _featured(b.column(0)):
                np.add.at(total, bins.ravel(), 1)
                mine = np.repeat(good[text], np.diff(np.append(starts, bins.shape[1])))
                if mine.any():
                    np.add.at(total, bins[:, mine].ravel() + size, 1)
        f = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(total[f], pa.int64())], ["f", "n"])

    return rows.select("text", "good").mapInArrow(lean(run), "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))


def log_ratio(f: np.ndarray, counts: np.ndarray, prior: float = 4.0) -> np.ndarray:
    """Log of target over raw probability of each bin, tables apart.

    What the raw model leads one to expect of the target is set against what was seen, both with
    ``prior`` added: a bin that the labelled texts are too few to judge has a ratio near 1.
    """
    n = np.zeros(2 * TABLES * BINS)
    n[f] = counts
    raw, target = n.reshape(2, TABLES, BINS)
    expected = raw / np.maximum(1.0, raw.sum(axis=1, keepdims=True)) * target.sum(axis=1, keepdims=True)
    return np.log((target + prior) / (expected + prior)).ravel()


def log_weight(spark: SparkSession, table: np.ndarray) -> Callable[[Column], Column]:
    """A function of a text column: its log importance weight. Only the weight comes back from Python, the row stays where it is."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(table.astype(np.float64))  # TABLES * BINS numbers, whatever the corpus

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lr = sent.value
        for texts in batches:
            out = np.zeros(len(texts))
            for bins, starts, text in _featured(texts):
                out[text] += np.add.reduceat(lr[bins].sum(axis=0), starts)
            yield pa.array(out)

    give_back = lean(run)

    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from give_back(batches)

    return weigh


def best_cut(weights: np.ndarray, good: np.ndarray) -> float | None:
    """The cut with the least share of labelled texts on the wrong side, a lost good text counted three times; middle of the gap."""
    if not good.any() or good.all():
        return None
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # Texts at or below the cut go: errors are good texts below it and bad ones above it.
    wrong = np.concatenate([[0.0], np.cumsum(3 * g / g.sum() - ~g / (~g).sum())]) + 1.0
    i = int(np.argmin(wrong))
    if i == 0:
        return None
    return float(w[i - 1] + w[i]) / 2 if i < len(w) else float(w[-1])


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The exact k-th largest of the longs in column ``bits``, by counting 16 bits at a time."""
    if k <= 0:
        return None
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit(65535))
        rows = keys if shift == 48 else keys.where(F.shiftrightunsigned("bits", shift + 16) == prefix)
        counts = sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True)  # at most 65,536 rows
        for d, n in counts:
            if n >= left:
                prefix = prefix * 65536 + d
                break
            left -= n
    return prefix


def _double_bits(x):
    """A long in the order of the doubles: rounded to 2^-32, made positive by an offset of 2^62."""
    return (F.round(F.greatest(F.lit(-1e8), F.least(F.lit(1e8), x)) * F.lit(float(1 << 32))).cast("long") + F.lit(1 << 62)).cast("long")


def importance_resample(docs: DataFrame, labels: DataFrame, seed: int = 7, max_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Rows that the sample keeps: ``id, log_weight, gumbel_key``; with ``keep_columns`` the rows of ``docs`` as they are.

    The target is counted over one half of the good labelled texts; the cut is set on the other labelled texts.
    ``labels`` has the id column and ``quality`` (1 good, 0 bad, null ignored).
    """
    sample = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg((F.min("quality") == 1).alias("good"))
    sample = sample.withColumn("fit", F.pmod(F.xxhash64("l_id", F.lit(seed + 1)), F.lit(2)) == 0)
    sample = materialize(sample.orderBy(F.xxhash64("l_id", F.lit(seed)), "l_id").limit(max_labels), "labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("l_id"), "left")  # at most max_labels rows
    counts = count_features(rows.select("text", (F.col("good") & F.col("fit")).alias("good"))).toArrow()  # at most 2 * TABLES * BINS rows
    table = log_ratio(counts["f"].to_numpy(), counts["n"].to_numpy())

    weigh = log_weight(docs.sparkSession, table)
    noise = lambda c: -F.log(-F.log((F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))
    weighed = docs.select(F.col(id_col).alias("id"), weigh(F.col(text_col)).alias("log_weight")).withColumn("gumbel_key", F.col("log_weight") + noise("id"))
    weighed = materialize(weighed.withColumn("bits", _double_bits(F.col("gumbel_key"))), "weights")
    seen = weighed.join(F.broadcast(sample), F.col("id") == F.col("l_id")).where(~(F.col("good") & F.col("fit"))).groupBy("id", "good").agg(F.min("log_weight").alias("w")).collect()  # at most max_labels rows
    cut = best_cut(np.array([r["w"] for r in seen], float), np.array([r["good"] for r in seen], bool)) if seen else None
    least = None
    if cut is not None:
        least = kth_largest(weighed, weighed.where(F.col("log_weight") > cut).count())
        if least is None:
            least = (1 << 63) - 1  # nothing lies above the cut
    if keep_columns:
        if least is None:
            return docs
        # Weighing a row again is cheaper than a shuffle of all texts to join the decisions to.
        inner, at = shield(docs)
        return inner.where(_double_bits(weigh(F.col(at[text_col])) + noise(at[id_col])) >= least).toDF(*docs.columns)
    kept = weighed if least is None else weighed.where(F.col("bits") >= least)
    return kept.select(F.col("id").alias(id_col), "log_weight", "gumbel_key")
