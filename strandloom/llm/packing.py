"""Best-fit packing by exact-complement hashing.

Lengths are at most the capacity, so their histogram is small whatever the corpus holds. The
plan is made on that histogram: runs of equal sequences, each with a repeat count. Sums of single lengths,
pairs and triples are indexed; combinations that fill a gap exactly are consumed under the counts of what is
left, and best fit takes the rest. Pieces then find their place by their rank among pieces of their
length; ranks are taken within ranges of a unique order, so no length is gathered in one task.

Nulls and empty texts are packed like any other (with the closing id they have one token). Long texts are cut.
Repeated rows are packed each; rows of equal or null ids are told apart by a digest of their token ids, and rows equal in
all of these can change places. An empty table gives an empty table. Reruns agree, whatever the order of the rows.
Other columns of ``docs`` are not carried, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import bounded_batches, in_ranges, lean, materialize
from .wordbpe import pieces, prove, word_bpe


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids``: ids of each piece as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    proved = docs.sparkSession.sparkContext.broadcast(prove(vocabulary))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary, proved.value)
        for b in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for n, part in enumerate(pieces(encoder.ids(text or "") + end, capacity)):
                    row.append(i)
                    piece.append(n)
                    start.append(n * capacity)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("id", id_col)


class SumIndex:
    """Which lengths, pairs and triples make each sum, under the counts of what is left.

    ``pairs[s]`` lists the longer parts of pairs whose sum is s, ``triples[s]`` the longest parts of triples, shortest
    first. Counts only fall, so an entry that can't be served is taken off its list for good.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        there = np.flatnonzero(self.left)
        longer: list[list[int]] = [[] for _ in range(capacity + 1)]
        for a in there.tolist():
            for b in there[(there <= a) & (there + a <= capacity)].tolist():
                longer[a + b].append(a)
        self.pairs = longer
        sums = np.array([bool(x) for x in longer])
        self.triples: list[list[int]] = [[] for _ in range(capacity + 1)]
        for a in there.tolist():
            for rest in np.flatnonzero(sums[: min(2 * a, capacity - a) + 1]).tolist():
                self.triples[a + rest].append(a)

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair with the longest part."""
        parts = self.pairs[total]
        while parts:
            a, b = parts[-1], total - parts[-1]
            if self.left[a] > (a == b) and self.left[b] > 0:
                return a, b
            parts.pop()
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """The triple with the longest part, then the pair with the longest part of what it leaves."""
        parts = self.triples[total]
        while parts:
            a = parts[-1]
            if self.left[a] > 0:
                self.left[a] -= 1
                two = self.pair_within(total - a)
                self.left[a] += 1
                if two:
                    return (a, *two)
            parts.pop()
        return None

    def pair_within(self, total: int) -> tuple[int, int] | None:
        """Like ``pair`` while a part is held back: nothing is taken off for that."""
        for a in reversed(self.pairs[total]):
            b = total - a
            if self.left[a] > (a == b) and self.left[b] > 0:
                return a, b
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def best_fit(self, gap: int) -> int:
        """The longest piece that fits, 0 if none does."""
        at = np.flatnonzero(self.left[: gap + 1])
        return int(at[-1]) if len(at) else 0


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths of one sequence) that use all pieces up.

    From the longest length down: while single pieces, pairs or triples fill the gap exactly,
    they are taken as often as the stock allows. Where nothing fills it, the longest piece that
    fits goes in and the search starts again from the smaller gap.
    """
    stock, out = SumIndex(counts, capacity), []
    for length in range(capacity, 0, -1):
        while stock.left[length] > 0:
            parts = [length]
            stock.left[length] -= 1
            gap = capacity - length
            while gap > 0:
                if got := stock.complement(gap):
                    add = list(got)
                elif one := stock.best_fit(gap):
                    add = [one]
                else:
                    break
                for x in add:
                    stock.left[x] -= 1
                parts += add
                gap -= sum(add)
            used = {x: parts.count(x) for x in set(parts)}
            more = min(int(stock.left[x]) // n for x, n in used.items())
            for x, n in used.items():
                stock.left[x] -= n * more
            out.append((1 + more, tuple(parts)))
    return out


def placements(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): a run of ranks takes that offset in following sequences."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, parts in plan:
        offset = 0
        for length in parts:
            first = rank.get(length, 0)
            out.append((length, first, repeats, sequence, offset))
            rank[length] = first + repeats
            offset += length
        sequence += repeats
    return out


def pack(table: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_digest")) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``table`` is evaluated several times: pass a written one.

    ``order``: columns that tell the rows apart as far as they differ.
    """
    spark = table.sparkSession
    counts = {r[0]: r[1] for r in table.groupBy(length_col).count().collect()}  # at most `capacity` rows
    runs = placements(plan_sequences(counts, capacity))
    spots = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "p_length bigint, p_first bigint, p_ranks bigint, p_sequence bigint, p_offset bigint")

    by = [*order, "p_row"]
    rows = in_ranges(table.withColumn("p_row", F.monotonically_increasing_id()), [length_col, *by], "ranged-pieces")
    sums = rows.groupBy(F.col(length_col).alias("b_length"), F.col("p_id").alias("b_id")).agg(F.count("*").alias("b_n"))  # a row a length and range, ranges follow the lengths
    before = sums.select("b_length", "b_id", (F.sum("b_n").over(W.partitionBy("b_length").orderBy("b_id")) - F.col("b_n")).alias("b_before"))
    ranked = rows.withColumn("p_in", F.row_number().over(W.partitionBy(length_col, "p_id").orderBy(*by)) - 1)
    ranked = ranked.join(before, (F.col(length_col) == F.col("b_length")) & (F.col("p_id") == F.col("b_id"))).withColumn("p_rank", F.col("p_in") + F.col("b_before"))

    # A run of ranks can be long: cut runs and ranks into blocks, so that the join is by equal keys.
    block = 4096
    cells = spots.select("*", F.explode(F.sequence(F.expr(f"p_first div {block}"), F.expr(f"(p_first + greatest(p_ranks, 1) - 1) div {block}"))).alias("p_block"))
    placed = ranked.withColumn("r_block", F.expr(f"p_rank div {block}")).join(
        cells, (F.col(length_col) == F.col("p_length")) & (F.col("r_block") == F.col("p_block")) & (F.col("p_rank") >= F.col("p_first")) & (F.col("p_rank") < F.col("p_first") + F.col("p_ranks"))
    )
    return placed.select(*[F.col(c) for c in table.columns], (F.col("p_sequence") + F.col("p_rank") - F.col("p_first")).alias("sequence_id"), F.col("p_offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack. With ``keep_ids`` the ids come out beside their CRC-32, else only the CRC-32."""
    cut = tokenize_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col).withColumn("ids_crc32", F.crc32("ids")).withColumn("ids_digest", F.unhex(F.md5("ids")))
    if not keep_ids:
        cut = cut.drop("ids")
    return pack(materialize(cut, "pieces"), capacity, order=(id_col, "piece", "start", "ids_digest")).drop("ids_digest")
