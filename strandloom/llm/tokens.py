"""Token counts by the whole-token shortcut.

What the shortcut may look up is proved once, on the driver, and sent to the workers.

Nulls count as empty texts; empty texts have 0 tokens; repeated rows are counted each; an
empty table gives an empty table. Columns of the input that clash with the added ones are
not carried: only the id column and the counts come out. Whole texts are counted, however long; what a worker
keeps for later texts is bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches, lean
from .wordbpe import prove, word_bpe


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row, whole texts.

    Pre-tokens that were proved to be one token are looked up; only the others are merged.
    """
    bounded_batches(docs.sparkSession)
    proved = docs.sparkSession.sparkContext.broadcast(prove(vocabulary))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary, proved.value)
        for b in batches:
            counts = [encoder.count(s or "") for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lean(run), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
