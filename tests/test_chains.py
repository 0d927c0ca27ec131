"""Compaction by buckets of junctions, cut into many tasks, and k-mers of whole Arrow batches."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import compact, kmers, windows_local


@pytest.mark.parametrize("k", [4, 31])
def test_any_number_of_tasks_gives_the_same_unitigs(spark, k):
    rng = random.Random(k)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    ring, base = make(400), make(300)
    seqs = [ring + ring[: k - 1], base + make(50), make(60) + base] if k > 4 else [make(14) for _ in range(5)]
    ks = kmers.distinct_kmers(spark.createDataFrame([(s,) for s in seqs], "seq string"), k).localCheckpoint()
    rows = lambda *how: sorted(map(tuple, compact.compact(ks, k, *how)[0].collect()))
    one = rows(2_000_000, 1)
    assert one == rows(2_000_000, 9) == rows(0, 9)
    if k > 4:
        assert [r[2] for r in one if r[5]] == [400]


def test_batches_give_what_rows_give(spark, monkeypatch):
    monkeypatch.setattr(windows_local, "STEP", 16)
    texts = ["The quick brown fox, jumps  over", None, "", "naïve Kelvin ẗ İstanbul", "x" * 50, "Zebra\nand\ttab"]
    t = spark.createDataFrame([(s,) for s in texts], "s string")
    assert windows_local.read_text(pa.array(["skipped", *texts]).slice(1)).to_pylist() == [r[0] for r in t.select(dna.text_to_dna(F.col("s"))).collect()]
    seqs = ["acgtnACGTTGCA", None, "ACGẗACGTA", "A" * 40, "CG", "GATTACAGATTACANGATTACA"]
    want = []
    for i, s in enumerate(seqs):
        s = "".join(c if c in "ACGT" else "N" for c in (s or "").upper())
        for w in (s[p : p + 5] for p in range(len(s) - 4)):
            if "N" not in w:
                want.append((i, min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))))
    got = [(int(i), dna_of(int(x), 5)) for at, xs in windows_local.canonical(pa.array(["skipped", *seqs]).slice(1), 5) for i, x in zip(at, xs, strict=True)]
    assert sorted(got) == sorted(want)


def dna_of(x: int, k: int) -> str:
    return "".join("ACGT"[x >> 2 * (k - 1 - i) & 3] for i in range(k))
