"""K-mers of pieces that are dealt by minimizer are counted as those that are dealt one by one, and far fewer rows are shuffled."""

import random

import pyarrow as pa
import pytest

from strandloom.operators import kmers, windows_local
from strandloom.plans.graph import Graph


def texts():
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = make(700)
    turned = base[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return [base, turned[100:400], base[50:90] + "N" + base[300:380], base.lower()[600:], "A" * 90, "acgt" * 20, "GATẗACAGATTACA", None, "", "ACG", make(300)]


@pytest.mark.parametrize(("k", "least"), [(3, 2), (4, 1), (12, 3), (31, 2)])
def test_counts(spark, monkeypatch, k, least):
    monkeypatch.setattr(windows_local, "STEP", 64)
    monkeypatch.setattr(kmers, "GATHER", 50)
    docs = spark.createDataFrame([(s,) for s in texts() * 3], "seq string")
    want = kmers.count_kmers(docs, k, least).select("kmer")
    assert sorted(map(tuple, kmers.solid_kmers(docs, k, least).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("k", [3, 4, 31])
def test_each_window_lies_in_one_piece_and_twins_in_one_bucket(k):
    where, got = {}, []
    for bucket, piece in windows_local.pieces(pa.array(texts()), k):
        for row, x in windows_local.canonical(piece, k):
            got += x.tolist()
            for b, y in zip(bucket[row].tolist(), x.tolist(), strict=True):
                assert where.setdefault(y, b) == b
    assert sorted(got) == sorted(y for _, x in windows_local.canonical(pa.array(texts()), k) for y in x.tolist())


def test_the_graph_shuffles_pieces(spark, monkeypatch):
    monkeypatch.setattr(kmers, "partial_counts", None)
    seen = {}
    for s in texts():
        s = "".join(c if c in "ACGT" else "N" for c in (s or "").upper())
        for w in (s[p : p + 31] for p in range(len(s) - 30)):
            if "N" not in w:
                w = min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
                seen[w] = seen.get(w, 0) + 1
    docs = spark.createDataFrame([(s,) for s in texts()], "seq string")
    assert Graph.build(31, seq=docs).kmers.count() == sum(n > 1 for n in seen.values())
