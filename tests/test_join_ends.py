"""A simplified graph's unitigs are the old ones joined at their ends: the same as k-mers that stay, compacted anew."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import clean, compact, kmers
from strandloom.plans.graph import Graph

COLUMNS = ["unitig_id", "seq", "n_kmers", "head", "tail", "is_cycle"]


def rows(unitigs):
    return sorted(map(tuple, unitigs.select(*COLUMNS).collect()))


def graph_of(spark, k, seqs):
    return Graph(k, kmers.distinct_kmers(spark.createDataFrame([(s,) for s in seqs], "seq string"), k).localCheckpoint())


@pytest.mark.parametrize(("k", "most_local"), [(4, 2_000_000), (5, 0), (8, 2_000_000)])
def test_any_unitigs_that_stay(spark, k, most_local):
    rng = random.Random(10 * k + bool(most_local))
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [make(k + 12) for _ in range(4 if k < 8 else 40)] + ["A" * (k + 2), "AC" * k]
    g = graph_of(spark, k, seqs)
    joined = 0
    for i in range(2):
        left = g.unitigs.where((F.xxhash64("unitig_id", F.lit(i)) % 3) != 0).localCheckpoint()
        want = compact.compact(compact.unitig_kmers(left, k).select("kmer"), k)[0]
        got = rows(compact.join_ends(left, k, most_local))
        assert got == rows(want)
        joined += left.count() - len(got)
    assert joined


def test_a_ring_closes_when_its_tip_goes(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    k, ring = 9, make(60)
    tip = make(4) + ring[20 : 20 + k - 1]
    g = graph_of(spark, k, [ring + ring[: k - 1], tip])
    clipped = g.simplify(True, False)
    assert [(r.n_kmers, r.is_cycle) for r in clipped.unitigs.collect()] == [(60, True)]
    assert rows(clipped.unitigs) == rows(compact.compact(clean.simplify(g.kmers, g.unitigs, g.index, g.edges, k, True, False), k)[0])


@pytest.mark.parametrize(("clip", "lone"), [(True, False), (False, True), (True, True)])
def test_kmers_are_not_compacted_again(spark, monkeypatch, clip, lone):
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    g = graph_of(spark, 9, [base, base[:50] + "ACG", "TTGCA" + base[70:90], "CCGGATTACACC"])
    want = rows(compact.compact(clean.simplify(g.kmers, g.unitigs, g.index, g.edges, 9, clip, lone), 9)[0])
    monkeypatch.setattr(compact, "chains", None)
    left = g.simplify(clip, lone)
    assert rows(left.unitigs) == want
    assert sorted(r.kmer for r in left.kmers.collect()) == sorted(r.kmer for r in left.index.collect())
