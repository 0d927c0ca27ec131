"""User data, prefixes, hashes and checksums against plain Python."""

from functools import reduce

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strandloom.functions import dna
from strandloom.operators import edit, kmers, mapping, payload
from strandloom.plans.graph import Graph
from strandloom.sources import files, store

READS = [("r1", "TCATAGCTATGAAGGTGATTCCCT"), ("r2", "TCATAGCTATGACGGTGATTCCCT"), ("r3", "TCATAGCTATG")]


def canon(w):
    return min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1])


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(READS, "name string, seq string")


def counts(names):
    out = {}
    for n, s in READS:
        if n in names:
            for i in range(len(s) - 4):
                out[canon(s[i : i + 5])] = out.get(canon(s[i : i + 5]), 0) + 1
    return out


def test_data_of_two_graphs_are_merged(spark, reads):
    data = payload.Payload("n", F.sum("n"))
    a, b = (kmers.count_kmers(reads.where(F.col("name").isin(*x)), 5) for x in (["r1", "r3"], ["r2"]))
    got = {r.w: r.n for r in payload.merge_data([a, b], data).select(dna.unpack(F.col("kmer"), 5).alias("w"), "n").collect()}
    assert got == counts({"r1", "r2", "r3"})


def test_data_of_a_unitig_stand_in_order(spark, reads):
    g = Graph.build(5, ref=reads)
    n = kmers.count_kmers(reads, 5)
    true = counts({"r1", "r2", "r3"})
    got = {r.unitig_id: r.n for r in payload.concat_data(g.index, n, "n").collect()}
    for r in g.unitigs.collect():
        assert got[r.unitig_id] == [true[canon(r.seq[i : i + 5])] for i in range(r.n_kmers)]


def test_common_prefix(spark):
    pairs = [("ACGT", "ACGA", 3), ("", "A", 0), ("A", "", 0), ("AC", "AC", 2), ("AC", "ACGT", 2), ("T", "A", 0)]
    t = spark.createDataFrame(pairs, "a string, b string, n int")
    assert t.where(mapping.common_prefix(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_hash_and_checksum(spark, reads):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = kmers.distinct_kmers(reads, 5)
    held = [r.kmer for r in table.collect()]
    hashes = {x: signed(xxh64_intdigest(x.to_bytes(8, "little"), 42)) for x in held}
    assert {r.kmer: r.h for r in table.select("kmer", dna.kmer_hash(F.col("kmer")).alias("h")).collect()} == hashes
    row = edit.checksum(table).collect()[0]
    assert reduce(lambda a, b: a ^ b, hashes.values()) in list(row)
    assert edit.checksum(table.repartition(5)).collect() == [row]


def test_what_is_not_there_is_unknown_and_what_is_broken_is_said(spark, reads, tmp_path):
    g = Graph.build(5, ref=reads)
    g.save(str(tmp_path / "graph"))
    assert files.sniff(spark, str(tmp_path / "graph")) == "graph"
    assert store.read(spark, str(tmp_path / "graph"))["names"] is None
    (tmp_path / "list.txt").write_text("a.fa\nb.fa\n")
    assert files.sniff(spark, str(tmp_path / "list.txt")) == "unknown"
    with pytest.raises(Exception):
        store.read(spark, str(tmp_path / "nowhere"))
