"""Null names, colored search within one edit, colors of mappings, long records; against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import colors as C
from strandloom.operators import kmers, search
from strandloom.plans.graph import Graph

PAIR = str.maketrans("ACGT", "TGCA")


def canon(w):
    return min(w, w.translate(PAIR)[::-1])


def windows(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def edits(s, p, k):
    """K-mers one edit away from the window at p, and the window."""
    w, out = s[p : p + k], {s[p : p + k]}
    out |= {w[:i] + b + w[i + 1 :] for i in range(k) for b in "ACGT" if b != w[i]}
    out |= {w[:i] + b + w[i : k - 1] for i in range(k) for b in "ACGT"}
    if len(s) > p + k:
        x = s[p : p + k + 1]
        out |= {x[:i] + x[i + 1 :] for i in range(k + 1)}
    return {canon(y) for y in out}


@pytest.mark.parametrize("k", [3, 9, 16, 17, 31])
def test_packed_windows(spark, k):
    rng = np.random.default_rng(k)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 1, k - 1, k, k + 1, 255, 256, 257, 256 + k - 1, 256 + k, 512, 700, 1300)] + ["ACGTN" * 99, "acgt" * 80 + "nn" + "T" * 40]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, seq string")
    got = sorted((r.i, r.w) for r in kmers.kmers(t, k, ["i"]).select("i", dna.unpack(F.col("kmer"), k).alias("w")).collect())
    assert got == sorted((i, canon(w)) for i, s in enumerate(seqs) for w in windows(s.upper(), k) if set(w) <= set("ACGT"))
    at = kmers.positioned(t, k, ["i"]).select("i", "pos", dna.unpack(F.col("oriented"), k).alias("w"), "next_base").collect()
    want = [(i, p, w, "ACGT".find(s.upper()[p + k : p + k + 1]) if s[p + k : p + k + 1] else -1) for i, s in enumerate(seqs) for p, w in enumerate(windows(s.upper(), k)) if set(w) <= set("ACGT")]
    assert sorted((r.i, r.pos, r.w, -1 if r.next_base is None else r.next_base) for r in at) == sorted(want)


def test_time_follows_the_length_of_a_record(spark):
    rng = np.random.default_rng(1)
    took = []
    for n in (1 << 18, 1 << 20):
        t = spark.createDataFrame([("".join(rng.choice(list("ACGT"), n)),)], "seq string")
        kmers.count_kmers(t, 21).count()
        began = time.time()
        assert kmers.kmers(t, 21).count() == n - 20
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 2


def test_null_names(spark):
    t = spark.createDataFrame([(None, "ACGTTGCAAC"), ("x", "ACGTTG")], "name string, seq string")
    held = kmers.distinct_kmers(t, 5)
    assert {(r.name, r.n_query, r.n_found) for r in search.search(held, t, 5).collect()} == {(None, 6, 6), ("x", 2, 2)}
    assert {r.name: r.present for r in search.presence(held, t, 5, 1.0).collect()} == {None: 1, "x": 1}
    colored = C.color_kmers(held, t.withColumn("c", F.lit("red")), 5, "c")
    assert {(r.name, r.color, r.n_found) for r in search.search_colors(colored, t, 5).collect()} == {(None, "red", 6), ("x", "red", 2)}
    assert {r.name: r.n_colors for r in search.presence_in_colors(colored, t, 5, 1.0, 1).collect()} == {None: 1, "x": 1}
    assert {r.name: r.n_found for r in search.search_inexact(held, t, 5).collect()} == {None: 6, "x": 2}


def test_colored_search_within_one_edit(spark):
    rng, k = np.random.default_rng(3), 7
    refs = [(c, "".join(rng.choice(list("ACGT"), 60))) for c in ("red", "blue", None)]
    asked = [("a", refs[0][1][5:40]), ("b", refs[0][1][:20] + "A" + refs[0][1][21:40]), ("b", refs[1][1][3:30]), (None, refs[2][1][:15] + refs[2][1][16:40]), ("short", "ACG"), ("n", "ACGTNNACGTACG")]
    r, q = spark.createDataFrame(refs, "c string, seq string"), spark.createDataFrame(asked, "name string, seq string")
    g = Graph.build(k, ref=r, color_col="c")
    held = {c: {canon(w) for w in windows(s, k)} for c, s in refs}
    want = {}
    for name, s in asked:
        for p, w in enumerate(windows(s, k)):
            if set(w) <= set("ACGT"):
                near = {y for y in edits(s, p, k) if "N" not in y}
                for c in held:
                    if near & held[c]:
                        want[(name, c)] = want.get((name, c), 0) + 1
    got = g.query(q, approximate=True)
    assert {(r.name, r.color): r.n_found for r in got.collect()} == want
    assert g.query(q, "presence", min_ratio=0.5, min_colors=1, approximate=True).where("present = 1").count() >= 2


def test_colors_of_mappings_can_be_changed(spark):
    refs = spark.createDataFrame([("red", "ACGGTTACATTGACC"), ("blue", "TTACATT")], "c string, seq string")
    g = Graph.build(5, ref=refs, color_col="c")
    index, colors = g.index, g.colors
    some = g.unitigs.orderBy(F.col("n_kmers").desc()).limit(1).select("unitig_id", F.lit(0).alias("dist"), F.lit(2).alias("len"))
    inside = {r.kmer for r in index.join(some, "unitig_id").where("pos < 2").collect()}
    before = {(r.kmer, r.color) for r in colors.collect()}
    more = C.add_color(colors, index, some, "green")
    assert {(r.kmer, r.color) for r in more.collect()} == before | {(x, "green") for x in inside}
    assert {(r.color, r.n) for r in C.color_sizes(index, more, some).collect()} >= {("green", 2)}
    less = C.remove_color(more, index, some, "red")
    assert {(r.kmer, r.color) for r in less.collect()} == (before | {(x, "green") for x in inside}) - {(x, "red") for x in inside}
    top = {r.unitig_id: r.color for r in C.color_max(index, more).collect()}
    best = {}
    for r in index.join(more, "kmer").collect():
        best[r.unitig_id] = max(best.get(r.unitig_id, ""), r.color)
    assert top == best
    assert C.check_colors(g.kmers, refs, colors, 5, "c").count() == 0 and C.check_colors(g.kmers, refs, more, 5, "c").count() == 2


def test_colors_numbered_in_input_order(spark):
    t = spark.createDataFrame([("z.fa", 0), ("a.fa", 1), ("z.fa", 0), ("m.fa", 2)], "file_name string, file_id int")
    assert [(r.color_id, r.name) for r in C.color_table(t, "file_name", "file_id").orderBy("color_id").collect()] == [(0, "z.fa"), (1, "a.fa"), (2, "m.fa")]
    assert [r.name for r in C.color_table(t, "file_name").orderBy("color_id").collect()] == ["a.fa", "m.fa", "z.fa"]


def test_colors_counted_in_one_pass(spark):
    t = spark.createDataFrame([("a", "ACGTTGCAAC"), ("b", "ACGTTG"), (None, "ACGTT"), ("b", "GGGGGGGG")], "c string, seq string")
    for least in (1, 2, 3, 5):
        two = C.color_kmers(kmers.count_kmers(t, 5, least), t, 5, "c")
        assert sorted(C.count_colors(t, 5, "c", least).collect(), key=str) == sorted(two.collect(), key=str)
