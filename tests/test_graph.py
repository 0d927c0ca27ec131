"""Compaction, cleaning, editing and queries against brute force on small sequences."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import clean, colors, compact, edit, kmers, search, walk
from strandloom.plans.graph import Graph

PAIR = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(PAIR)[::-1]


def canon(s):
    return min(s, rc(s))


def brute_kmers(seqs, k):
    return {canon(s[i : i + k]) for s in map(str.upper, seqs) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")}


def brute_unitigs(ks, k):
    """(canonical sequences of paths, canonical rotations of cycles) by walking."""
    every = ks | {rc(x) for x in ks}
    out = lambda x: [x[1:] + b for b in "ACGT" if x[1:] + b in every]
    into = lambda x: [b + x[:-1] for b in "ACGT" if b + x[:-1] in every]

    def nxt(x, left):
        if x == rc(x) and left:  # a palindrome is left only from its start
            return None
        o = out(x)
        if len(o) == 1 and len(into(o[0])) == 1 and canon(o[0]) != canon(x):
            return o[0]
        return None

    seen, paths, cycles = set(), set(), set()
    for x in sorted(every):
        if canon(x) in seen:
            continue
        head, met = x, {canon(x)}
        while True:  # back to the head, by walking the other strand
            y = nxt(rc(head), len(met) > 1)
            if y is None or canon(y) in met:
                ring = y is not None and rc(y) == x
                break
            head = rc(y)
            met.add(canon(head))
        walk_, cur = [head], head
        while (y := nxt(cur, len(walk_) > 1)) is not None and y != head and canon(y) not in map(canon, walk_):
            walk_.append(y)
            cur = y
        seen |= {canon(z) for z in walk_}
        seq = walk_[0] + "".join(z[-1] for z in walk_[1:])
        if ring and nxt(walk_[-1], True) == head:
            loops = [walk_, [rc(z) for z in reversed(walk_)]]
            cycles.add(min(tuple(r[i:] + r[:i]) for r in loops for i in range(len(r))))
        else:
            paths.add(canon(seq))
    return paths, cycles


def records(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "name int, seq string")


def table(spark, seqs, k):
    return kmers.distinct_kmers(records(spark, seqs), k)


CASES = {
    "cycle": (5, ["CAGATTTCAGA"]), "rotated": (5, ["ATTTCAGATTT"]), "self_twin": (3, ["ATAT"]), "palindrome": (4, ["AACGTT"]),
    "bubble": (5, ["TCATAGCTATGAAGGTGATTCCCT", "TCATAGCTATGACGGTGATTCCCT"]), "tip": (5, ["GGGGCAAGCGGAAACCTTCATTCTGTAAGT", "AAACTG"]),
    "with_n": (3, ["ACGTNACGTT"]), "lower": (3, ["acgtACGT"]), "short": (3, ["AC", ""]), "random7": (7, ["".join(random.Random(1).choices("ACGT", k=400))]),
    "random5": (5, ["".join(random.Random(2).choices("ACGT", k=150))]), "even6": (6, ["".join(random.Random(3).choices("ACGT", k=200))]),
}


@pytest.mark.parametrize("name", CASES)
def test_compaction(spark, name):
    k, seqs = CASES[name]
    want = brute_kmers(seqs, k)
    ks = table(spark, seqs, k).cache()
    assert {r.s for r in ks.select(dna.unpack(F.col("kmer"), k).alias("s")).collect()} == want
    unitigs, index = compact.compact(ks, k)
    rows = unitigs.collect()
    paths, cycles = brute_unitigs(want, k)
    assert {canon(r.seq) for r in rows if not r.is_cycle} == paths
    assert len([r for r in rows if r.is_cycle]) == len(cycles)
    assert sum(r.n_kmers for r in rows) == len(want) == index.select("kmer").distinct().count() == index.count()
    assert all(len(r.seq) == r.n_kmers + k - 1 for r in rows)


@pytest.mark.parametrize("name", ["cycle", "random7", "tip"])
def test_rounds_and_one_task_agree(spark, name):
    k, seqs = CASES[name]
    ks = table(spark, seqs, k).cache()
    rows = lambda most: sorted(map(tuple, compact.paths(ks, k, most).collect()))
    assert rows(10**6) == rows(0)


def test_clip_tips(spark):
    k, seqs = CASES["tip"]
    g = Graph.build(k, ref=records(spark, seqs))
    assert g.kmers.count() == 28 and sorted(r.n_kmers for r in g.unitigs.collect()) == [2, 11, 15]
    c = g.simplify(clip_tips=True, delete_isolated=False)
    assert c.kmers.count() == 26 and c.unitigs.count() == 1
    lone = Graph.build(5, ref=records(spark, ["AAACCTG"]))
    assert lone.simplify(clip_tips=False, delete_isolated=True).kmers.count() == 0


def test_editing(spark):
    k, seqs = CASES["bubble"]
    a, b = Graph.build(k, ref=records(spark, seqs[:1])), Graph.build(k, ref=records(spark, seqs[1:]))
    both = Graph.build(k, ref=records(spark, seqs))
    assert a.merge(b).equals(both) and b.merge(a).equals(both) and a.add(records(spark, seqs[1:])).equals(both) and not a.equals(b)
    assert a.update(ref=records(spark, seqs[1:])).equals(both)
    assert Graph.build(k, ref=records(spark, [rc(s) for s in seqs])).equals(both)
    assert both.remove(records(spark, seqs)).kmers.count() == 0
    ids = both.unitigs.where("n_kmers = 4").select("unitig_id")
    assert both.remove_unitigs(ids).kmers.count() == 17
    assert edit.intersect(a.kmers, b.kmers).count() + edit.subtract(a.kmers, b.kmers).count() == a.kmers.count()
    assert a.checksum().collect() == Graph.build(k, ref=records(spark, [rc(seqs[0])])).checksum().collect()
    assert Graph.build(k, ref=records(spark, [CASES["cycle"][1][0]])).equals(Graph.build(k, ref=records(spark, CASES["rotated"][1])))
    with pytest.raises(ValueError):
        a.merge(Graph.build(7, ref=records(spark, seqs)))


def test_colors(spark):
    k, seqs = CASES["bubble"]
    rows = spark.createDataFrame([("x", seqs[0]), ("y", seqs[1]), ("y", rc(seqs[1]))], "file string, seq string")
    g = Graph.build(k, ref=rows, color_col="file")
    want = {(m, c) for c, s in (("x", seqs[0]), ("y", seqs[1])) for m in brute_kmers([s], k)}
    assert {(r.s, r.color) for r in g.colors.select(dna.unpack(F.col("kmer"), k).alias("s"), "color").collect()} == want
    q = spark.createDataFrame([("q", seqs[0]), ("none", "A")], "name string, seq string")
    got = {(r.name, r.color): (r.n_found, r.n_query) for r in g.query(q).collect()}
    s = seqs[0]
    assert got == {("q", c): (sum((canon(s[i : i + k]), c) in want for i in range(len(s) - k + 1)), len(s) - k + 1) for c in "xy"}
    assert {(r.name, r.present) for r in g.query(q, "presence", 1.0, 2).collect()} == {("q", 0), ("none", 0)}
    assert {(r.name, r.color) for r in g.query(q, "presence", 1.0).collect()} == {("q", "x")}
    with pytest.raises(ValueError):
        g.query(q, "count", min_ratio=0.5)


def near(s, p, k):
    w, out = s[p : p + k], set()
    out |= {w[:i] + b + w[i + 1 :] for i in range(k) for b in "ACGT" if b != w[i]}
    out |= {w[:i] + b + w[i : k - 1] for i in range(k) for b in "ACGT"}
    if p + k < len(s):
        z = s[p : p + k + 1]
        out |= {z[:i] + z[i + 1 :] for i in range(k + 1)}
    return out


def test_queries(spark):
    k, rng = 7, random.Random(9)
    base = "".join(rng.choices("ACGT", k=300))
    g = Graph.build(k, ref=records(spark, [base]))
    have = brute_kmers([base], k)
    qs = [("exact", base[20:90]), ("edited", base[100:130] + "A" + base[131:160] + base[162:200]), ("n", base[:10] + "N" + base[11:30]), ("short", "ACG"), ("empty", ""), ("null", None), ("twice", base[:20]), ("twice", base[40:60])]
    q = spark.createDataFrame(qs, "name string, seq string")
    exact, edited, total = {}, {}, {}
    for n, s in qs:
        s = s or ""
        ok = [p for p in range(len(s) - k + 1) if "N" not in s[p : p + k]]
        hit = {p for p in ok if canon(s[p : p + k]) in have}
        more = {p for p in ok if p not in hit and any("N" not in y and canon(y) in have for y in near(s, p, k))}
        total[n] = total.get(n, 0) + max(0, len(s) - k + 1)
        exact[n] = exact.get(n, 0) + len(hit)
        edited[n] = edited.get(n, 0) + len(hit | more)
    got = {r.name: (r.n_query, r.n_found, r.ratio) for r in g.query(q).collect()}
    assert got == {n: (total[n], exact[n], exact[n] / total[n] if total[n] else 0.0) for n in total}
    got = {r.name: r.n_found for r in g.query(q, approximate=True).collect()}
    assert got == edited
    runs = g.mappings(q.where("name in ('exact', 'edited')"))
    assert runs.agg(F.sum("len")).first()[0] == exact["exact"] + exact["edited"]
    for r in g.accessors(runs).join(q, "name").collect():
        assert r.mapped == r.seq[r.pos : r.pos + len(r.mapped)] and r.mapped_head == r.mapped[:k] and r.mapped_tail == r.mapped[-k:]


def test_packed_functions(spark):
    rng = random.Random(5)
    for k in (3, 8, 21, 31):
        words = ["".join(rng.choices("ACGT", k=k)) for _ in range(40)] + ["A" * k, "T" * k]
        x = F.col("x")
        d = spark.createDataFrame([(w,) for w in words], "w string").withColumn("x", dna.pack(F.col("w")))
        for r in d.select("w", "x", dna.unpack(x, k).alias("back"), dna.unpack(dna.twin(x, k), k).alias("twin"), dna.unpack(dna.rep(x, k), k).alias("rep"), dna.substitutions(x, k).alias("s"), dna.insertions(x, k).alias("i"), dna.deletions(x, F.lit(2).cast("long"), k).alias("d")).collect():
            assert r.back == r.w and r.twin == rc(r.w) and r.rep == canon(r.w)
            num = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
            w = r.w + "G"
            assert set(r.s) == {num(w[:i] + b + w[i + 1 : k]) for i in range(k) for b in "ACGT" if b != w[i]}
            assert set(r.i) == {num(w[:i] + b + w[i : k - 1]) for i in range(k) for b in "ACGT"}
            assert set(r.d) == {num(w[:i] + w[i + 1 :]) for i in range(k + 1)}
    with pytest.raises(ValueError):
        Graph(33, None)


def test_walks(spark):
    # A bubble: s -> (a | b) -> t, and a lone unitig.
    edges = [(1, "+", 2, "+"), (1, "+", 3, "+"), (2, "+", 4, "+"), (3, "+", 4, "+")]
    flip = {"+": "-", "-": "+"}
    rows = edges + [(d, flip[ds], s, flip[ss]) for s, ss, d, ds in edges]
    e = spark.createDataFrame(rows, "src long, src_strand string, dst long, dst_strand string")
    u = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "unitig_id long")
    assert {(r.unitig_id, r.component) for r in walk.components(u, e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)}
    assert {(r.unitig_id, r.level) for r in walk.bfs(e, u.where("unitig_id = 1")).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    got = {tuple(r) for r in walk.superbubbles(e).collect()}
    assert got == {(1, "+", 4, "+", 2), (4, "-", 1, "-", 2)}
    start = spark.createDataFrame([(1, "+")], "unitig_id long, strand string")
    assert {r.neighbour for r in walk.neighbours(e, start).collect()} == {2, 3} and walk.neighbours(e, start, successors=False).count() == 0


def test_minimizers(spark):
    from xxhash import xxh64_intdigest

    def code(s):
        return sum("ACGT".index(c) << 2 * (len(s) - 1 - i) for i, c in enumerate(s))

    def least(w, g, ends):
        h = lambda v: (xxh64_intdigest(v.to_bytes(8, "little"), 42) + (1 << 63)) % (1 << 64)
        grams = [code(canon(w[i : i + g])) for i in range(0 if ends else 1, len(w) - g + (1 if ends else 0))]
        return min(grams, key=lambda v: (h(v), v))

    rng, k, g = random.Random(5), 11, 4
    seqs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    ks = sorted(brute_kmers(seqs, k))
    rows = spark.createDataFrame([(x, code(x)) for x in ks], "s string, kmer bigint")
    for ends in (True, False):
        got = {r.s: r.m for r in rows.select("s", dna.minimizer(F.col("kmer"), k, g, ends).alias("m")).collect()}
        assert got == {x: least(x, g, ends) for x in ks}
    graph = Graph(k, table(spark, seqs, k), g=g)
    wanted = {least(x, g, True) for x in ks[:5]}
    asked = spark.createDataFrame([(m,) for m in sorted(wanted)] * 2, "minimizer bigint")
    place = {r.kmer: (r.unitig_id, r.pos) for r in graph.index.collect()}
    got = sorted(tuple(r) for r in graph.find_minimizers(asked).select("minimizer", "unitig_id", "pos").collect())
    assert got == sorted((least(x, g, True), *place[code(x)]) for x in ks if least(x, g, True) in wanted)


def test_color_matrix(spark):
    hits = spark.createDataFrame([("a", "x", 2), ("b", "y", 3), ("a", "y", 1)], "name string, color string, n_found bigint")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "name string")
    got = {r.name: (r.x, r.y, r.z) for r in search.color_matrix(hits, names, ["x", "y", "z"]).collect()}
    assert got == {"a": (2, 1, 0), "b": (0, 3, 0), "c": (0, 0, 0), None: (0, 0, 0)}


def test_mapping_colors(spark):
    rng, k = random.Random(8), 7
    base = "".join(rng.choice("ACGT") for _ in range(60))
    inputs = {"x": base[:40], "y": base[20:], "z": base[25:35]}
    rows = spark.createDataFrame(list(inputs.items()), "file string, seq string")
    g = Graph.build(k, ref=rows, color_col="file")
    asked = spark.createDataFrame([("q", base), ("r", rc(base[10:50]))], "name string, seq string")
    maps = g.mappings(asked)
    seqs = {r.name: r.seq for r in asked.collect()}
    own = {c: brute_kmers([s], k) for c, s in inputs.items()}
    some, every = set(), set()
    for m in maps.collect():
        ks = {canon(seqs[m.name][i : i + k]) for i in range(m.pos, m.pos + m.len)}
        some |= {(m.name, m.pos, m.len, c) for c in own if ks & own[c]}
        every |= {(m.name, m.pos, m.len, c) for c in own if ks <= own[c]}
    for want, flag in ((some, False), (every, True)):
        got = [tuple(r) for r in colors.mapping_colors(g.index, g.colors, maps, flag).select("name", "pos", "len", "color").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert every < some
