"""Near copies by shared shingles against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import neardup
from strandloom.llm.scratch import materialize


def brute_kept(rows, least=0.8):
    def of(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                root[find(a)] = find(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def made():
    rng = np.random.default_rng(7)
    pool = [f"w{i}" for i in range(2000)]
    out, texts = [], [list(rng.choice(pool, int(rng.integers(60, 300)))) for _ in range(12)]
    for t in texts:
        for n in (0, 1, 2, 4, 8):  # copies with some words changed, from near to far
            c = list(t)
            for at in rng.integers(0, len(c), n):
                c[at] = f"x{rng.integers(0, 10**9)}"
            out.append(" ".join(c))
    hot, chain = list(rng.choice(pool, 200)), list(rng.choice(pool, 200))
    for i in range(40):  # a large group around a center
        c = list(hot)
        c[int(rng.integers(0, 200))] = f"y{i}"
        out.append(" ".join(c))
    for i in range(40):  # a chain: the ends have nothing in common
        out.append(" ".join((chain + [f"z{k}" for k in range(1000)])[10 * i : 10 * i + 200]))
    out += ["", None, " ", "same short", "Same  SHORT", "other short"]
    return list(enumerate(out))


def test_stage_drops_near_copies_of_different_texts(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string").withColumn("node", F.lit("clash"))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_one_posting_loses_no_link(spark):
    """All texts meet in one posting: the star and the members outside it decide alone."""
    rows = [(i, t) for i, t in made()[40:118] if t and t.strip()]
    docs = spark.createDataFrame(rows, "node bigint, text string")
    prints = materialize(neardup.signatures(docs, 5, "node", "text").select(F.col("key").alias("node"), F.concat(F.array(F.lit(7).cast("long")), F.slice("words", 2, 35)).alias("words")), "test")
    index = docs.select(F.lit(7).cast("long").alias("posting"), "node", F.lit(rows[0][0]).cast("long").alias("leader"))
    links = neardup.similar_links(index, prints, neardup.shingle_sets(docs, 5, "node", "text")).collect()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    assert sorted({find(i) for i, _ in rows}) == brute_kept(rows)


def test_recall_at_the_threshold(spark):
    """Pairs of different texts just above a similarity of 0.8: nearly all share a posting and pass the count."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        words = [f"a{i}_{j}" for j in range(300)]
        other = list(words)
        at = int(rng.integers(0, 30))
        for n in range(6):  # six words far apart change 30 of 296 shingles: 266 / 326 = 0.816
            other[at + 45 * n] = f"b{i}_{n}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in neardup.deduplicate_similar(docs).collect()}
    assert all(2 * i in kept for i in range(400)) and sum(2 * i + 1 not in kept for i in range(400)) >= 0.99 * 400
