"""Queries that must not stop at a level, a list of names, a depth or a number of lines."""

import random
from collections import deque

from pyspark.sql import functions as F

from strandloom.plans import catalog
from strandloom.plans.graph import Graph


def test_bfs_levels_go_to_the_end(spark, monkeypatch):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(800))
    other = "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i % 80 == 60 else c for i, c in enumerate(base))
    g = Graph.build(31, ref=spark.createDataFrame([(base,), (other,)], "seq string"))
    monkeypatch.setattr(catalog, "_graph", lambda *a: g)
    got = {r.seq: r.level for r in catalog.bfs_levels(spark, "").collect()}
    seqs = {r.unitig_id: r.seq for r in g.unitigs.collect()}
    near, degree = {}, {}
    for r in g.edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
    for r in g.degrees().collect():
        degree[r.unitig_id] = r.n_in + r.n_out
    start = min(u for u, n in degree.items() if n > 1)
    levels, todo = {start: 0}, deque([start])
    while todo:
        u = todo.popleft()
        for v in near.get(u, ()):
            if v not in levels:
                levels[v] = levels[u] + 1
                todo.append(v)
    assert max(levels.values()) > 6
    assert got == {seqs[u]: n for u, n in levels.items()}
