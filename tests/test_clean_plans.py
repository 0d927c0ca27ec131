"""K-mers that stay after an edit are cut from the unitigs that stay: no table of k-mers is joined."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import clean, edit, kmers
from strandloom.plans.graph import Graph


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("GATTACAGATCCGT",), ("GATTACAGTTACCA",), ("CCGGA",)]
    return Graph.build(5, ref=spark.createDataFrame(rows, "seq string"))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_removed_unitigs(graph):
    ids = graph.unitigs.where("n_kmers < 3").select("unitig_id")
    left = edit.remove_unitigs(graph.unitigs, ids, 5)
    gone = graph.index.join(ids, "unitig_id", "left_semi").select("kmer")
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, graph.kmers.join(gone, "kmer", "left_anti").collect()))
    assert plan(left).count("Join") == 1


def check_simplified(graph, clip, lone):
    left = clean.simplify(graph.kmers, graph.unitigs, graph.index, graph.edges, 5, clip, lone)
    gone = graph.index.join(clean.to_remove(graph.unitigs, graph.edges, 5, clip, lone), "unitig_id", "left_semi").select("kmer")
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, graph.kmers.join(gone, "kmer", "left_anti").collect()))
    assert "kmer#" not in "".join(x for x in plan(left).splitlines() if "Join" in x)


def test_both(graph):
    check_simplified(graph, True, True)


def test_clip(graph):
    check_simplified(graph, True, False)


def test_isolated(graph):
    check_simplified(graph, False, True)
