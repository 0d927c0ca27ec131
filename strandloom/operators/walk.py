"""Walks over the unitig graph: neighbours, components, breadth-first levels, superbubbles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.stage import materialize

from .components import connected_components


def neighbours(edges: DataFrame, starts: DataFrame, successors: bool = True) -> DataFrame:
    """``unitig_id, strand, neighbour, neighbour_strand`` of ``starts(unitig_id, strand)``."""
    flip = lambda c: F.translate(c, "+-", "-+")
    side = F.col("strand") if successors else flip(F.col("strand"))
    found = starts.join(edges, (F.col("unitig_id") == F.col("src")) & (side == F.col("src_strand")))
    return found.select("unitig_id", "strand", F.col("dst").alias("neighbour"), (F.col("dst_strand") if successors else flip(F.col("dst_strand"))).alias("neighbour_strand"))


def components(unitigs: DataFrame, edges: DataFrame) -> DataFrame:
    """``unitig_id, component``: component is the least unitig_id of it."""
    labels = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    rows = unitigs.select("unitig_id").join(labels, F.col("unitig_id") == F.col("node"), "left").select("unitig_id", F.coalesce("component", "unitig_id").alias("c"))
    least = rows.groupBy("c").agg(F.min("unitig_id").alias("component"))
    return rows.join(least, "c").select("unitig_id", "component")


def bfs(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """``unitig_id, level`` of all unitigs reached from ``starts(unitig_id)`` either way, up to a level if given."""
    near = materialize(edges.select("src", "dst").distinct(), "adjacent")
    seen = materialize(starts.select("unitig_id", F.lit(0).alias("level")).distinct(), "levels")
    level = 0
    while most is None or level < most:
        front = seen.where(F.col("level") == level).join(near, F.col("unitig_id") == F.col("src")).select(F.col("dst").alias("unitig_id")).distinct()
        new = materialize(front.join(seen.select("unitig_id"), "unitig_id", "left_anti").withColumn("level", F.lit(level + 1)), "levels")
        if not new.limit(1).count():
            break
        seen = materialize(seen.union(new), "levels")
        level += 1
    return seen


def superbubbles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``entry, entry_strand, exit, exit_strand, n_inside`` of superbubbles, or only of those closed within ``most`` steps.

    All entries advance at once. From an entry, a vertex is passed once all its predecessors are; a walk ends as
    a superbubble when one vertex is left to pass and nothing waits, and fails at a dead end, at a way
    back to the entry, or when both strands of a unitig are met. Each superbubble comes out from both ends.
    """
    v = lambda u, s: F.struct(F.col(u).alias("u"), F.col(s).alias("s"))
    e = materialize(edges.select(v("src", "src_strand").alias("a"), v("dst", "dst_strand").alias("b")).distinct(), "oriented-edges")
    n_in = materialize(e.groupBy("b").agg(F.count("*").alias("n_in")), "in-degrees").withColumnRenamed("b", "i_b")
    out_degree = e.groupBy("a").agg(F.count("*").alias("n_out"))
    ready = out_degree.where("n_out > 1").select(F.col("a").alias("s"), F.col("a").alias("v"))
    waiting, passed, done = None, None, None
    step = 0
    while most is None or step < most:  # each step passes a vertex or ends a walk
        step += 1
        ready = materialize(ready, "ready")
        if not ready.limit(1).count():
            break
        passed = ready if passed is None else materialize(passed.union(ready), "passed")
        reach = ready.join(e, ready["v"] == e["a"], "left").select("s", F.col("b").alias("v"))
        bad = reach.where(F.col("v").isNull() | (F.col("v") == F.col("s"))).select("s")
        add = reach.where(F.col("v").isNotNull()).select("s", "v", F.lit(1).cast("long").alias("got"))
        waiting = add if waiting is None else waiting.union(add)
        waiting = waiting.groupBy("s", "v").agg(F.sum("got").alias("got"))
        met = passed.select("s", "v").union(waiting.select("s", "v"))
        both = met.groupBy("s", F.col("v.u").alias("u")).agg(F.countDistinct("v.s").alias("n")).where("n > 1").select("s")
        waiting = materialize(waiting.join(bad.union(both).distinct(), "s", "left_anti"), "waiting")
        marked = waiting.join(n_in, F.col("v") == F.col("i_b")).select("s", "v", "got", (F.col("got") == F.col("n_in")).alias("open"))
        state = marked.groupBy("s").agg(F.count("*").alias("n"), F.min("v").alias("one"), F.max("open").alias("any"), F.min("open").alias("all"))
        state = materialize(state, "walks")
        closed = state.where("n = 1 and all").select("s", F.col("one").alias("t"))
        inside = passed.groupBy("s").agg((F.count("*") - 1).alias("n_inside"))
        found = materialize(closed.join(inside, "s"), "bubbles")
        done = found if done is None else done.union(found)
        going = state.where("any and not (n = 1 and all)").select("s")
        ready = materialize(marked.where("open").join(going, "s", "left_semi").select("s", "v"), "ready")
        waiting = materialize(marked.where("not open").join(going, "s", "left_semi").select("s", "v", "got"), "waiting")
    if done is None:
        done = e.limit(0).select(F.col("a").alias("s"), F.col("a").alias("t"), F.lit(0).cast("long").alias("n_inside"))
    return done.select(F.col("s.u").alias("entry"), F.col("s.s").alias("entry_strand"), F.col("t.u").alias("exit"), F.col("t.s").alias("exit_strand"), "n_inside")
