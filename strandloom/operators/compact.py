"""Compaction: from a set of k-mers to unitigs.

Oriented k-mers meet at junctions, the k-1 bases they share. A junction with one k-mer ending in it
and one beginning with it is a link; links form paths and cycles. Tasks follow them within buckets of junctions
(``compact_local``), and pointer doubling gives every chain its head and place. A palindrome
(even k) has an arriving and a departing copy, so paths end in it or begin with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.plans.stage import forget, materialize

from .compact_local import CHAIN, HALF, MOST_LINKS, RING, SINGLE, bucketed, chains, named, solve_links, unitig_kmers


def oriented(kmers: DataFrame, k: int) -> DataFrame:
    """``x``: both orientations of each k-mer, a palindrome once."""
    both = F.array_distinct(F.array("kmer", dna.twin(F.col("kmer"), k)))
    return kmers.select(F.explode(both).alias("x"))


def node_twin(x: Column, k: int) -> Column:
    """The node's other orientation; the copies of a palindrome are each other's."""
    plain = x.bitwiseAND(dna.lit(dna.mask(k)))
    other = dna.twin(plain, k)
    return F.when(other != plain, other).otherwise(x.bitwiseXOR(dna.lit(dna.DEPART)))


def _double(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes placed on their head, nodes of cycles) of ``state(x, p, d)``, p the node d bases before.

    Each round a node that is not yet on its head takes over the pointer of the node it points to. On paths their number
    falls every round; once it stands still only cycles are left.
    """
    hop = lambda df: df.select(F.col("x").alias("h_x"), F.col("p").alias("h_p"), F.col("d").alias("h_d"), F.col("open").alias("h_open"))
    here = state.select(F.col("x").alias("h_x"))
    first = materialize(state.join(here, F.col("p") == F.col("h_x"), "left").select("x", "p", "d", F.col("h_x").isNotNull().alias("open")), "pointers")
    placed, rest = first.where("not open"), first.where("open")
    left = rest.count()
    while left:
        moved = rest.join(hop(placed.union(rest)), F.col("p") == F.col("h_x")).select("x", F.col("h_p").alias("p"), (F.col("d") + F.col("h_d")).alias("d"), F.col("h_open").alias("open"))
        moved = materialize(moved, "pointers")
        now = moved.where("open").count()  # a scan of one column
        placed, rest = placed.union(moved.where("not open")), moved.where("open")
        if now == left:
            break
        left = now
    return placed.select("x", "p", "d"), rest.select("x")


def _cycle_starts(ring: DataFrame) -> DataFrame:
    """``x, m`` of ``ring(x, p)``: the least node of x's cycle, by doubling minima until none changes."""
    state = materialize(ring.select("x", "p", F.least("x", "p").alias("m")), "rings")
    while True:
        hop = state.select(F.col("x").alias("h_x"), F.col("p").alias("h_p"), F.col("m").alias("h_m"))
        grown = state.join(hop, F.col("p") == F.col("h_x")).select("x", F.col("h_p").alias("p"), F.least("m", "h_m").alias("m"), (F.col("h_m") < F.col("m")).alias("new"))
        state = materialize(grown, "rings")
        if not state.where("new").limit(1).count():
            return state.select("x", "m")
        state = state.drop("new")


def _rounds(link: DataFrame, k: int) -> DataFrame:
    """``head, d, x, is_cycle`` of ``link(a, b, w)`` by rounds over the whole cluster: both orientations of paths, one of each cycle."""
    placed, rest = _double(link.select(F.col("b").alias("x"), F.col("a").alias("p"), F.col("w").alias("d")))
    heads = placed.select(F.col("p").alias("x")).distinct().select(F.col("x").alias("head"), F.lit(0).cast("long").alias("d"), "x", F.lit(False).alias("is_cycle"))
    members = heads.union(placed.select(F.col("p").alias("head"), "d", "x", F.lit(False).alias("is_cycle")))
    if not rest.limit(1).count():
        return members
    ring = link.join(rest, link["b"] == rest["x"]).select("x", F.col("a").alias("p"), "w")
    least = _cycle_starts(ring)
    other = least.select(node_twin(F.col("x"), k).alias("t_x"), F.col("m").alias("t_m"))
    own = materialize(least.join(other, F.col("x") == F.col("t_x")).where(F.col("m") < F.col("t_m")).select("x", "m"), "cycles")
    cut = ring.join(own, "x").where(F.col("x") != F.col("m")).select("x", "p", F.col("w").alias("d"))
    around, _ = _double(cut)
    starts = own.where(F.col("x") == F.col("m")).select(F.col("m").alias("head"), F.lit(0).cast("long").alias("d"), "x", F.lit(True).alias("is_cycle"))
    return members.union(starts).union(around.select(F.col("p").alias("head"), "d", "x", F.lit(True).alias("is_cycle")))


#: K-mers of a task of ``chains`` on average: some 50 MB of arrays.
TASK = 200_000


def _parts(link: DataFrame, k: int, most_local: int) -> DataFrame:
    """``head, is_cycle, d, bases`` of written ``link(a, b, w, bases)``: the links of each unitig by their place in it."""
    members = materialize(solve_links(link, k) if link.count() <= most_local else _rounds(link.select("a", "b", "w"), k), "members")
    ends = members.where("not is_cycle").groupBy("head").agg(F.max_by("x", "d").alias("tail"))
    # Of a path's two orientations the one that begins with the smaller k-mer stays; at equal ones (a palindrome at both ends) the nodes decide.
    bare = lambda c: c.bitwiseAND(dna.lit(dna.mask(k)))
    both = ends.select("head", "tail", node_twin(F.col("tail"), k).alias("back")).select("head", bare(F.col("head")).alias("from"), "back", bare(F.col("back")).alias("to"))
    ours = both.where((F.col("from") < F.col("to")) | ((F.col("from") == F.col("to")) & (F.col("head") <= F.col("back")))).select(F.col("head").alias("o_head"))
    kept = members.where("not is_cycle").join(ours, F.col("head") == F.col("o_head"), "left_semi").union(members.where("is_cycle"))
    return link.join(kept, F.col("a") == F.col("x")).select("head", "is_cycle", "d", "bases")


def _spelled(parts: DataFrame, k: int) -> DataFrame:
    rows = parts.groupBy("head", "is_cycle").agg(F.array_sort(F.collect_list(F.struct("d", "bases"))).alias("parts"))
    return rows.select(F.concat(dna.unpack(F.col("head"), k), F.array_join(F.transform("parts", lambda p: p["bases"]), "")).alias("seq"), "is_cycle")


def _whole(kmers: DataFrame, k: int, most_local: int, tasks: int | None) -> DataFrame:
    """``seq, is_cycle`` of each unitig, in the orientation it has; of a cycle from any k-mer on and with its first k bases again at its end.

    K-mers meet in buckets of junctions by minimizer, so a task finds all links of its junctions and follows them: what is left are
    chains, a tenth of the k-mers or so, that meet in the k-mers between two buckets. Up to ``most_local`` chains are
    followed in one task, more by rounds.
    """
    kmers = materialize(kmers.select("kmer"), "kmers")
    if tasks is None:
        n = kmers.count()
        tasks = max(1, -(-n // TASK), min(kmers.sparkSession.sparkContext.defaultParallelism, n // 20_000))
    table = materialize(chains(bucketed(kmers, k).repartition(tasks, "bucket"), k), "chains")
    forget(kmers)
    parts = _parts(table.where(F.col("kind") == CHAIN), k, most_local)
    rings = table.where(F.col("kind") == RING).select(F.col("a").alias("head"), F.lit(True).alias("is_cycle"), F.lit(0).cast("long").alias("d"), "bases")
    long = _spelled(parts.union(rings), k)
    halves = table.where(F.col("kind") == HALF).groupBy("a").agg(F.count("*").alias("n")).where("n = 2").select("a")
    single = table.where(F.col("kind") == SINGLE).select("a").union(halves)
    return long.union(single.select(dna.unpack(F.col("a"), k).alias("seq"), F.lit(False).alias("is_cycle")))


def compact(kmers: DataFrame, k: int, most_local: int = MOST_LINKS, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(unitigs, k-mer index) of ``kmers(kmer)``; unitigs are written, the index is cut from them.

    unitigs: ``unitig_id, seq, n_kmers, head, tail, is_cycle``, the id being the canonical form of the head. Of the two orientations
    of a path the one that begins with the smaller k-mer stays. A cycle begins with the least of all its oriented k-mers.
    index: ``kmer, unitig_id, pos, strand``, strand true where the unitig holds the canonical form.
    """
    dna.check_k(k)
    unitigs = materialize(named(_whole(kmers, k, most_local, tasks), k), "unitigs")
    return unitigs, unitig_kmers(unitigs, k).drop("x")


def join_ends(unitigs: DataFrame, k: int, most_local: int = MOST_LINKS) -> DataFrame:
    """Unitigs of the graph of the k-mers of ``unitigs``, which are whole unitigs that stay of a larger graph.

    A junction within a unitig has no other k-mer, so only ends can have got new links; unitigs without one stay as they are.
    """
    head, tail, turned, back, a, b = (F.col(c) for c in ("head", "tail", "turned", "back", "a", "b"))
    sides = lambda df: df.withColumns({"turned": dna.twin(tail, k), "back": dna.twin(head, k)})  # noqa: E731  columns of their own: a twin of a twin would be a thousand terms
    none = F.lit(None).cast("long")
    row = lambda j, x, y: F.struct(j.alias("j"), x.alias("a"), y.alias("b"))
    ends = F.array(*[row(dna.suffix(x, k), x, none) for x in (tail, back)], *[row(dna.prefix(y, k), none, y) for y in (head, turned)])
    e = sides(unitigs.where("not is_cycle")).select("unitig_id", F.explode(ends).alias("e")).select("unitig_id", "e.*")
    of = lambda x: F.min(F.when(x.isNotNull(), F.col("unitig_id")))
    met = e.groupBy("j").agg(F.min(a).alias("a"), F.max(a).alias("a_most"), F.min(b).alias("b"), F.max(b).alias("b_most"), of(a).alias("a_id"), of(b).alias("b_id"))
    met = met.where((a == F.col("a_most")) & (b == F.col("b_most")) & (a != b)).select("a", "b", "a_id", "b_id", dna.twin(a, k).alias("turned"))
    met = materialize(met.where(turned != b), "ends")
    leaving = lambda x, other: F.when(x == other, x.bitwiseOR(dna.lit(dna.DEPART))).otherwise(x)
    new = met.select(leaving(a, turned).alias("a"), "b", F.lit(1).cast("long").alias("w"), F.translate(dna.base_at(b, k - 1, k).cast("string"), "0123", "ACGT").alias("bases"))
    ids = met.select(F.explode(F.array("a_id", "b_id")).alias("t_id")).distinct()
    touched = unitigs.join(ids, F.col("unitig_id") == F.col("t_id"), "left_semi")
    w = (F.col("n_kmers") - 1).cast("long").alias("w")
    after = lambda s: F.substring(s, F.lit(k + 1), F.col("n_kmers")).alias("bases")
    inside = sides(touched.where("n_kmers > 1")).select(F.explode(F.array(
        F.struct(leaving(head, back).alias("a"), tail.alias("b"), w, after(F.col("seq"))),
        F.struct(leaving(turned, tail).alias("a"), back.alias("b"), w, after(dna.reverse_complement(F.col("seq")))),
    )).alias("c")).select("c.*")
    link = materialize(new.union(inside), "chains")
    joined = named(_spelled(_parts(link, k, most_local), k), k)
    return joined.union(unitigs.join(ids, F.col("unitig_id") == F.col("t_id"), "left_anti").select(*joined.columns))


def paths(kmers: DataFrame, k: int, most_local: int = MOST_LINKS, tasks: int | None = None) -> DataFrame:
    """``head, d, x, is_cycle``: every k-mer once, in the orientation and at the place it has in its unitig."""
    unitigs, _ = compact(kmers, k, most_local, tasks)
    at = unitig_kmers(unitigs, k).select("unitig_id", F.col("pos").cast("long").alias("d"), "x")
    return at.join(unitigs.select("unitig_id", "head", "is_cycle"), "unitig_id").select("head", "d", "x", "is_cycle")


def kmer_edges(kmers: DataFrame, k: int) -> DataFrame:
    """``x, y``: y follows x, over oriented k-mers; every edge stands on both strands (the edge of a palindrome may be its own mirror)."""
    x = oriented(kmers, k)
    left = x.select(dna.suffix(F.col("x"), k).alias("j"), "x")
    right = x.select(dna.prefix(F.col("x"), k).alias("j"), F.col("x").alias("y"))
    return left.join(right, "j").select("x", "y")


def unitig_edges(unitigs: DataFrame, k: int) -> DataFrame:
    """``src, src_strand, dst, dst_strand``: dst follows src, strands '+' or '-'; every edge stands from both ends.

    Branches touch only the ends of unitigs, so the ends meet by junction.
    """
    ends = F.array(
        F.struct(F.lit("+").alias("s"), dna.suffix(F.col("tail"), k).alias("out"), dna.prefix(F.col("head"), k).alias("in")),
        F.struct(F.lit("-").alias("s"), dna.suffix(dna.twin(F.col("head"), k), k).alias("out"), dna.prefix(dna.twin(F.col("tail"), k), k).alias("in")),
    )
    e = unitigs.select("unitig_id", F.explode(ends).alias("e"))
    a = e.select(F.col("unitig_id").alias("src"), F.col("e.s").alias("src_strand"), F.col("e.out").alias("j"))
    b = e.select(F.col("unitig_id").alias("dst"), F.col("e.s").alias("dst_strand"), F.col("e.in").alias("j"))
    return a.join(b, "j").select("src", "src_strand", "dst", "dst_strand")


def degrees(unitigs: DataFrame, edges: DataFrame) -> DataFrame:
    """``unitig_id, n_in, n_out`` of each unitig as stored; a loop counts as a neighbour."""
    n = edges.groupBy("src").agg(F.sum(F.when(F.col("src_strand") == "+", 1).otherwise(0)).alias("o"), F.sum(F.when(F.col("src_strand") == "-", 1).otherwise(0)).alias("i"))
    return unitigs.select("unitig_id").join(n, F.col("unitig_id") == F.col("src"), "left").select("unitig_id", F.coalesce("i", F.lit(0)).cast("long").alias("n_in"), F.coalesce("o", F.lit(0)).cast("long").alias("n_out"))
