"""Chains of k-mers within a bucket of junctions, and paths of a table of chains that is proved small: arrays, no rounds of jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.functions import dna
from strandloom.plans.stage import ship

from .windows_local import BASES, BUCKETS, buckets, cut, rolled, twin, CODES

#: Links between chains up to which one task does the work: three LONG columns, about 150 MB with all temporary arrays.
MOST_LINKS = 2_000_000
#: What a row of ``chains`` is: a part of a path, a whole cycle, a k-mer without links, or one known so at one of its ends.
CHAIN, RING, SINGLE, HALF = range(4)


def twins(x: np.ndarray, k: int) -> np.ndarray:
    """The other orientation of each node, see ``compact.node_twin``."""
    plain = x & dna.mask(k)
    other = twin(plain, k)
    return np.where(other != plain, other, x ^ dna.DEPART)


def solve(a: np.ndarray, b: np.ndarray, k: int, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, d, x, is_cycle) of all nodes of links a -> b of length w (1 if not given), both orientations of paths, one of each cycle."""
    nodes = np.unique(np.concatenate([a, b]))
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    before = np.full(len(nodes), -1, np.int64)
    before[ib] = ia
    length = np.zeros(len(nodes), np.int64)
    length[ib] = 1 if w is None else w

    def walk(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ptr = np.where(prev >= 0, prev, np.arange(len(prev)))
        d = np.where(prev >= 0, length, 0)
        for _ in range(max(1, int(len(prev)).bit_length())):
            nxt = ptr[ptr]
            if (nxt == ptr).all():
                break
            d = d + d[ptr]
            ptr = nxt
        return ptr, d

    ptr, d = walk(before)
    ring = before[ptr] >= 0
    cut_ = before.copy()
    own = np.zeros(len(nodes), bool)
    if ring.any():
        least, hop = np.arange(len(nodes)), np.where(before >= 0, before, np.arange(len(nodes)))
        for _ in range(max(1, int(len(nodes)).bit_length())):
            least = np.minimum(least, least[hop])
            hop = hop[hop]
        at = np.flatnonzero(ring)
        other = np.searchsorted(nodes, twins(nodes[at], k))
        own[at] = least[at] < least[other]
        cut_[least[at][own[at]]] = -1
        ptr, d = walk(cut_)
    keep = ~ring | own
    return nodes[ptr[keep]], d[keep], nodes[keep], ring[keep]


def solve_links(links: DataFrame, k: int) -> DataFrame:
    """``head, d, x, is_cycle`` of ``links(a, b, w)``."""
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
        if not got:
            return
        a, b, w = (np.concatenate(x) for x in zip(*got, strict=True))
        head, d, x, ring = solve(a, b, k, w)
        for i in range(0, len(x), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(head[s]), pa.array(d[s]), pa.array(x[s]), pa.array(ring[s])], ["head", "d", "x", "is_cycle"])

    return links.select("a", "b", "w").coalesce(1).mapInArrow(run, "head bigint, d bigint, x bigint, is_cycle boolean")


def _links(x: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): b follows a in a unitig, of canonical k-mers x and their twins t; only junctions of the sides that count, ``first`` and ``last``.

    A k-mer never follows itself or its twin. A palindrome ends in a junction as its departing copy.
    """
    m, two = np.int64(dna.mask(k - 1)), t != x
    ends, begins = np.concatenate([np.where(two, x, x | dna.DEPART)[last], t[first & two]]), np.concatenate([x[first], t[last & two]])
    jl, il, nl = np.unique(ends & m, return_index=True, return_counts=True)
    jr, ir, nr = np.unique((begins & dna.mask(k)) >> 2, return_index=True, return_counts=True)
    jl, il, jr, ir = jl[nl == 1], il[nl == 1], jr[nr == 1], ir[nr == 1]
    _, at, to = np.intersect1d(jl, jr, assume_unique=True, return_indices=True)
    a, b = ends[il[at]], begins[ir[to]]
    pa_, pb = a & dna.mask(k), b & dna.mask(k)
    other = (pa_ != pb) & (twin(pa_, k) != pb)
    return a[other], b[other]


def _chains(bucket: np.ndarray, kmer: np.ndarray, k: int) -> pa.RecordBatch:
    here = np.zeros(BUCKETS, bool)
    here[bucket] = True
    x = np.unique(kmer)
    t = twin(x, k)
    first, last = (here[b] for b in buckets(x, k))
    a, b = _links(x, t, first, last, k)
    free = np.where(first, ~np.isin(x, b), False).astype(np.int8) + np.where(last, ~np.isin(np.where(t != x, x, x | dna.DEPART), a), False)
    alone, half = x[free == 2], x[(free == 1) & (first != last)]
    head, d, node, ring = solve(a, b, k) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    d = np.where(ring & (d == 0), np.int64(1) << 61, d)  # the base that leads back to a cycle's head is its last
    order = np.lexsort((d, head, ring))
    head, d, node, ring = head[order], d[order], node[order], ring[order]
    new = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (ring[1:] != ring[:-1])])) if len(head) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(head)) - 1 if len(head) else new
    moved = d > 0
    ends = np.cumsum(moved)[end] if len(head) else np.zeros(0, np.int64)
    rest = len(alone) + len(half)
    offsets = np.concatenate([[0], ends, np.full(rest, ends[-1] if len(ends) else 0)]).astype(np.int64)
    bases = BASES[(node & 3)[moved]]
    kind = np.concatenate([np.where(ring[new], RING, CHAIN), np.full(len(alone), SINGLE), np.full(len(half), HALF)]).astype(np.int32)
    some = np.concatenate([alone, half])
    cols = [kind, np.concatenate([head[new], some]), np.concatenate([node[end], some]), np.diff(offsets)]
    texts = pa.LargeStringArray.from_buffers(len(kind), pa.py_buffer(offsets), pa.py_buffer(bases)).cast(pa.string())
    return pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], texts], ["kind", "a", "b", "w", "bases"])


def bucketed(kmers: DataFrame, k: int) -> DataFrame:
    """``bucket, kmer``: each k-mer once a bucket of its two junctions, mostly one."""
    ship(kmers.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy()
            first, last = buckets(x, k)
            two = first != last
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([first, last[two]])), pa.array(np.concatenate([x, x[two]]))], ["bucket", "kmer"])

    return kmers.select("kmer").mapInArrow(run, "bucket int, kmer bigint")


def chains(rows: DataFrame, k: int) -> DataFrame:
    """``kind, a, b, w, bases`` of ``rows(bucket, kmer)`` that lie whole buckets together: chains from node a to node b, w bases after a's, and k-mers without links."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            yield _chains(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), k)

    return rows.select("bucket", "kmer").mapInArrow(run, "kind int, a bigint, b bigint, w bigint, bases string")


def _packed(texts: list[bytes], k: int) -> np.ndarray:
    """First k-mers of strings over ACGT."""
    return rolled(CODES[np.frombuffer(b"".join(s[:k] for s in texts), np.uint8)], k)[::k] if texts else np.zeros(0, np.int64)


def _turned(seq: bytes, k: int) -> bytes:
    """A cycle's sequence from its least oriented k-mer on; ``seq`` repeats the first k bases at its end."""
    n = len(seq) - k
    codes = CODES[np.frombuffer(seq, np.uint8)]
    other = 3 - codes[::-1]
    here, there = rolled(codes, k)[:n], rolled(other, k)[:n]
    codes, at = (codes, int(here.argmin())) if here.min() < there.min() else (other, int(there.argmin()))
    return BASES[codes[(at + np.arange(n + k - 1)) % n]].tobytes()


def named(rows: DataFrame, k: int) -> DataFrame:
    """Unitigs of ``rows(seq, is_cycle)``; a cycle's sequence ends in its first k bases."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cycle = b.column(1).to_numpy(zero_copy_only=False)
            seqs = [_turned(s, k) if c else s for s, c in zip(b.column(0).cast(pa.binary()).to_pylist(), cycle, strict=True)]
            head, tail = _packed(seqs, k), _packed([s[-k:] for s in seqs], k)
            n = np.array([len(s) - k + 1 for s in seqs], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(head, twin(head, k))), pa.array(seqs, pa.binary()).cast(pa.string()), pa.array(n), pa.array(head), pa.array(tail), pa.array(cycle)], ["unitig_id", "seq", "n_kmers", "head", "tail", "is_cycle"])

    return rows.select("seq", "is_cycle").mapInArrow(run, "unitig_id bigint, seq string, n_kmers int, head bigint, tail bigint, is_cycle boolean")


def unitig_kmers(unitigs: DataFrame, k: int) -> DataFrame:
    """``kmer, unitig_id, pos, strand, x``: each k-mer of ``unitigs(unitig_id, seq)``, canonical and as it stands there."""
    ship(unitigs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            texts = b.column(1).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for at, x in cut(texts, k):
                row = np.searchsorted(offsets, at, side="right") - 1
                canon = np.minimum(x, twin(x, k))
                yield pa.RecordBatch.from_arrays([pa.array(canon), pa.array(ids[row]), pa.array((at - offsets[row]).astype(np.int32)), pa.array(canon == x), pa.array(x)], ["kmer", "unitig_id", "pos", "strand", "x"])

    return unitigs.select("unitig_id", "seq").mapInArrow(run, "kmer bigint, unitig_id bigint, pos int, strand boolean, x bigint")
