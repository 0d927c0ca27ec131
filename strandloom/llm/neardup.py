"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 2 bits differ in at most 2 of their 8 bytes, so a link
is guaranteed 6 shared positional bytes. The index is built over sets of positional bytes. Its first level
holds each of the 6 combinations of two byte pairs (four positional bytes); a link shares at least
one of them, and fingerprints alone in all their postings go. Its second level holds each of the 28
sets of six positional bytes: two fingerprints meet there exactly if they share the guaranteed number, so the
tally is taken by the index and no pair has to be listed to be counted. What meets is verified within
the 16 bits that a set leaves free: a fingerprint lists itself and its neighbours at one bit, and two
fingerprints differ in at most 2 bits exactly if they list a common one. Each such list is linked as a star, so
rows grow with the number of fingerprints, 28 and 17 for each at most, whatever the size of a group.

Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id
take part; a component whose ids are all null has a null component_id. Equal rows are kept. An empty table
gives an empty table. Long texts are read whole, their hashes summed in blocks. Only the id and text columns
are read by ``near_duplicates``; ``deduplicate*`` carry all columns under names that can't clash.

``deduplicate_similar`` links by the share of common shingles instead. Its fingerprint has a byte for each of
POSITIONS min-hashes; a posting holds HELD positional bytes. Members of a posting are counted
against its leader: pairs that share fewer than LEAST positional bytes go, the rest is verified on whole shingle
sets. Links to leaders make components; members outside their leader's component are then
counted against all members of other components, by the same filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components

from .scratch import bounded_batches, forget, keyed, lean, materialize

BYTES = 8
#: First level: two of the four byte pairs. Second level: all but two of the bytes.
FOURS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
SIXES = list(combinations(range(BYTES), BYTES - 2))
#: Positional bytes of a min-hash fingerprint and how many a posting holds. Of pairs with a similarity of 0.8, 2 in 10,000 share no posting (calculated).
POSITIONS, HELD = 252, 7
#: Shared positional bytes that a pair needs. At 0.8 the mean is 202 and the deviation 6.4, so 1 in 1000 have fewer (calculated).
LEAST = 182


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of a text's shingles in order; one of all words where the text is shorter, none where it has no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, n = b" ".join(words), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    last = max(1, n - size + 1)
    lo = starts[:last].tolist()
    hi = (starts[min(size, n) :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(lo, hi, strict=True)], dtype="<u8")


def simhash(text: str | None, size: int = 3) -> int:
    """Fingerprint of one text; bits set in over half of the shingle hashes."""
    hashes = shingles(text, size)
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # long texts in blocks
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << b for b in range(64) if 2 * total[b] > len(hashes))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint as a signed long, for every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(s, size) for s in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")


def _held(fp: Column, held: tuple[int, ...]) -> Column:
    """The fingerprint with only these bytes left."""
    return fp.bitwiseAND(_signed(sum(255 << (8 * i) for i in held)))


def _level(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """``fp, held, value``: a posting is the number of a set of positions and their bytes; those of one member are left out."""
    entries = F.array(*[F.struct(F.lit(n).alias("held"), _held(F.col("fp"), h).alias("value")) for n, h in enumerate(sets)])
    index = fps.select("fp", F.explode(entries).alias("e")).select("fp", "e.held", "e.value")
    shared = index.groupBy(F.col("held").alias("s_held"), F.col("value").alias("s_value")).agg(F.count("*").alias("n")).where("n > 1")
    return index.join(shared, (F.col("held") == F.col("s_held")) & (F.col("value") == F.col("s_value"))).select("fp", "held", "value")


def _near(fp: Column, six: tuple[int, ...]) -> Column:
    """The fingerprint and those that differ from it in one bit outside the set."""
    free = [0, *(1 << (8 * i + b) for i in range(BYTES) if i not in six for b in range(8))]
    return F.array(*[fp.bitwiseXOR(_signed(m)) for m in free])


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes of two longs agree: the bits of each byte of the difference are folded into one."""
    x = a.bitwiseXOR(b)
    for by, mask in ((4, 0x0F), (2, 0x03), (1, 0x01)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by)).bitwiseAND(_signed(int.from_bytes(bytes([mask]) * 8)))
    return BYTES - F.bit_count(x)


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """``a, b``: links between different fingerprints that connect all pairs within ``bits`` (at most 2).

    ``fps`` has one column ``fp`` of distinct values, a written table. The links of a common neighbour go to its
    smallest fingerprint; for fewer than 2 bits its members, 17 at most, are compared.
    """
    if not 0 <= bits <= 2:
        raise ValueError("six shared positional bytes are guaranteed for at most 2 bits")
    some = materialize(_level(fps, FOURS).select("fp").distinct(), "postings")
    met = _level(some, SIXES)
    lists = F.coalesce(*[F.when(F.col("held") == n, _near(F.col("fp"), six)) for n, six in enumerate(SIXES)])
    near = met.select("held", "fp", F.explode(lists).alias("key")).groupBy("held", "key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 17 members
    if bits == 2:
        pairs = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:
        pairs = near.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b"))
    verified = (F.col("a") < F.col("b")) & (shared_bytes(F.col("a"), F.col("b")) >= BYTES - bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return pairs.where(verified).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` of every row; component_id is the smallest id reachable."""
    seen = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = materialize(seen.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fp")
    labels = connected_components(links(distinct.select("fp"), bits))
    inside = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = inside.groupBy("component").agg(F.min("least").alias("component_id"))
    # Fingerprints on their own keep their smallest id; only linked ones are looked up.
    linked = labels.join(roots, "component").select(F.col("node").alias("l_fp"), F.col("component_id").alias("l_id"))
    named = materialize(distinct.join(linked, distinct["fp"] == linked["l_fp"], "left").select(F.col("fp").alias("n_fp"), F.coalesce("l_id", "least").alias("component_id")), "components")
    out = seen.join(named, seen["fp"] == named["n_fp"], "left")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _first_rows(rows: DataFrame) -> DataFrame:
    """``row_file, row_at`` of the row with the smallest ``d_id`` of each ``root``; of equal ids any one, of rows without ids one."""
    least = F.min(F.struct(F.col("d_id").isNull(), F.col("d_id"), F.col("row_file"), F.col("row_at")))
    return rows.groupBy("root").agg(least.alias("m")).select(F.col("m.row_file").alias("k_file"), F.col("m.row_at").alias("k_at"))


def _keep(rows: DataFrame, kept: DataFrame, names: list[str]) -> DataFrame:
    return rows.join(kept, (F.col("row_file") == F.col("k_file")) & (F.col("row_at") == F.col("k_at")), "left_semi").drop("row_file", "row_at").toDF(*names)


def deduplicate(docs: DataFrame, size: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id (of equal ids any one, of rows without ids one)."""
    rows, at = keyed(docs)
    key = F.struct(F.col(at[id_col]).alias("d_id"), "row_file", "row_at")
    found = materialize(fingerprints(rows.select(key.alias("k"), F.col(at[text_col]).alias("t")), size, "k", "t").select("k.*", "fp"), "fingerprints")
    distinct = materialize(found.select("fp").distinct(), "distinct-fp")
    labels = connected_components(links(distinct, bits))
    rooted = found.join(labels, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    return _keep(rows, _first_rows(rooted), docs.columns)


MIXES = np.random.default_rng(42).integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(found: np.ndarray) -> np.ndarray:
    """The least product of a shingle hash with each of POSITIONS odd numbers; the hashes are random, so their orders are unrelated."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 256):  # in blocks that stay near the core
        np.minimum(least, (found[i : i + 256, None] * MIXES).min(axis=0), out=least)
    return least


def postings(found: np.ndarray) -> np.ndarray:
    """A fingerprint of POSITIONS bytes as longs, HELD bytes each under their group's number: these are its postings.

    A byte is that of a hash of a min-hash, which itself is small.
    """
    least = min_hashes(found)
    held = (((least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(56)).astype(np.int64).reshape(-1, HELD)
    out = np.arange(len(held), dtype=np.int64)
    for column in held.T:
        out = (out << 8) | column
    return out


def signatures(docs: DataFrame, size: int, key_col: str, text_col: str) -> DataFrame:
    """``key, same, words``: a digest of the shingle set, equal for equal sets, and its fingerprint (``postings``); null for texts without words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, words = [], []
            for text in b.column(1):
                found = np.unique(shingles(text.as_py(), size))
                same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                words.append(postings(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(words, pa.list_(pa.int64()))], ["key", "same", "words"])

    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), f"key {rows.schema['key'].dataType.simpleString()}, same binary, words array<bigint>")


def shingle_sets(docs: DataFrame, size: int, key_col: str, text_col: str) -> DataFrame:
    """``node, found``: the different shingle hashes of every row."""
    bounded_batches(docs.sparkSession, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingles(text.as_py(), size)).view(np.int64) for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    rows = docs.select(F.col(key_col).alias("node"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "node bigint, found array<bigint>")


def postings_of(prints: DataFrame) -> DataFrame:
    """``posting, node, n`` of ``prints(node, words)``, n the members of a posting. Postings of one member are left out."""
    index = prints.select(F.explode("words").alias("posting"), "node")
    shared = index.groupBy(F.col("posting").alias("s_posting")).agg(F.count("*").alias("n")).where("n > 1")
    return index.join(shared, F.col("posting") == F.col("s_posting")).select("posting", "node", "n")


def with_leaders(index: DataFrame) -> DataFrame:
    """``posting, node, leader`` of a written ``index(posting, node, n)``: the member that meets most others leads, for in a group around an original that is the original."""
    met = index.groupBy(F.col("node").alias("d_node")).agg(F.sum("n").alias("met"))
    ranked = index.join(met, F.col("node") == F.col("d_node"))
    first = ranked.groupBy(F.col("posting").alias("l_posting")).agg(F.max(F.struct("met", "node")).alias("m"))
    return index.join(first, F.col("posting") == F.col("l_posting")).select("posting", "node", F.col("m.node").alias("leader"))


def tally(x: Column, y: Column) -> Column:
    """How many of the POSITIONS bytes of two fingerprints agree; the numbers of their groups always do."""
    return F.aggregate(F.zip_with(x, y, shared_bytes), F.lit(-(POSITIONS // HELD)), lambda acc, n: acc + n)


def count_filter(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that share LEAST positional bytes or more."""
    x, y = prints.select(F.col("node").alias("x_node"), F.col("words").alias("x")), prints.select(F.col("node").alias("y_node"), F.col("words").alias("y"))
    both = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    return both.where(tally(F.col("x"), F.col("y")) >= LEAST).select("a", "b")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``sim``, the share of common shingles of both."""
    x, y = sets.select(F.col("node").alias("x_node"), F.col("found").alias("x")), sets.select(F.col("node").alias("y_node"), F.col("found").alias("y"))
    both = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node")).select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("sum"))
    return both.select("a", "b", (F.col("n") / (F.col("sum") - F.col("n"))).alias("sim"))


def similar_links(index: DataFrame, prints: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``a, b``: verified links that connect all pairs of ``similarity`` or more that share a posting of ``index(posting, node, leader)``.

    Every member is counted against its posting's leader, one row a member. Then members that are not in their
    leader's component are counted against the posting's members of other components. A pair is left out only if it lies in
    one component. The second step costs a comparison for each such member and each other member, so a posting of
    a group of copies is linear; one whose members share more than half their shingles without being linked is not.
    """
    def verified(pairs: DataFrame) -> DataFrame:
        return similarities(pairs, sets).where(F.col("sim") >= similarity).select("a", "b")

    starred = index.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(verified(count_filter(starred, prints)), "stars")
    label = connected_components(stars)
    of = lambda node, name: label.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(name))
    placed = index.join(of("node", "mine"), F.col("node") == F.col("mine_node"), "left").join(of("leader", "led"), F.col("leader") == F.col("led_node"), "left")
    placed = materialize(placed.select("posting", "node", F.coalesce("mine", "node").alias("mine"), F.coalesce("led", "leader").alias("led")), "placed")
    outside = placed.where("mine <> led").select(F.col("posting").alias("o_posting"), F.col("node").alias("o_node"), F.col("mine").alias("o_mine"))
    words = prints.select(F.col("node").alias("w_node"), F.col("words"))
    x = outside.join(words, F.col("o_node") == F.col("w_node")).select("o_posting", "o_node", "o_mine", F.col("words").alias("x"))
    mixed = outside.select(F.col("o_posting").alias("m_posting")).distinct()
    y = placed.join(mixed, F.col("posting") == F.col("m_posting")).join(words, F.col("node") == F.col("w_node")).select("posting", "node", "mine", "led", F.col("words").alias("y"))
    # A pair is counted in the first posting that both are in; one of two such members is met from both sides, once is enough.
    first = F.coalesce(F.get(F.array_intersect("x", "y"), F.lit(0)), F.col("posting")) == F.col("posting")
    meet = (F.col("posting") == F.col("o_posting")) & (F.col("mine") != F.col("o_mine")) & ((F.col("mine") == F.col("led")) | (F.col("o_node") < F.col("node"))) & first & (tally(F.col("x"), F.col("y")) >= LEAST)
    crossing = x.join(y, meet).select(F.least("o_node", "node").alias("a"), F.greatest("o_node", "node").alias("b")).distinct()
    return stars.union(verified(crossing))


def deduplicate_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of texts that share ``similarity`` or more of their shingles: the row ``deduplicate`` would take.

    LEAST and HELD are chosen for 0.8; a lower ``similarity`` misses links.
    """
    rows, at = keyed(docs)
    key = F.struct(F.col(at[id_col]).alias("d_id"), "row_file", "row_at")
    found = materialize(signatures(rows.select(key.alias("k"), F.col(at[text_col]).alias("t")), size, "k", "t").select("key.*", "same", "words"), "signatures")
    first = F.min(F.struct("row_file", "row_at"))
    distinct = found.groupBy(F.col("same").alias("n_same")).agg(F.first("words").alias("words"), first["row_file"].alias("n_file"), first["row_at"].alias("n_at"))
    prints = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "prints")
    met = materialize(postings_of(prints), "similar-postings")
    index = materialize(with_leaders(met), "led-postings")
    wanted = prints.join(index.select(F.col("node").alias("i_node")).distinct(), F.col("node") == F.col("i_node"), "left_semi").select("n_file", "n_at", "node")
    texts = rows.select("row_file", "row_at", F.col(at[text_col]).alias("t")).join(wanted, (F.col("row_file") == F.col("n_file")) & (F.col("row_at") == F.col("n_at"))).select("node", "t")
    sets = materialize(shingle_sets(texts, size, "node", "t"), "shingle-sets")
    labels = connected_components(similar_links(index, prints, sets, similarity)).select(F.col("node").alias("l_node"), "component")
    forget(sets, index, met)
    rooted = found.join(prints.select("n_same", "node"), F.col("same") == F.col("n_same")).join(labels, F.col("node") == F.col("l_node"), "left")
    kept = materialize(_first_rows(rooted.withColumn("root", F.coalesce("component", "node"))), "kept-rows")
    forget(found, prints)
    return _keep(rows, kept, docs.columns)
