"""The graph: immutable, made of DataFrames, every change giving a new one."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import clean, edit, kmers, mapping, payload, search, walk
from strandloom.operators import colors as color_ops
from strandloom.operators import compact as compaction
from strandloom.sources import fastx, gfa, store

from .stage import materialize, number_rows


@dataclass(frozen=True)
class Graph:
    """``kmers(kmer)``, and optionally ``colors(kmer, color)``; unitigs, index and edges are made when asked for."""

    k: int
    kmers: DataFrame
    colors: DataFrame | None = None
    g: int | None = None
    made: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        dna.check_k(self.k)
        if self.g is None:
            object.__setattr__(self, "g", dna.default_g(self.k))
        if not 1 <= self.g <= self.k - 2:
            raise ValueError("g must be from 1 to k - 2")

    @property
    def spark(self) -> SparkSession:
        return self.kmers.sparkSession

    @classmethod
    def build(cls, k: int, seq: DataFrame | None = None, ref: DataFrame | None = None, min_count: int = 2, g: int | None = None, color_col: str | None = None, clip_tips: bool = False, delete_isolated: bool = False) -> Graph:
        """K-mers of ``seq`` records seen ``min_count`` times or more, and all of ``ref`` records; then cleaned, then colored."""
        parts = []
        if seq is not None:
            parts.append(kmers.solid_kmers(seq, k, min_count))
        if ref is not None:
            parts.append(kmers.distinct_kmers(ref, k))
        if not parts:
            raise ValueError("seq or ref records are needed")
        table = materialize(parts[0] if len(parts) == 1 else edit.union(*parts), "graph-kmers")
        graph = cls(k, table, g=g)
        if clip_tips or delete_isolated:
            graph = graph.simplify(clip_tips, delete_isolated)
        if color_col:
            inputs = [r.select(color_col, "seq") for r in (seq, ref) if r is not None]
            graph = graph.color(inputs[0] if len(inputs) == 1 else inputs[0].unionByName(inputs[1]), color_col)
        return graph

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """A graph written by ``save``: as it was, not compacted again."""
        s = store.read(spark, path)
        return cls(s["k"], s["index"].select("kmer"), s["colors"], s["g"], (s["unitigs"], s["index"]))

    @classmethod
    def from_segments(cls, segments: DataFrame, k: int, g: int | None = None) -> Graph:
        """From unitig sequences (``seq``) of a GFA or FASTA file."""
        return cls(k, materialize(kmers.distinct_kmers(segments, k), "graph-kmers"), g=g)

    @cached_property
    def _compact(self) -> tuple[DataFrame, DataFrame]:
        if self.made:
            return self.made
        return compaction.compact(self.kmers, self.k)

    @property
    def unitigs(self) -> DataFrame:
        return self._compact[0]

    @property
    def index(self) -> DataFrame:
        return self._compact[1]

    @cached_property
    def edges(self) -> DataFrame:
        return compaction.unitig_edges(self.unitigs, self.k)

    def stats(self) -> DataFrame:
        """``unitigs, kmers, length, cycles, longest``."""
        return self.unitigs.agg(F.count("*").alias("unitigs"), F.sum("n_kmers").alias("kmers"), F.sum(F.length("seq")).alias("length"), F.sum(F.col("is_cycle").cast("long")).alias("cycles"), F.max("n_kmers").alias("longest"))

    def degrees(self) -> DataFrame:
        return compaction.degrees(self.unitigs, self.edges)

    def _with(self, table: DataFrame) -> Graph:
        colors = None if self.colors is None else self.colors.join(table, "kmer", "left_semi")
        return replace(self, kmers=table, colors=colors, made=None)

    def color(self, records: DataFrame, color_col: str) -> Graph:
        table = materialize(color_ops.color_kmers(self.kmers, records, self.k, color_col), "graph-colors")
        return replace(self, colors=table)

    def add(self, records: DataFrame) -> Graph:
        return self._with(materialize(edit.add_sequences(self.kmers, records, self.k), "graph-kmers"))

    def remove(self, records: DataFrame) -> Graph:
        return self._with(materialize(edit.remove_sequences(self.kmers, records, self.k), "graph-kmers"))

    def remove_unitigs(self, ids: DataFrame) -> Graph:
        return self._with(materialize(edit.remove_unitigs(self.unitigs, ids, self.k), "graph-kmers"))

    def simplify(self, clip_tips: bool = True, delete_isolated: bool = True) -> Graph:
        """The unitigs that stay are joined at their ends; k-mers are not compacted again."""
        unitigs = materialize(clean.simplified(self.unitigs, self.edges, self.k, clip_tips, delete_isolated), "unitigs")
        index = compaction.unitig_kmers(unitigs, self.k).drop("x")
        return replace(self._with(index.select("kmer")), made=(unitigs, index))

    def merge(self, *others: Graph) -> Graph:
        """Union of graphs of the same k and g; colors are kept by name."""
        if any((o.k, o.g) != (self.k, self.g) for o in others):
            raise ValueError("graphs to merge must have the same k and g")
        table = materialize(edit.union(self.kmers, *(o.kmers for o in others)), "graph-kmers")
        colored = [x.colors.select("kmer", "color") for x in (self, *others) if x.colors is not None]
        colors = None
        for c in colored:
            colors = c if colors is None else colors.union(c)
        return replace(self, kmers=table, colors=None if colors is None else colors.distinct(), made=None)

    def update(self, seq: DataFrame | None = None, ref: DataFrame | None = None, min_count: int = 2, color_col: str | None = None, clip_tips: bool = False, delete_isolated: bool = False) -> Graph:
        """A graph of new inputs with this one's k and g, merged into it, then cleaned."""
        out = self.merge(Graph.build(self.k, seq, ref, min_count, self.g, color_col))
        return out.simplify(clip_tips, delete_isolated) if clip_tips or delete_isolated else out

    def equals(self, other: Graph) -> bool:
        """Same k-mers, and same colors where both have them."""
        if self.k != other.k:
            return False
        d = edit.difference_size(self.kmers, other.kmers).collect()[0]
        if d["only_a"] or d["only_b"]:
            return False
        if self.colors is None or other.colors is None:
            return self.colors is None and other.colors is None
        d = edit.difference_size(self.colors, other.colors, ["kmer", "color"]).collect()[0]
        return not (d["only_a"] or d["only_b"])

    def checksum(self) -> DataFrame:
        return edit.checksum(self.kmers)

    def query(self, records: DataFrame, mode: str = "count", min_ratio: float | None = None, min_colors: int | None = None, name_col: str = "name", approximate: bool = False) -> DataFrame:
        """Modes count, ratio and presence (needs min_ratio; min_colors with colors). A file of records is a query if ``name_col`` names the file."""
        if mode not in ("count", "ratio", "presence"):
            raise ValueError(f"unknown mode {mode}")
        if (mode == "presence") != (min_ratio is not None) or (min_colors is not None and (min_ratio is None or self.colors is None)):
            raise ValueError("presence goes with min_ratio, and min_colors with presence on a colored graph")
        if self.colors is None:
            found = (search.search_inexact if approximate else search.search)(self.kmers, records, self.k, name_col)
            if mode == "presence":
                return found.select("name", search.enough(F.col("n_found"), F.col("n_query"), min_ratio).cast("int").alias("present"))
            return found
        found = (search.search_colors_inexact if approximate else search.search_colors)(self.colors, records, self.k, name_col)
        if mode != "presence":
            return found
        present = search.present_colors(found, min_ratio)
        return present if min_colors is None else search.in_colors(present, search.windows(records, self.k, name_col), min_colors)

    def find(self, records: DataFrame, name_col: str = "name", ends_only: bool = False) -> DataFrame:
        return search.find(self.index, records, self.k, name_col, ends_only=ends_only, sizes=self.unitigs)

    def find_minimizers(self, minimizers: DataFrame) -> DataFrame:
        return search.find_minimizers(self.index, minimizers, self.k, self.g)

    def mappings(self, records: DataFrame, name_col: str = "name") -> DataFrame:
        return search.mapping_runs(self.index, records, self.k, name_col)

    def accessors(self, mappings: DataFrame) -> DataFrame:
        return mapping.accessors(mappings, self.unitigs, self.k)

    def with_data(self, kmer_data: DataFrame, data: payload.Payload) -> DataFrame:
        return payload.unitig_data(self.unitigs, self.index, kmer_data, data)

    def components(self) -> DataFrame:
        return walk.components(self.unitigs, self.edges)

    def superbubbles(self, most: int | None = None) -> DataFrame:
        return walk.superbubbles(self.edges, most)

    def save(self, path: str) -> None:
        store.write(path, self.k, self.g, self.unitigs, self.index, self.colors)

    def to_gfa(self, path: str, gzip: bool = True) -> None:
        gfa.write_gfa(self.unitigs, self.edges, path, self.k, self.g, gzip=gzip)

    def to_fasta(self, path: str, gzip: bool = True) -> None:
        fastx.write_fasta(number_rows(self.unitigs, ["unitig_id"], "number"), path, gzip=gzip)
