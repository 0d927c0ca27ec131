import gzip

from pyspark.sql import functions as F

from strandloom.plans.graph import Graph
from strandloom.sources import fastx, files, gfa
from strandloom.streaming import incremental


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one two\nACGT\nAC\n>y\nGG\n\n>empty\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\r\nTT\r\nAA\r\n")
    (tmp_path / "c.fq").write_text("@r1 c\nACGT\n+\nIIII\n@r2\nGGCC\n+r2\n@III\n@r3\nTTTT\n+\n@@@@\n@bare\n\n+\n\n@r4\nA\n+\nI\n@end\n\n+\n\n")
    got = {(r.name, r.comment, r.seq) for r in fastx.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]).collect()}
    assert got == {("x", "one two", "ACGTAC"), ("y", "", "GG"), ("empty", "", ""), ("z", "", "TTAA")}
    got = {(r.name, r.seq, r.qual) for r in fastx.read_fastq(spark, str(tmp_path / "c.fq")).collect()}
    assert got == {("r1", "ACGT", "IIII"), ("r2", "GGCC", "@III"), ("r3", "TTTT", "@@@@"), ("bare", "", ""), ("r4", "A", "I"), ("end", "", "")}
    assert files.sniff(spark, str(tmp_path / "a.fa")) == "fasta" and files.sniff(spark, str(tmp_path / "c.fq")) == "fastq"
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fa\n{tmp_path}/c.fq\n")
    paths = files.expand(spark, str(tmp_path / "list.txt"))
    rows = files.read_sequences(spark, paths)
    assert {(r.file_id, r.name) for r in rows.collect()} == {(0, "x"), (0, "y"), (0, "empty"), (1, "r1"), (1, "r2"), (1, "r3"), (1, "bare"), (1, "r4"), (1, "end")}
    assert files.output_name("g", "gfa", True) == "g.gfa.gz" and files.output_name("g.fasta", "fasta") == "g.fasta"


def test_graph_round_trips(spark, tmp_path):
    seqs = ["TCATAGCTATGAAGGTGATTCCCT", "TCATAGCTATGACGGTGATTCCCT"]
    rows = spark.createDataFrame([("x", seqs[0]), ("y", seqs[1])], "file string, seq string")
    g = Graph.build(5, ref=rows, color_col="file")
    g.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"))
    assert back.equals(g) and {r.seq for r in back.unitigs.collect()} == {r.seq for r in g.unitigs.collect()}
    assert files.sniff(spark, str(tmp_path / "g")) == "graph"
    g.to_gfa(str(tmp_path / "g.gfa"), gzip=False)
    segments, links, tags = gfa.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert tags["KL"] == "5" and links.count() == g.edges.count() and segments.count() == 4
    plain = Graph(5, g.kmers)
    assert Graph.from_segments(segments, int(tags["KL"])).equals(plain)
    g.to_fasta(str(tmp_path / "g.fasta"))
    assert Graph.from_segments(fastx.read_fasta(spark, str(tmp_path / "g.fasta")), 5).equals(plain)
    (tmp_path / "two.gfa").write_text("H\tVN:Z:2.0\nS\ta\t5\tACGTA\nS\tb\t5\tCGTAC\nE\t*\ta+\tb-\t1\t5\t0\t4\t4M\n")
    segments, links, _ = gfa.read_gfa(spark, str(tmp_path / "two.gfa"))
    assert {(r.id, r.seq) for r in segments.collect()} == {("a", "ACGTA"), ("b", "CGTAC")} and [tuple(r) for r in links.collect()] == [("a", "+", "b", "-")]
    files.write_tsv(g.query(spark.createDataFrame([("q", seqs[0])], "name string, seq string")), str(tmp_path / "r.tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r.tsv")).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, s in enumerate(["ACGTACGGT", "ACGTA", "TTTTT"]):
        spark.createDataFrame([(s,)], "seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    incremental.stream_counts(stream, 5, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = incremental.counts_so_far(spark, str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] == 7 and incremental.counts_so_far(spark, str(tmp_path / "out"), 2).count() == 2
