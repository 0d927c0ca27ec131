"""FASTQ records of several lines, blank lines and files that can't be parsed."""

import pytest

from strandloom.sources import fastx


def test_lines_and_blanks(spark, tmp_path):
    (tmp_path / "multi.fq").write_text("@a one\nACGT\nAC\n+\nIIII\n@I\n@b\nGG\n+b\n@@\n@c\n\n+\n\n@d\nTT\nT\n+\n@\n+I\n")
    (tmp_path / "blank.fq").write_text("@x\nACGT\n+\nIIII\n@y\nGG\n+\nII\n\n")
    (tmp_path / "plain.fq").write_text("@p\r\nAC\r\n+\r\nII\r\n@q\r\nGT\r\n+\r\n@I\r\n")
    got = {(r.name, r.comment, r.seq, r.qual) for r in fastx.read_fastq(spark, [str(tmp_path / f"{n}.fq") for n in ("multi", "blank", "plain")]).collect()}
    want = {("a", "one", "ACGTAC", "IIII@I"), ("b", "", "GG", "@@"), ("c", "", "", ""), ("d", "", "TTT", "@+I")}
    assert got == want | {("x", "", "ACGT", "IIII"), ("y", "", "GG", "II"), ("p", "", "AC", "II"), ("q", "", "GT", "@I")}


@pytest.mark.parametrize("text", ["@x\nACGT\n+\nIII\n", "@x\nACGT\n+\nIIIII\n", "x\nACGT\n+\nIIII\n"])
def test_what_cannot_be_parsed_raises(spark, tmp_path, text):
    (tmp_path / "bad.fq").write_text(text)
    with pytest.raises(Exception, match="bad.fq"):
        fastx.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
