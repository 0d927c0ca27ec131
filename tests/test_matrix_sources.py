"""The result matrices have a column for every source of the table."""

import pytest
from pyspark.sql import functions as F

from strandloom.plans import catalog

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["color_count_matrix", "color_presence_matrix"])
def test_sources_outside_the_list(spark, tmp_path, name):
    old = {r["name"]: r for r in catalog.QUERIES[name](spark, DATA).collect()}
    assert list(next(iter(old.values())).asDict()) == ["name", *catalog.SOURCES]
    most = max(catalog.SOURCES, key=lambda s: sum(r[s] for r in old.values()))
    assert name == "color_presence_matrix" or sum(r[most] for r in old.values()) > 0  # no item has half of its k-mers in a source here
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.withColumn("source", F.when(F.col("source") != most, F.concat(F.lit("x"), "source"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    new = {r["name"]: r for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert old.keys() == new.keys()
    for k, r in old.items():
        assert all(new[k]["null" if s == most else f"x{s}"] == r[s] for s in catalog.SOURCES)
