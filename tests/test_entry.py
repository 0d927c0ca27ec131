import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["kmer_cardinality", "query_count", "inexact_any", "color_sharing", "unitig_stats"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, DATA).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
