"""Every list entry can match, however many labels or path parts it has."""

from pyspark.sql import functions as F

from strandloom.llm import urlfilter


def test_long_keys_match(spark):
    caps = [(1, "http://example.org/a/b/c/d"), (2, "http://example.org/a/b"), (3, "http://x.a.b.c.d.e.f.example.org/p"), (4, "http://f.example.org/a/b/c"), (5, "http://sub.other.org/a")]
    c = spark.createDataFrame(caps, "page_id int, url string").withColumn("fetched", F.to_date(F.lit("2024-05-01")))
    made = [("example.org/a/b/c", "block"), ("b.c.d.e.f.example.org", "block"), ("example.org", "allow")]
    e = spark.createDataFrame(made, "key string, action string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    got = {r.page_id: (r.matched_key, r.blocked) for r in urlfilter.filter_urls(c, e).collect()}
    assert got == {1: ("example.org/a/b/c", True), 2: ("example.org", False), 3: ("b.c.d.e.f.example.org", True), 4: ("example.org", False), 5: (None, False)}


def test_any_length_matches(spark):
    deep = "http://a.b.c.d.e.f.g.h.evil.example.org/1/2/3/4/5?q"
    caps = [(1, deep), (2, "http://good.com@x@evil.org/"), (3, "http://evil.org./"), (4, "http://www.evil.org/de"), (5, "http://com/"), (6, "http://[::1]:80/x"), (7, "HTTP://A.B.C.D.E.F.G.H.EVIL.example.org./1/2/3/4/5/6")]
    c = spark.createDataFrame(caps, "page_id int, url string").withColumn("fetched", F.to_date(F.lit("2024-05-01")))
    made = ["c.d.e.f.g.h.evil.example.org", "a.b.c.d.e.f.g.h.evil.example.org/1/2/3/4", "evil.org.", "[::1]"]
    e = spark.createDataFrame([(k, "block") for k in made], "key string, action string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    got = {r.page_id: (r.matched_key, r.blocked) for r in urlfilter.filter_urls(c, e).collect()}
    path = "a.b.c.d.e.f.g.h.evil.example.org/1/2/3/4"
    assert got == {1: (path, True), 2: ("evil.org", True), 3: ("evil.org", True), 4: ("evil.org", True), 5: (None, False), 6: ("[::1]", True), 7: (path, True)}
