"""Patterns of true pairs as the query's SQL names them: from normalised names alone."""

from weftline.functions.normalize import normalize_frame
from weftline.operators import profile
from weftline.plans import queries

RECORD = "native_id string, title string, artist_credit string, year int, primary_type string"
A = [("a1", "Abbey Road", "The Beatles", 1969, "Album"), ("a3", "Björk", "Björk", None, "Album"), ("a5", "Hits", "", 1990, "Album")]
B = [("10", "Abbey Road [Remaster Edition]", "Beatles", 1971, None), ("8", "Bjork", "Bjork (2)", 1993, None), ("6", "Hits", "Duo", 1990, None)]
TRUTH = [("a1", "10"), ("a3", "8"), ("a5", "6")]


def test_the_query_names_the_patterns_of_its_sql(spark, monkeypatch):
    a, b = (normalize_frame(spark.createDataFrame(x, RECORD)) for x in (A, B))
    truth = spark.createDataFrame(TRUTH, "a_id string, b_id string")
    monkeypatch.setattr(queries.catalogue, "sides", lambda *_: (a, b))
    monkeypatch.setattr(queries.catalogue, "links", lambda *_: truth)
    got = {r["a_id"]: r["pattern"] for r in queries.QUERIES["pair_patterns"](spark, "").collect()}
    assert got == {"a1": "article_position", "a3": "year_only", "a5": "other"}
    # the operator still tells editions and numbers
    whole = {r["a_id"]: r["pattern"] for r in profile.classified_pairs(truth, a, b).collect()}
    assert whole["a1"] == "edition_qualifier" and whole["a3"] == "numeric_disambiguator" and whole["a5"] == "artist_credit_join"
