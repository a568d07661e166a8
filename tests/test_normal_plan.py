"""The tables of normalisation stand in a plan once for each text, not once for each case of an expression."""

from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.sources import catalogue


def test_rules_have_small_plans(spark):
    records = catalogue.records(spark, "/root/testdata/sf0.001").drop("truth_key")
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(N.normalize_frame(records)) < 100_000
    assert size(records.select(N.basic(F.col("title")))) < 50_000


def test_frame_is_the_single_rules(spark):
    rows = [("Títle & é [Deluxé Edition] (2001 Remaster)", "Björk, The (2)"), ("ﬁ ½ 한", "V/A"), ("Á", "á"), ("", ""), ("ǆ ŉ", "Los Đặng"), (None, None)]
    got = N.normalize_frame(spark.createDataFrame([(*r, 1) for r in rows], "title string, artist_credit string, year int"))
    text, credit = (N.spelled_out(F.coalesce(c, F.lit(""))) for c in ("title", "artist_credit"))
    for column, rule in (("title_norm", N.title(text)), ("title_norm_full", N.basic(text)), ("title_qualifiers", N.qualifiers(text)), ("artist_norm", N.artist(credit)), ("artist_norm_full", N.artist_full(credit)), ("is_various_artists", N.is_various(credit))):
        assert got.filter(~F.col(column).eqNullSafe(rule)).count() == 0, column
