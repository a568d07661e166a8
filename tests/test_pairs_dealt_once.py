"""Features that need no Python are found where the pairs are made: the pairs are dealt once, not once for each look-up."""

import pytest

from weftline.operators import blocking, features
from weftline.plans import queries
from test_large_blocks import keyed


def odd(spark, side, n, seed):
    """Some ids are held by two or three records, some are null; records of an id differ, or do not."""
    return keyed(spark, side, n, seed).selectExpr("case when int(substr(native_id, 2)) % 11 = 3 then null when int(substr(native_id, 2)) % 5 = 1 then concat(substr(native_id, 1, 1), int(substr(native_id, 2)) % 3) else native_id end as native_id", "* except (native_id)", "artist_norm as artist_norm_full", "case when year_norm = 1990 then array('deluxe') end as title_qualifiers")


@pytest.mark.parametrize("cap", [1, 4, 1000])
def test_as_looked_up(spark, cap):
    a, b = odd(spark, "a", 60, 1), odd(spark, "b", 80, 2)
    whole = blocking.capped(blocking.union_pairs(blocking.pair_keys(blocking.key_frame(a), blocking.key_frame(b))), cap)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(features.native_features(a, b, cap)) == rows(features.pair_features(whole, a, b, fuzzy=False))


@pytest.mark.parametrize("made,exchanges", [(queries.all_decisions, 1), (queries.QUERIES["pair_features_fuzzy"], 2)])
def test_pairs_are_dealt_once(spark, made, exchanges):
    """After the join that makes the pairs, one exchange by a_id, none for the cap and the decisions; similarities need one more, by b_id."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    joined = next(i for i, x in enumerate(lines) if "Join [kinds#" in x and "LeftSemi" not in x and "LeftOuter" not in x)
    assert sum("Exchange hashpartitioning(a_id" in x or "Exchange hashpartitioning(b_id" in x or "Exchange hashpartitioning(method" in x or "Exchange hashpartitioning(concat" in x for x in lines[:joined]) == exchanges
