"""Pairs with similarities are made, capped and given their texts where a group of A ids is: no pair is exchanged."""

import pytest

from test_pairs_dealt_once import odd
from weftline.operators import blocking, features
from weftline.plans import queries


@pytest.mark.parametrize("cap", [1, 4, 1000])
def test_as_looked_up(spark, cap):
    a, b = odd(spark, "a", 60, 1), odd(spark, "b", 80, 2)
    whole = blocking.capped(blocking.union_pairs(blocking.pair_keys(blocking.key_frame(a), blocking.key_frame(b))), cap)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(features.candidate_features(a, b, cap)) == rows(features.pair_features(whole, a, b))


def test_an_id_is_in_one_group(spark):
    a = odd(spark, "a", 200, 1)
    got = blocking.id_groups(a, 8).collect()
    assert sorted(r["native_id"] for r in got) == sorted(r[0] for r in a.select("native_id").distinct().collect() if r[0] is not None)
    assert len({r["a_ids"] for r in got}) > 1


def test_no_pair_is_exchanged(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES["pair_features_fuzzy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    made = next((i for i, x in enumerate(lines) if "Generate explode(_as#" in x), None)
    assert made is not None
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    path, at = [], depth(lines[made])  # what lies between the pairs and the result
    for x in reversed(lines[:made]):
        if depth(x) < at:
            path, at = [*path, x], depth(x)
    assert any("Window" in x for x in path) and not [x for x in path if "Exchange" in x]
