from collections import defaultdict

import pytest

from weftline.operators import blocking
from weftline.plans.queries import QUERIES
from weftline.schemas import KEY_TYPES
from weftline.sources import catalogue

SMALL = "/root/testdata/sf0.01"


def brute_force(spark, phonetic: bool, cap: int) -> set[tuple[str, str]]:
    """The pairs that share a key, without joins or windows: most shared key types first, then the smaller B id."""
    a, b = catalogue.sides(spark, SMALL, phonetic)
    holders, shared = defaultdict(set), defaultdict(set)
    for r in blocking.key_frame(b).collect():
        holders[r["key_type"], r["key"]].add(r["native_id"])
    for r in blocking.key_frame(a).collect():
        for other in holders[r["key_type"], r["key"]]:
            shared[r["native_id"], other].add(r["key_type"])
    by_a = defaultdict(list)
    for (x, y), kinds in shared.items():
        by_a[x].append((-len(kinds), y))
    return {(x, y) for x, found in by_a.items() for _, y in sorted(found)[:cap]}


def test_the_proxy_has_records_for_every_key(spark):
    kinds = {r[0] for r in QUERIES["block_keys_phonetic"](spark, SMALL).select("key_type").distinct().collect()}
    assert kinds == set(KEY_TYPES)
    a, _ = catalogue.sides(spark, SMALL)
    various = a.filter("is_various_artists")
    assert various.count() > 5 and {r[0] for r in blocking.key_frame(various).select("key_type").distinct().collect()} == {"k_title3", "k_title_sorted"}


@pytest.mark.parametrize("name, phonetic", [("pair_features_fuzzy", True), ("block_candidates", False), ("block_candidates_phonetic", True)])
def test_candidates_are_all_up_to_the_cap(spark, name, phonetic):
    found = {(r["a_id"], r["b_id"]): r["block_keys"] for r in QUERIES[name](spark, SMALL).select("a_id", "b_id", "block_keys").collect()}
    assert set(found) == brute_force(spark, phonetic, blocking.CAP)
    assert ("k_phonetic" in found.values()) == phonetic  # shared by nothing else


def test_a_small_cap_keeps_the_best(spark):
    a, b = catalogue.sides(spark, SMALL)
    assert {(r["a_id"], r["b_id"]) for r in blocking.candidates(a, b, 3).collect()} == brute_force(spark, False, 3)
    over = blocking.overflow(blocking.union_pairs(blocking.pair_keys(blocking.key_frame(a), blocking.key_frame(b))), 3).first()
    assert over["a_over_cap"] > 0 and over["pairs_dropped"] == len(brute_force(spark, False, 10**6)) - len(brute_force(spark, False, 3))


def test_completeness_with_the_phonetic_key(spark):
    got = {r["measure"]: r["found"] for r in QUERIES["pair_completeness_phonetic"](spark, SMALL).collect()}
    links = {(r["a_id"], r["b_id"]) for r in catalogue.links(spark, SMALL).collect()}
    assert got["after_cap"] == len(links & brute_force(spark, True, blocking.CAP)) and got["k_phonetic"] > 0


def test_the_learned_method_has_the_references_size(spark, monkeypatch):
    from weftline.plans import queries

    class Seen(Exception):
        pass

    def fit(features, truth, **sizes):
        raise Seen(sizes)

    monkeypatch.setattr(queries.methods, "fit_learned", fit)
    try:
        QUERIES["learned_decisions"](spark, SMALL)
    except Seen as seen:
        assert seen.args[0] == {"trees": 300, "least_leaf": 50}
    else:
        raise AssertionError("the learned method was not fitted")
