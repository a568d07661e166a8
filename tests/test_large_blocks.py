"""Candidates of large blocks without their pairs."""

import random

import pytest

from weftline.operators import blocking
from weftline.plans import queries


def keyed(spark, side, n, seed):
    """Records with few different titles, credits and years, so that most blocks are larger than the cap."""
    r = random.Random(seed)
    rows = [(f"{side}{i}", t := r.choice(["x y z", "x y w", "q", ""]), t.split(), c := r.choice(["m", "n", "x y z", ""]), r.choice([1990, 1991, 1994, None]), r.random() < 0.1, t == c, r.choice(["A", "B", ""]), r.choice(["C", ""])) for i in range(n)]
    return spark.createDataFrame(rows, "native_id string, title_norm string, title_tokens array<string>, artist_norm string, year_norm int, is_various_artists boolean, is_self_titled boolean, title_metaphone string, artist_metaphone string")


@pytest.mark.parametrize("cap", [1, 4, 1000])
def test_as_if_all_pairs_were_made(spark, cap):
    a, b = keyed(spark, "a", 60, 1), keyed(spark, "b", 80, 2)
    whole = blocking.capped(blocking.union_pairs(blocking.pair_keys(blocking.key_frame(a), blocking.key_frame(b))), cap)
    rows = lambda df: sorted((r["a_id"], r["b_id"], tuple(r["block_keys"]), r["n_block_keys"]) for r in df.collect())
    assert rows(blocking.candidates(a, b, cap)) == rows(whole)


def test_completeness_makes_no_pairs_but_truth(spark, monkeypatch):
    def never(*_):
        raise AssertionError("all pairs of every block are made")

    monkeypatch.setattr(blocking, "pair_keys", never)
    got = {r["measure"] for r in queries.QUERIES["pair_completeness"](spark, "/root/testdata/sf0.001").collect()}
    assert {"union", "after_cap"} <= got
