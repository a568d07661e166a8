import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.normalize import normalize_frame
from weftline.operators import assertions, blocking, cases, decide, evaluate, ledger, methods, profile, sampling
from weftline.operators.features import pair_features
from weftline.schemas import PAIR_FEATURES

RECORD = "native_id string, title string, artist_credit string, year int, primary_type string"


@pytest.fixture(scope="module")
def sides(spark):
    a = [("a1", "Abbey Road", "The Beatles", 1969, "Album"), ("a2", "Hits", "Various Artists", 1999, "Album"), ("a3", "Björk", "Björk", None, "Album"), ("a4", "", "", 2000, "Single")]
    b = [("10", "Abbey Road [Remaster Edition]", "Beatles, The", 1971, None), ("9", "Hits", "Various", 1999, None), ("8", "Bjork", "Bjork (2)", 1993, None), ("7", "Other thing", "The Beatles", 1970, None)]
    return tuple(normalize_frame(spark.createDataFrame(x, RECORD), phonetic=True) for x in (a, b))


def test_keys_and_candidates(sides):
    a, b = sides
    keys = {(r[0], r[1]) for r in blocking.key_frame(a).select("native_id", "key_type").collect()}
    assert ("a2", "k_artist_year") not in keys and ("a3", "k_self_titled") in keys and not any(i == "a4" for i, _ in keys)
    got = {(r["a_id"], r["b_id"]): r["block_keys"] for r in blocking.candidates(a, b).collect()}
    assert got[("a1", "10")] == ["k_artist_year", "k_phonetic", "k_title3", "k_title_sorted"] and got[("a1", "7")] == ["k_artist_year"]
    assert set(got[("a2", "9")]) == {"k_title3", "k_title_sorted"} and "k_self_titled" in got[("a3", "8")]
    union = blocking.union_pairs(blocking.pair_keys(blocking.key_frame(a), blocking.key_frame(b)))
    kept, over = blocking.capped(union, 1).count(), blocking.overflow(union, 1).first()
    assert over["pairs_dropped"] == union.count() - kept and over["a_over_cap"] == 1
    with pytest.raises(blocking.TooManyPairs):
        blocking.gate(union, 1)


def test_features(sides):
    a, b = sides
    out = pair_features(blocking.candidates(a, b), a, b)
    assert out.columns == ["a_id", "b_id", "block_keys", *PAIR_FEATURES]
    r = {(x["a_id"], x["b_id"]): x for x in out.collect()}
    assert r[("a1", "10")]["title_ratio"] == 1.0 and r[("a1", "10")]["artist_jw"] == 1.0 and r[("a1", "10")]["year_diff"] == 2 and r[("a1", "10")]["qualifier_mismatch"] == 1
    assert r[("a2", "9")]["both_va"] == 1 and r[("a3", "8")]["year_either_missing"] == 1 and r[("a3", "8")]["year_diff"] is None


PAIRS = [("a1", "7", 0.98), ("a1", "3", 0.5), ("a2", "1", 0.97), ("a2", "2", 0.94), ("a3", "5", 0.6), ("a4", "9", 0.4), ("a4", "7", 0.4), ("a5", "9", 0.96), ("a5", "10", 0.96)]


def pairs_frame(spark, rows=PAIRS):
    return spark.createDataFrame(rows, "a_id string, b_id string, probability double").withColumns({"score": F.col("probability"), "fold": F.lit("test"), "block_keys": F.array(F.lit("k_title3"))})


def test_decisions(spark):
    out = {r["a_id"]: r for r in decide.decide(pairs_frame(spark)).collect()}
    assert out["a1"]["tier"] == "auto_accept" and out["a1"]["top2_gap"] == pytest.approx(0.48)
    assert out["a2"]["tier"] == "review" and out["a2"]["ambiguity_review"] and out["a2"]["top2_gap"] == pytest.approx(0.03)
    assert out["a3"]["tier"] == "review" and out["a3"]["top2_gap"] is None and not out["a3"]["ambiguity_review"]
    assert out["a4"]["tier"] == "reject" and out["a4"]["b_id"] == "7"
    assert out["a5"]["b_id"] == "10"  # ids are text
    gap = decide.decide(pairs_frame(spark, [("x", "1", 1.0), ("x", "2", 0.9)])).first()
    assert gap["tier"] == "review"  # 1.0 - 0.9 is below 0.10
    assert spark.range(1).select(decide.tier_of(F.lit(0.95))).first()[0] == "auto_accept"
    with pytest.raises(Exception, match="not a probability"):
        spark.range(1).select(decide.tier_of(F.lit(1.5))).collect()


@pytest.mark.parametrize("bad", [(1.2, 0.5, 0.1), (0.5, 0.6, 0.1), (0.9, 0.5, -0.1), (float("nan"), 0.1, 0.1), (True, 0.1, 0.1)])
def test_bad_policies(bad):
    with pytest.raises(decide.PolicyError):
        decide.Policy(*bad)


def slow_decision(v1, v2, p):
    if v1 is None:
        return "reject", "no_candidate", False
    base = "auto_accept" if v1 >= p.accept_min else "review" if v1 >= p.review_min else "reject"
    unclear = base != "reject" and v2 is not None and v1 - v2 < p.ambiguity_gap
    return ("review" if unclear else base), None, unclear and v1 >= p.accept_min


def test_replay_against_a_slow_form(spark):
    rng = random.Random(20260926)
    pairs, truth = [], []
    for a in range(120):
        for b in range(rng.randint(0, 4)):
            pairs.append((f"a{a}", str(b), rng.choice([rng.random(), 0.5, 0.95, 0.85, 1.0])))
        if rng.random() < 0.6:
            truth.append((f"a{a}", str(rng.randint(0, 4))))
    population = spark.createDataFrame([(f"a{a}",) for a in range(120)], "a_id string")
    rows = decide.replay_rows(pairs_frame(spark, pairs), population, spark.createDataFrame(truth, "a_id string, b_id string"))
    held = rows.collect()
    assert len(held) == 120 and decide.bad_replay_rows(rows).count() == 0
    for p in (decide.Policy(0.95, 0.5, 0.1), decide.Policy(0.5, 0.5, 0.0), decide.Policy(1.0, 0.0, 1.0)):
        got = evaluate.evaluate(rows, p)
        tiers = [slow_decision(r["v1"], r["v2"], p) for r in held]
        accept = [r for r, t in zip(held, tiers, strict=True) if t[0] == "auto_accept"]
        assert got["accepted_all"] == len(accept) and got["ambiguity_rule"]["decisions_moved_to_review"] == sum(t[2] for t in tiers)
        assert got["at_auto_accept"]["correct"] == sum(bool(r["top1_correct"]) for r in accept if r["labelled"])
        assert abs(sum(got["tier_shares"].values()) - 1) < 1e-9
        if got["recall_overall"] is not None:
            assert got["recall_overall"] <= got["pair_completeness_test"] + 1e-9
    legacy = {r["threshold"]: r["accepts"] for r in decide.legacy_sweep(rows, decide.Policy(0.95, 0.5, 0.1), [0.6, 0.95, 1.0]).collect()}
    full = {r["accept_min"]: r["accepted_all"] for r in evaluate.accept_sweep(rows, 0.5, 0.1, (0.6, 0.95, 1.0)).collect()}
    assert all(legacy[t] == full[t] for t in (0.95, 1.0))


def test_thresholds(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, correct boolean")
    rows = [(0.9, True), (0.8, True), (0.7, True), (0.6, True), (0.4, False), (0.3, False), (0.2, False), (0.2, False), (0.2, False)]
    assert methods.fit_thresholds(frame(rows), 4) == (0.6, 0.2)
    assert methods.fit_thresholds(frame([(0.9, True), (0.7, True)]), 1)[1] <= 0.9
    with pytest.raises(ValueError):
        methods.fit_thresholds(frame([]), 1)


def test_scores(spark):
    frame = spark.createDataFrame([(1.0, 0.5, None), (1.0, 1.0, 1)], "title_token_set double, artist_token_set double, year_diff int")
    assert [r[0] for r in frame.select(methods.rules_score()).collect()] == [0.45 * 1.0 + 0.35 * 0.5 + 0.2 * 0.25, 0.45 * 1.0 + 0.35 * 1.0 + 0.2 * 0.5]


def test_learned_method(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        hit = i % 3 == 0
        x = [min(1.0, max(0.0, (0.8 if hit else 0.3) + rng.uniform(-0.2, 0.2))) for _ in range(8)]
        rows.append((f"a{i // 3}", f"b{i}", ("fit", "calibrate", "test")[i // 3 % 3], *x, 0, 0, rng.choice([None, 0, 1, 5]), 0, 0, 1, 1, 0))
    schema = "a_id string, b_id string, fold string, " + ", ".join(f"{f} {'double' if i < 8 else 'int'}" for i, f in enumerate(PAIR_FEATURES))
    truth = spark.createDataFrame([(r[0], r[1]) for i, r in enumerate(rows) if i % 3 == 0], "a_id string, b_id string")
    features = spark.createDataFrame(rows, schema)
    model = methods.fit_learned(features, truth, trees=3, least_leaf=2)
    out = methods.with_labels(model.score(features), truth).filter("fold = 'test'").collect()
    assert all(0 <= r["probability"] <= 1 for r in out)
    assert sum((r["probability"] > 0.5) == (r["label"] == 1) for r in out) > 0.95 * len(out)


def test_calibration_edges(spark):
    rows = [(0.3, 1), (0.30000000000000004, 0), (0.0, 0), (1.0, 1)]
    got = evaluate.reliability(spark.createDataFrame(rows, "probability double, label int"))
    assert [b["n"] for b in got["bins"]] == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1] and got["n"] == 4
    assert got["brier"] == round((0.49 + 0.09) / 4, 6)


def test_sampling_and_contracts(spark, sides):
    a, b = sides
    links = spark.createDataFrame([("a1", "10"), ("a2", "77"), ("a4", "8"), ("a1", "10")], "a_id string, b_id string")
    truth = sampling.classify_links(links, a, b, "Album")
    assert {(r["a_id"], r["status"]) for r in truth.collect()} == {("a1", "truth_in_sample"), ("a2", "truth_dead"), ("a4", "truth_out_of_scope")}
    audit = {r["measure"]: r["n"] for r in sampling.truth_audit(truth, links).collect()}
    assert audit["links_raw"] == 4 and audit["duplicate_links"] == 1 and audit["out_of_scope:Single"] == 1
    sample, limit = sampling.side_sample(a, "a", links.select(F.col("a_id").alias("native_id")), 1)
    assert {r["native_id"] for r in sample.collect()} == {"a1", "a2", "a3", "a4"} and len(limit) == 64
    assert sampling.side_sample(a, "a", links.select(F.col("a_id").alias("native_id")), 0)[1] == "0" * 64
    assert sampling.unlinked_wanted(10, 0.5) == 10
    report = {r["check_name"]: r for r in sampling.contract_report(a.unionByName(a.limit(1)), 2027, id_pattern=r"^a\d$").collect()}
    assert report["grain_unique"]["violations"] == 1 and report["id_format"]["passed"] and not report["null_rate:title"]["passed"]
    pool_a, pool_b = sampling.pools(a, b, links, "Album")
    assert {r["native_id"] for r in pool_a.collect()} == {"a3"} and {r["native_id"]: r["b_linked_out_of_scope"] for r in pool_b.collect()} == {"9": False, "8": True, "7": False}


EVENT = "event_id string, seq long, snapshot_id string, scenario_id string, a_id string, action string, b_id string, supersedes_event_id string, reverses_event_id string"
LOG = [
    ("e1", 1, "s", "x", "a", "accept_candidate", "b1", None, None),
    ("e2", 2, "s", "x", "a", "accept_candidate", "b2", "e1", None),
    ("e3", 3, "s", "x", "a", "undo", None, None, "e2"),
    ("e4", 4, "s", "x", "c", "reject_candidate", "b1", None, None),
    ("e5", 5, "s", "x", "c", "defer", None, None, None),
    ("e6", 6, "s", "x", "d", "accept_candidate", "b9", None, None),
    ("e7", 7, "s", "x", "d", "reject_candidate", "b9", None, None),
]


def test_ledger(spark):
    events = spark.createDataFrame(LOG, EVENT)
    ledger.check(events, "s")
    got = {r["a_id"]: r for r in ledger.effective_state(events).collect()}
    assert (got["a"]["status"], got["a"]["accepted_b_id"]) == ("accepted", "b1")
    assert got["c"]["status"] == "deferred" and got["d"]["status"] == "rejected_candidates" and got["d"]["rejected_candidates"] == ["b9"]
    cases_ = spark.createDataFrame([("a",), ("c",), ("d",), ("z",)], "a_id string")
    s = ledger.summary(ledger.effective_state(events), cases_, spark.createDataFrame([("a", "b7")], "a_id string, b_id string")).first()
    assert (s["accepted"], s["deferred"], s["rejected_candidate_only"], s["untouched"], s["changed_mappings"]) == (1, 1, 1, 1, 1)
    with pytest.raises(ledger.IncompatibleSnapshot):
        ledger.check(events, "other")
    for bad, said in ((("e8", 8, "s", "x", "a", "accept_candidate", "b3", None, None), "supersede"), (("e8", 8, "s", "x", "a", "undo", None, None, "e3"), "undo"), (("e8", 9, "s", "x", "a", "defer", None, None, None), "contiguous"), (("e1", 8, "s", "x", "a", "defer", None, None, None), "unique"), (("e8", 8, "s", "x", "c", "undo", None, None, "e1"), "another case")):
        with pytest.raises(ledger.LedgerError, match=said):
            ledger.check(spark.createDataFrame([*LOG, bad], EVENT), "s")


def test_ledger_stream_equals_the_batch_state(spark, tmp_path):
    from weftline.streaming.ledger import live_state

    events = spark.createDataFrame(LOG, EVENT)
    for k, part in enumerate((events.filter("seq <= 3"), events.filter("seq > 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = live_state(stream).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("states").groupBy("a_id").agg(F.max_by(F.struct("status", "accepted_b_id"), "last_seq").alias("x")).collect()
    batch = {r["a_id"]: (r["status"], r["accepted_b_id"]) for r in ledger.effective_state(events).collect()}
    assert {r["a_id"]: tuple(r["x"]) for r in last} == batch


def test_cases(spark):
    mapping = spark.createDataFrame([("a1", "exact_v1", "1", 1.0, 1.0, "auto_accept", 0.5, "k"), ("a1", "rules_v1", "1", 1.0, 1.0, "auto_accept", 0.5, "k"), ("a1", "learned_v1", "1", 1.0, 1.0, "auto_accept", None, "k"), ("a2", "rules_v1", "1", 0.9, 0.96, "review", 0.0, "k"), ("a2", "learned_v1", "2", 0.9, 0.97, "review", 0.05, "k")], "a_id string, method_version string, b_id string, score double, probability double, tier string, top2_gap double, block_keys string")
    points = spark.createDataFrame([(m, 0.95, 0.5, 0.1) for m in ("exact_v1", "rules_v1", "learned_v1")], "method_version string, accept_min double, review_min double, ambiguity_gap double")
    e = cases.evidence(spark.createDataFrame([("c1", "a1"), ("c2", "a2"), ("c3", "a3")], "case_id string, a_id string"), points, mapping)
    assert {r["case_id"]: r["agreement_class"] for r in cases.comparison(e).collect()} == {"c1": "all_exported_agree", "c2": "methods_disagree", "c3": "none_exported"}
    tags = {}
    for r in cases.tags(e, spark.createDataFrame([("a1", "5")], "a_id string, b_id string"), spark.createDataFrame([("a1", 2), ("a2", 3)], "a_id string, n int")).collect():
        tags.setdefault(r["a_id"], set()).add(r["tag"])
    assert tags == {"a1": {"agreement_all_accept", "single_candidate", "verified_wrong_accept"}, "a2": {"method_disagreement", "ambiguity_tie", "ambiguity_demoted", "partial_export"}, "a3": {"no_candidate"}}
    assert cases.selection(cases.tags(e)).count() == 2


def test_profiles(sides):
    a, b = sides
    row = profile.record_profile(a, 2027).first()
    assert (row["total"], row["empty_title"], row["various"], row["year_missing"]) == (4, 1, 1, 1)
    truth = a.sparkSession.createDataFrame([("a1", "10"), ("a2", "9"), ("a3", "8")], "a_id string, b_id string")
    assert {r["a_id"]: r["pattern"] for r in profile.classified_pairs(truth, a, b).collect()} == {"a1": "edition_qualifier", "a2": "identical", "a3": "numeric_disambiguator"}


def test_assertions(spark):
    m = spark.createDataFrame([("a", "m", "auto_accept", "k"), ("a", "m", "auto_accept", ""), ("b", "m", "review", None)], "a_id string, method_version string, tier string, block_keys string")
    assert assertions.several_accepts(m).count() == 1 and assertions.without_block_keys(m).count() == 2
    assert assertions.accepted_values(m, "tier", ("review",)).count() == 2 and assertions.not_null(m, "block_keys").count() == 1
    assert assertions.undocumented({"m": ["x", "y"]}, {"m": {"": "d", "x": "d"}}) == ["m.y"]
