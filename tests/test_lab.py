"""Publication, checks and reports around a run, and what acquires dumps."""

import gzip
import io
import json
import tarfile
import urllib.error

import pytest
from pyspark.sql import functions as F

from weftline.functions.hashing import id_order_hash, index_hash, sorted_digest
from weftline.operators import cases, decide, evaluate, lab, ledger, methods, profile, sampling
from weftline.operators.decide import Policy
from weftline.plans import report
from weftline.sinks import canonical, read_scored, sha256_bytes, write_scored
from weftline.sources import acquire, dumps

PAIRS = [("a1", "1", 0.98, "test"), ("a1", "2", 0.4, "test"), ("a2", "1", 0.97, "test"), ("a2", "2", 0.93, "test"), ("a3", "5", 0.6, "test"), ("a4", "9", 0.2, "test"), ("a5", "3", 0.99, "test"), ("b1", "1", 0.99, "fit"), ("b2", "2", 0.7, "fit")]
TRUTH = [("a1", "1"), ("a2", "2"), ("a3", "6"), ("b1", "1")]
POPULATION = ["a1", "a2", "a3", "a4", "a5", "a6", "b1", "b2"]


@pytest.fixture(scope="module")
def frames(spark):
    pairs = spark.createDataFrame(PAIRS, "a_id string, b_id string, probability double, fold string").withColumns({"score": F.col("probability"), "block_keys": F.array(F.lit("k_title3"))})
    truth = spark.createDataFrame(TRUTH, "a_id string, b_id string")
    population = spark.createDataFrame([(a,) for a in POPULATION], "a_id string")
    rows = decide.replay_rows(pairs.filter("fold = 'test'"), population.filter("a_id like 'a%'"), truth)
    return pairs, truth, population, rows


def test_hashes(spark):
    import hashlib

    frame = spark.createDataFrame([("b", "2"), ("a", "10"), ("a", "9")], "a_id string, b_id string")
    assert index_hash(frame) == index_hash(frame.orderBy(F.desc("b_id"))) == hashlib.sha256(b"a|10\na|9\nb|2").hexdigest()
    assert id_order_hash(frame.select("a_id").distinct()) == hashlib.sha256(b"a\nb").hexdigest()
    nested = spark.createDataFrame([(1, ["x", None]), (2, None)], "i int, l array<string>")
    assert sorted_digest(nested) == sorted_digest(nested.orderBy(F.desc("i"))) != sorted_digest(nested.limit(1))


def test_full_evaluation(frames):
    pairs, truth, population, rows = frames
    policy = Policy(0.95, 0.5, 0.1)
    got = evaluate.full_evaluation(pairs, population, rows, truth, policy)
    # accepted: a1, a5 of the test fold, b1 of the fit fold; a2 is ambiguous
    assert got["accepted_all"] == 2 and got["coverage_all_folds"] == round(3 / 8, 6)
    decision, pair = got["calibration"]["decision_level"], got["calibration"]["pair_level"]
    assert (decision["n"], pair["n"]) == (3, 5)
    assert decision["brier"] == round((0.02**2 + 0.97**2 + 0.6**2) / 3, 6)
    assert decision["bins"][9] == {"lower": 0.9, "upper": 1.0, "n": 2, "mean_probability": 0.975, "observed_rate": 0.5}
    assert got["confusion"]["auto_accept"] == {"tp": 1, "fp": 1, "fn": 1, "tn": 2}
    counts = evaluate.fold_counts(pairs, population, truth, policy)
    assert sum(c["a_records"] for c in counts.values()) == 8 and counts["fit"]["candidate_pairs"] == 2 and counts["test"]["decisions"] == 5
    population_block = {"a_records": 6, "labelled_a": 3, "labelled_a_reachable": 2}
    assert evaluate.conservation(rows, population_block)["without_candidates"] == 1
    with pytest.raises(evaluate.NotConserved, match="labelled_a"):
        evaluate.conservation(rows, population_block | {"labelled_a": 4})
    assert set(got) - {"accepted_all", "no_candidate_a"} <= set(evaluate.DEFINITIONS) | {"at_auto_accept", "recall_overall"}


def test_legacy_costs_and_floors_against_a_slow_form(frames):
    *_, rows = frames
    held, base = rows.collect(), Policy(0.95, 0.5, 0.1)
    told = [evaluate.why(r["v1"], r["v2"], base) | {"r": r} for r in held]
    moved = [t["reason"] == "ambiguity_gap_below_threshold" and t["r"]["v1"] >= 0.95 for t in told]
    for p in evaluate.legacy_costs(rows, base, (0.5, 0.6, 0.95, 0.985)):
        t = p["threshold"]
        accept = [r for r, m in zip(held, moved, strict=True) if r["v1"] is not None and r["v1"] >= t and not m]
        queue = [r for r, m in zip(held, moved, strict=True) if r["v1"] is not None and (0.5 <= r["v1"] < t or r["v1"] >= t and m)]
        labelled = [r for r in accept if r["labelled"]]
        precision = sum(r["top1_correct"] for r in labelled) / len(labelled) if labelled else None
        wrong = None if precision is None else round(len(accept) * (1 - precision), 3)
        assert (p["accepts"], p["review_queue"]) == (len(accept), len(queue))
        assert p["expected_false_accepts"] == wrong and p["total_cost"]["5"] == (None if wrong is None else round(len(queue) + 5 * wrong, 3))
    floors = evaluate.legacy_floors(rows, base, (0.1, 0.5, 0.95))
    assert [p["floor"] for p in floors] == [0.1, 0.5]
    assert floors[0] == {"floor": 0.1, "queue_floor": 2, "queue_ambiguity": 1, "queue_total": 3, "queue_share_of_test_a": 0.5, "recall_with_review": 1.0}


def test_why_and_statements():
    p = Policy(0.95, 0.5, 0.1)
    assert evaluate.why(None, None, p)["reason"] == "no_candidate"
    assert evaluate.why(0.97, 0.93, p)["gap_from"] == "unrounded values" and evaluate.why(0.97, None, p, 0.04)["gap_from"] == "published row"
    assert evaluate.why(0.97, None, p)["tier"] == "auto_accept" and evaluate.why(0.3, 0.29, p)["reason"] == "value_below_review_min"
    one = {"metrics": {"f1": 0.9, "precision": 0.8, "recall_labelled": 0.9, "coverage": 0.5}, "counts": {"review_queue": 10}, "policy": {"accept_min": 0.6}, "calibrated": False}
    two = {"metrics": {"f1": 0.8, "precision": 0.99, "recall_labelled": 0.6, "coverage": 0.6}, "counts": {"review_queue": 5}, "policy": {"accept_min": 0.9}, "calibrated": True}
    said = evaluate.statements({"rules_v1": one, "learned_v1": two})
    text = " ".join(s["text"] for s in said)
    assert "rules_v1 has the highest F1" in text and "less recall_labelled than rules_v1" in text and "rules_v1 is not calibrated" in text and "policies of their own" in text


def test_a_gate_stops(spark):
    with pytest.raises(methods.TooGood):
        methods.stop_if_too_good({"rules_v1": {"f1": 0.5, "precision": 0.9, "accepted": 5}, "learned_v1": {"f1": 0.9, "precision": 0.9, "accepted": 5}})
    methods.stop_if_too_good({"exact_v1": {"f1": 0.5, "precision": 1.0, "accepted": 5000}})


def test_a_curve_in_slices_is_the_whole_curve(spark):
    import random

    rng = random.Random(3)
    rows = [(round(rng.random(), 3), rng.random() < 0.5) for _ in range(500)]
    got = {r["score"]: (r["n"], r["right"]) for r in methods.threshold_curve(spark.createDataFrame(rows, "score double, correct boolean"), 10).collect()}
    for s in {s for s, _ in rows}:
        above = [c for x, c in rows if x >= s]
        assert got[s] == (len(above), sum(above))


def test_a_threshold_from_prefix_counts(spark):
    import hashlib

    hashes = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000))
    pool = spark.createDataFrame([(h,) for h in hashes], "membership_hash string")
    for n in (0, 1, 17, 2999, 3000, 9999):
        assert sampling.threshold(pool, n) == (hashes[min(n, 3000) - 1] if n else "0" * 64)
    assert sampling.threshold(pool.limit(0), 5) == "0" * 64


def test_scored_pairs_are_reused_only_if_they_are_those(spark, frames, tmp_path):
    pairs, path = frames[0], str(tmp_path / "scored")
    write_scored(pairs, path, "run-1", "exact_v1")
    assert read_scored(spark, path, "run-1", "exact_v1").count() == len(PAIRS)
    assert read_scored(spark, path, "run-2", "exact_v1") is None and read_scored(spark, path, "run-1", "rules_v1") is None
    pairs.limit(1).write.mode("append").parquet(f"{path}/fold=test")
    assert read_scored(spark, path, "run-1", "exact_v1") is None and read_scored(spark, str(tmp_path / "none"), "run-1", "x") is None


# a published run


@pytest.fixture(scope="module")
def run(spark, frames):
    pairs, truth, population, rows = frames
    policy = Policy(0.95, 0.5, 0.1)
    metrics = evaluate.full_evaluation(pairs, population, rows, truth, policy)
    points = {"auto_accept_min": 0.95, "review_min": 0.5, "ambiguity_gap": 0.1}
    exhibit = decide.mapping(decide.decide(pairs.filter("fold = 'test'"), policy), "exact_v1", "f1", "r1", "2026-01-01T00:00:00Z")
    return lab.Run({"run_id": "r1", "sha256": "m"}, {"exact_v1": {"manifest_sha256": "m", "code_commit": "c", "generated_at_utc": "t", "metrics": metrics, "thresholds": points}}, {"exact_v1": {"code_commit": "c", "thresholds": points, "mapping": {"test_rows": exhibit.count()}}}, {"folds": {"test": {"a_records": 6, "labelled_a_records": 3}}}, {"code_commit": "c", "methods": {"exact_v1": {"review_floor_sweep": {"points": evaluate.legacy_floors(rows, policy)}}}}, {"exact_v1": exhibit})


def test_a_run_is_cross_checked(run):
    import copy
    import dataclasses

    assert lab.contradictions(run) == []
    for path, said in ((("split", "folds", "test", "a_records"), "test_a"), (("methods", "exact_v1", "code_commit"), "commits"), (("manifest", "sha256"), "manifest"), (("manifest", "run_id"), "another run"), (("methods", "exact_v1", "thresholds", "review_min"), "thresholds"), (("methods", "exact_v1", "mapping", "test_rows"), "exhibit rows")):
        part = copy.deepcopy(getattr(run, path[0]))
        at = part
        for key in path[1:-1]:
            at = at[key]
        at[path[-1]] = "other" if isinstance(at[path[-1]], str) else 0.25
        assert any(said in p for p in lab.contradictions(dataclasses.replace(run, **{path[0]: part}))), said


def test_figures_have_their_parts(run):
    import copy
    import dataclasses

    made = lab.snapshot(run)
    m = made["methods"]["exact_v1"]
    assert m["metrics"]["precision"] == {"value": 1.0, "numerator": 1, "denominator": 1, "source_key": "eval_exact_v1.json#metrics.at_auto_accept.precision"}
    assert m["counts"]["tier_reject"]["value"] == 2 and made["population"] == {"a_records": 6, "labelled_a": 3, "labelled_a_reachable": 2}
    assert made["snapshot_id"] == lab.snapshot(run)["snapshot_id"]
    wrong = copy.deepcopy(run.evaluations)
    wrong["exact_v1"]["metrics"]["coverage"] = 0.9
    with pytest.raises(lab.ContractError, match="coverage"):
        lab.snapshot(dataclasses.replace(run, evaluations=wrong))


def test_receipts(run):
    figures = lab.snapshot(run)
    assert lab.scenario_id("replay", "exact_v1", 0.9, 0.5, 0.1) == "replay:exact_v1:0.9:0.5:0.1" and lab.scenario_id("synthetic", "a b") == "synthetic:a_b"
    with pytest.raises(ValueError):
        lab.scenario_id("floor", "exact_v1")
    seen = lab.observations(figures, "exact_v1", floor=0.5, replayed=run.evaluations["exact_v1"]["metrics"], policy=Policy())
    made = lab.Receipt(figures["snapshot_id"], figures["analytical_digest"], lab.scenario_id("floor", "exact_v1", 0.5), "adopt", "short queue", seen, lab.alternatives(figures, "exact_v1", 0.5), ["one run"])
    back, problems = lab.import_receipt(made.export(), figures)
    assert problems == [] and back == made and len(made.alternatives) == len(figures["methods"]["exact_v1"]["review_floor"]["points"]) - 1
    body = json.loads(made.export())
    for change, said in (({"rationale": "x"}, "id"), ({"snapshot_id": "other"}, "other evidence")):
        assert any(said in p for p in lab.import_receipt(json.dumps(body | change), figures)[1])
    body["observations"][0]["value"] = 0.123
    assert len(lab.import_receipt(json.dumps(body), figures)[1]) == 2 and lab.import_receipt("nonsense", figures)[0] is None


def test_the_sandbox_meets_expectations(spark):
    assert lab.unmet_expectations(spark) == []
    bad = (*lab.SANDBOX[:2], ("s03", {"1": 0.96, "2": 0.2}))
    decided = {r["a_id"]: r["tier"] for r in lab.sandbox_decisions(spark, lab.PRESETS["native"], bad).collect()}
    assert decided == {"s01": "auto_accept", "s02": "review", "s03": "auto_accept"}
    doc = lab.policy_fixtures()
    reasons = {e["reason"] for p in doc["policies"] for e in p["expected"]}
    assert reasons == {"no_candidate", "value_at_or_above_accept_min", "value_at_or_above_review_min", "value_below_review_min", "ambiguity_gap_below_threshold"}
    assert ["10", "9"] in [r["order"] for r in doc["rankings"]] and canonical(doc)


def test_publication(tmp_path):
    allowed = frozenset({"a.json", "b/data.bin"})
    files = {"a.json": {"x": 1}, "b/data.bin": b"12"}
    lab.publish(files, str(tmp_path), allowed, frozenset({"secret"}))
    assert lab.published_problems(str(tmp_path), allowed, frozenset({"secret"}), files) == []
    with pytest.raises(lab.ContractError, match="not to be published"):
        lab.publish({"c.json": 1}, str(tmp_path), allowed)
    with pytest.raises(lab.ContractError, match="secret"):
        lab.publish({"a.json": {"secret": 1}}, str(tmp_path), allowed, frozenset({"secret"}))
    assert any("otherwise" in p for p in lab.published_problems(str(tmp_path), allowed, fresh={"a.json": {"x": 2}}))
    (tmp_path / "a.json").write_text('{"x":1, "secret": 2}')
    (tmp_path / "extra.txt").write_text("x")
    found = lab.published_problems(str(tmp_path), allowed, frozenset({"secret"}))
    assert [any(s in p for p in found) for s in ("changed", "canonical", "secret", "not in the list", "not allowed")] == [True] * 5


def test_bundles_are_verified_from_their_files(spark, frames, run, tmp_path):
    rows, policy, population = frames[3], Policy(0.95, 0.5, 0.1), {"a_records": 6, "labelled_a": 3, "labelled_a_reachable": 2}
    metrics = run.evaluations["exact_v1"]["metrics"]
    meta = lab.bundle_meta(rows, "exact_v1", "snap-1", policy, population, metrics)
    data = lab.write_bundle(rows, str(tmp_path), meta)
    check = lambda **other: lab.bundle_problems(spark, str(tmp_path), "exact_v1", *({"snapshot_id": "snap-1", "policy": policy, "population": population, "evaluation": metrics} | other).values())
    assert check() == []
    assert any("snapshot_id" in p for p in check(snapshot_id="snap-2")) and any("population" in p for p in check(population=population | {"a_records": 7}))
    assert any("evaluation" in p for p in check(evaluation=metrics | {"coverage": 0.1}))
    with pytest.raises(lab.ContractError):
        lab.bundle_meta(rows, "exact_v1", "snap-1", policy, population, metrics | {"coverage": 0.1})
    text = gzip.decompress(data).decode().splitlines()
    (tmp_path / "replay_exact_v1.csv.gz").write_bytes(gzip.compress("\n".join(text[:-1]).encode()))
    assert len(check()) >= 3
    assert lab.bundle_problems(spark, str(tmp_path), "rules_v1", "s", policy, population, metrics) == ["the bundle of rules_v1 is not whole"]


def test_labels_of_cases(spark, frames):
    pairs, truth, _, rows = frames
    points = spark.createDataFrame([("exact_v1", 0.95, 0.5, 0.1)], "method_version string, accept_min double, review_min double, ambiguity_gap double")
    mapping = decide.mapping(decide.decide(pairs.filter("fold = 'test'")), "exact_v1", "f1", "r1", "t")
    known = spark.createDataFrame([(f"case-{a}", a) for a in ("a1", "a2", "a3", "a4", "a5", "a6")], "case_id string, a_id string")
    evidence = cases.evidence(known, points, mapping)
    blocks = lab.label_blocks(evidence, truth, rows.withColumn("method_version", F.lit("exact_v1")))
    got = {r["a_id"]: r for r in blocks.collect()}
    assert got["a1"]["chosen_correct"] and got["a1"]["truth_visible"] and got["a1"]["n_candidates"] == 2
    assert got["a2"]["chosen_correct"] is False and got["a2"]["unrounded_ambiguous"] and not got["a2"]["truth_visible"] and got["a2"]["truth_reachable"]
    assert got["a5"]["labelled"] is False and got["a5"]["truth_reachable"] is None and got["a6"]["n_candidates"] == 0
    tagged = spark.createDataFrame([("case-a2", "verified_wrong_accept"), ("case-a5", "unverified_accept"), ("case-a6", "no_candidate"), ("case-a4", "reject_all_methods"), ("case-a1", "unverified_accept")], "case_id string, tag string")
    assert {(r["case_id"], r["problem"]) for r in lab.label_problems(blocks, evidence, tagged).collect()} == {("case-a1", "not a case of unverified_accept"), ("case-a2", "not a case of verified_wrong_accept")}
    broken = blocks.withColumn("chosen_correct", F.when(F.col("a_id") == "a1", False).otherwise(F.col("chosen_correct"))).withColumn("unrounded_gap", F.when(F.col("a_id") == "a2", 0.5).otherwise(F.col("unrounded_gap")))
    assert len({r["problem"] for r in lab.label_problems(broken, evidence).collect()}) == 3
    assert lab.case_problems(blocks, blocks).count() == 0
    changed = {(r["case_id"], r["problem"]) for r in lab.case_problems(broken.filter("a_id <> 'a6'"), blocks).collect()}
    assert changed == {("case-a1", "chosen_correct differs"), ("case-a2", "unrounded_gap differs"), ("case-a6", "found again but not published")}
    block = lab.selection_block(cases.tags(evidence))
    assert block["total_cases"] == len(cases.selection(cases.tags(evidence)).collect()) and all(c["selected"] <= c["cap"] for c in block["criteria"])


EVENT = "event_id string, seq long, occurred_at_utc string, snapshot_id string, scenario_id string, a_id string, method_version string, action string, b_id string, supersedes_event_id string, reverses_event_id string, evidence_ref string"


def event(i, action, b=None, supersedes=None, reverses=None, snapshot="s", a="a"):
    return (f"e{i}", i, "t", snapshot, "x", a, "m", action, b, supersedes, reverses, None)


def test_ledgers_are_appended_undone_and_imported(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    log = frame(event(1, "accept_candidate", "1"), event(2, "defer", a="c"))
    longer = ledger.append(log, frame(event(20, "reject_candidate", "2", a="c"), event(10, "accept_candidate", "3", a="d")), "s")
    assert {r["event_id"]: r["seq"] for r in longer.collect()} == {"e1": 1, "e2": 2, "e10": 3, "e20": 4}
    undone = ledger.undo(longer, "e1", "u1", "t2")
    assert {r["a_id"]: r["status"] for r in ledger.effective_state(undone).collect()} == {"c": "deferred", "d": "accepted"}
    with pytest.raises(ledger.LedgerError):
        ledger.undo(longer, "none", "u2", "t2")
    given, digest = frame(event(1, "accept_candidate", "1"), event(2, "defer", a="z")), ("s", "d")
    same = given.withColumn("event_id", F.when(F.col("event_id") == "e2", "n2").otherwise(F.col("event_id")))
    merged, told = ledger.import_events(log, same, digest, digest)
    assert told == {"status": "ok", "imported": 1, "quarantine": None} and merged.count() == 3
    for other, theirs, reason in ((same, ("s", "other"), "incompatible_snapshot"), (same.withColumn("snapshot_id", F.lit("q")), digest, "incompatible_snapshot"), (same.drop("b_id"), digest, "corrupt"), (same.withColumn("seq", F.col("seq") + 5), digest, "invalid_ledger")):
        kept, told = ledger.import_events(log, other, digest, theirs)
        assert told["reason"] == reason and told["quarantine"]["event_count"] == 2 and kept.count() == 2


def test_a_reject_does_not_supersede_and_an_accept_leaves_rejections(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    state = ledger.effective_state(frame(event(1, "reject_candidate", "1"), event(2, "accept_candidate", "1"))).first()
    assert state["accepted_b_id"] == "1" and state["rejected_candidates"] == ["1"]
    with pytest.raises(ledger.LedgerError, match="must not supersede"):
        ledger.check(frame(event(1, "accept_candidate", "1"), event(2, "reject_candidate", "1", supersedes="e1")), "s")


# reports


def test_tables_and_cards(run):
    figures = lab.snapshot(run)
    assert "| exact_v1 | 1.0 |" in report.results_table(figures)
    assert report.floors_table(figures, "exact_v1", (0.5,)).count("\n") == 3
    card = report.methods_card({"exact_v1": run.methods["exact_v1"] | {"description": "Equal names.", "parameters": {"trees": 3}}}, figures, evaluate.DEFINITIONS)
    assert "## exact_v1" in card and "| trees | 3 |" in card and "- **coverage**" in card


def test_cited_numbers():
    files = {"e.json": {"n": 1234, "share": 0.2345, "x": [{"y.z": 3.9}]}}
    good = "There are 1,234 records <!-- cite: e.json#n -->\nor 23.5% <!-- cite: e.json#share -->, nearly a quarter\nabout four times as many <!-- cite: e.json#x[0][\"y.z\"] -->\nSee section 3."
    assert report.document_problems(good, files) == []
    bad = "There are 1,235 records <!-- cite: e.json#n -->\nA share of 23%\n24% <!-- cite: e.json#share -->\nmore than half <!-- cite: e.json#share -->\nx 1 <!-- cite: e.json#none -->"
    assert [p.split(":")[0] for p in report.document_problems(bad, files)] == ["1", "2", "3", "4", "5"]


def test_runs_are_compared(tmp_path):
    for name, n in (("one", 1), ("two", 1)):
        (tmp_path / name).mkdir()
        held = {"n": n, "runtime": {"x": name}, "digested": ["n"]}
        (tmp_path / name / "m.json").write_text(canonical(held | {"sha256": report.sha256_canonical({"n": n})}))
    assert report.differences(str(tmp_path / "one"), str(tmp_path / "two"), {"m.json": {"type": "object", "required": ["n"]}}) == []
    (tmp_path / "two" / "x.json").write_text("{}")
    (tmp_path / "one" / "m.json").write_text(canonical({"n": 2, "digested": ["n"], "sha256": "x"}))
    found = report.differences(str(tmp_path / "one"), str(tmp_path / "two"), {"m.json": {"type": "object", "required": ["k"]}})
    assert len(found) == 4


# sources


def test_files_are_fetched_once_and_unpacked_in_one_pass(tmp_path):
    made = io.BytesIO()
    with tarfile.open(fileobj=made, mode="w:bz2") as tar:
        for name, data in (("d/one", b"1"), ("d/skip", b"x"), ("d/two", b"22"), ("d/late", b"333")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "src.tar.bz2").write_bytes(made.getvalue())
    url = (tmp_path / "src.tar.bz2").as_uri()
    got = acquire.fetch(url, str(tmp_path / "raw"))
    assert got["sha256"] == sha256_bytes(made.getvalue()) == acquire.file_sha256(str(tmp_path / "raw/src.tar.bz2"))[1]
    (tmp_path / "src.tar.bz2").unlink()
    assert acquire.fetch(url, str(tmp_path / "raw")) == got
    archive = str(tmp_path / "raw/src.tar.bz2")
    first = acquire.unpack(archive, {"d/one": "one", "d/two": "two"}, str(tmp_path / "out"))
    assert first["passes"][0]["members_seen"] == 3 and (tmp_path / "out/two").read_bytes() == b"22"
    more = acquire.unpack(archive, {"d/one": "one", "d/late": "late"}, str(tmp_path / "out"))
    assert len(more["passes"]) == 2 and more["files"]["late"]["bytes"] == 3
    with pytest.raises(acquire.AcquireError, match="none"):
        acquire.unpack(archive, {"d/none": "none"}, str(tmp_path / "out"))
    with pytest.raises(acquire.AcquireError, match="free"):
        acquire.need_disk(str(tmp_path), 1 << 60)


def test_a_paged_client(tmp_path):
    table, asked, waits = [{"i": {"value": str(i)}} for i in range(450)], [], []

    def send(url, query):
        asked.append(query)
        size, at = (int(query.rsplit(w, 1)[1].split()[0]) for w in ("LIMIT ", "OFFSET "))
        if len(asked) == 1:
            raise urllib.error.HTTPError(url, 429, "later", {}, None)
        if size > 250:
            raise TimeoutError
        return json.dumps({"results": {"bindings": table[at : at + size]}}).encode()

    client = acquire.PagedClient("http://x", str(tmp_path), send, waits.append, (1, 2))
    assert [acquire.flat(b)["i"] for b in client.pages("q", "SELECT ?i", 400)] == [str(i) for i in range(450)]
    assert client.requests == len(asked) == 6 and waits == [1, 2] and client.retries == 2
    again = acquire.PagedClient("http://x", str(tmp_path), send, waits.append, ())
    assert len(again.ask("q-0-200", "")) == 200 and again.kept == 1 and again.requests == 0

    def refuse(url, query):
        raise urllib.error.HTTPError(url, 400, "bad", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        acquire.PagedClient("http://x", str(tmp_path / "n"), refuse, waits.append).ask("x", "q")


def test_ids_addresses_and_kept_frames(spark, tmp_path):
    good = "0f8e1c2d-0000-4000-8000-0123456789ab"
    frame = spark.createDataFrame([(good, "12")], "a string, b string")
    row = frame.select(dumps.address_of(F.col("a"), "a"), dumps.address_of(F.col("b"), "b")).first()
    assert row[0].endswith(f"/{good}") and row[1].endswith("/12")
    for column, side in ((F.lit("1; drop"), "b"), (F.lit("x"), "a"), (F.lit(None).cast("string"), "b")):
        with pytest.raises(Exception, match="not an id"):
            frame.select(dumps.address_of(column, side)).collect()
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([("10", "x"), ("9", "y")], "native_id string, title string")

    for _ in range(2):
        assert [r["native_id"] for r in dumps.cached(make, spark, str(tmp_path / "kept")).coalesce(1).collect()] == ["9", "10"]
    assert len(calls) == 1


def test_a_fold_is_read_from_its_own_files(spark, frames, tmp_path):
    frames[0].write.partitionBy("fold").parquet(str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).filter("fold = 'test'").select("a_id", "probability")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and "ReadSchema: struct<a_id:string,probability:double>" in plan


def test_profile_extras(spark):
    masters = spark.createDataFrame([("1", "A (2)", 5, 1, 1), ("2", "B & C", None, 2, 0)], "native_id string, artist_credit string, main_release long, n_artists int, n_genres int")
    got = profile.masters_extras(masters).first().asDict()
    assert got == {"total": 2, "numeric_disambiguator_share": 0.5, "main_release_present": 0.5, "genres_present": 0.5, "multi_artist_credit_share": 0.5}
    groups = spark.createDataFrame([("a", "Album", 0), ("b", None, 7)], "native_id string, primary_type string, n_links int")
    assert {(r["measure"], r["value"], r["n"]) for r in profile.groups_extras(groups).collect()} == {("primary_type", "Album", 1), ("primary_type", "none", 1), ("links", "0", 1), ("links", "3 or more", 1)}
    links = spark.createDataFrame([("a", "1", "discogs"), ("a", "2", "discogs"), ("z", "9", None), ("a", "1", "discogs")], "a_id string, b_id string, link_type string")
    found = {(r["measure"], r["value"]): r["n"] for r in profile.links_extras(links, groups, masters).collect()}
    assert found == {("link_type", "discogs"): 3, ("link_type", "none"): 1, ("distinct", "links"): 3, ("dead", "b"): 1, ("dead", "a"): 1, ("several", "a"): 1, ("several", "b"): 0}
    items = spark.createDataFrame([("q", 1999, None, "x; y"), ("r", None, "c", "")], "item string, year int, class string, performers string")
    assert [tuple(r) for r in profile.top_classes(items).collect()] == [("c", 1), ("none", 1)]
    assert profile.items_extras(items).first()["several_performers"] == 0.5 and profile.items_extras(items.limit(0)).first()["year_present"] is None


def test_wild_years_are_counted(spark):
    from datetime import date

    frame = spark.createDataFrame([(1899,), (1900,), (2028,), (None,)], "year int")
    last = sampling.last_year_of(date(2026, 5, 1))
    assert last == 2027 and sampling.wild_years(frame, last).first()[0] == 2
    assert sorted((r[0] for r in sampling.without_wild_years(frame, last).collect()), key=repr) == [1900, None, None, None]
