"""What is published of a run and checked again later: cross-checks, figures with their parts, label blocks, bundles, receipts.

Everything here works on artifacts that a person reads, a few rows for each method, on the driver; what has a row for each
record stays a DataFrame.
"""

from __future__ import annotations

import gzip
import json
import math
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.rounding import rate
from weftline.operators import cases, decide, evaluate
from weftline.operators.decide import Policy
from weftline.sinks import bundle_bytes, canonical, forbidden_keys, sha256_bytes, sha256_canonical
from weftline.sources.dumps import replay_bundle

BUNDLE_COLUMNS = ("v1", "v2", "n_candidates", "labelled", "top1_correct", "truth_reachable")


class ContractError(ValueError):
    """Artifacts of one run that contradict each other."""


# loading


@dataclass(frozen=True)
class Run:
    """The artifacts of one run."""

    manifest: dict
    evaluations: dict[str, dict]
    methods: dict[str, dict]
    split: dict
    sensitivity: dict
    exhibits: dict[str, DataFrame]

    def policy(self, method: str) -> Policy:
        t = self.evaluations[method]["thresholds"]
        return Policy(t["auto_accept_min"], t["review_min"], t["ambiguity_gap"])


def contradictions(run: Run) -> list[str]:
    """Where the artifacts disagree about commits, manifests, populations, thresholds, run ids, row counts or digests."""
    found = []
    commits = {x.get("code_commit") for x in (*run.evaluations.values(), *run.methods.values(), run.sensitivity)}
    if len(commits) > 1:
        found.append(f"several code commits: {sorted(map(str, commits))}")
    for name, key in (("generated_at_utc", "generated_at_utc"), ("labelled_a_reachable", "metrics.labelled_a_reachable")):
        values = {_at(e, key) for e in run.evaluations.values()}
        if len(values) > 1:
            found.append(f"{name} differs between methods: {sorted(map(str, values))}")
    test = run.split["folds"]["test"]
    for m, e in run.evaluations.items():
        if e.get("manifest_sha256") != run.manifest.get("sha256"):
            found.append(f"{m}: evaluated against another manifest")
        for key, wanted in (("test_a", test["a_records"]), ("labelled_a", test["labelled_a_records"])):
            if e["metrics"][key] != wanted:
                found.append(f"{m}: {key} is {e['metrics'][key]}, the split says {wanted}")
        if run.methods[m]["thresholds"] != e["thresholds"]:
            found.append(f"{m}: the method's record and its evaluation have other thresholds")
        told = run.methods[m].get("mapping", {})
        rows = run.exhibits[m].agg(F.count(F.lit(1)).alias("n"), F.collect_set("run_id").alias("runs")).first()
        if "test_rows" in told and rows["n"] != told["test_rows"]:
            found.append(f"{m}: {rows['n']} exhibit rows, the record says {told['test_rows']}")
        if set(rows["runs"]) - {run.manifest["run_id"]}:
            found.append(f"{m}: exhibit rows of another run")
        if "test_sha256" in told and "found_sha256" in told and told["test_sha256"] != told["found_sha256"]:
            found.append(f"{m}: the exhibit is not the file that was recorded")
    return found


def load(spark: SparkSession, root: str, methods: tuple[str, ...]) -> Run:
    """The artifacts under a folder of the driver, cross-checked."""
    from weftline.schemas import MAPPING_COLUMNS
    from weftline.sources.dumps import csv_text

    read = lambda name: json.loads(Path(root, name).read_text(encoding="utf-8"))
    records = {m: read(f"methods/{m}.json") for m in methods}
    for m, r in records.items():
        file = Path(root, f"mapping/mapping_{m}.test.csv.gz")
        if "mapping" in r and file.is_file():
            r["mapping"]["found_sha256"] = sha256_bytes(file.read_bytes())
    run = Run(read("manifest.json"), {m: read(f"eval_{m}.json") for m in methods}, records, read("split.json"), read("review_sensitivity.json"), {m: csv_text(spark, f"{root}/mapping/mapping_{m}.test.csv.gz", list(MAPPING_COLUMNS)) for m in methods})
    if problems := contradictions(run):
        raise ContractError("; ".join(problems))
    return run


def _at(obj, path: str):
    for key in path.split("."):
        obj = obj[key]
    return obj


# figures with their parts

#: A metric, where it is, and where its numerator and denominator are.
PARTS = {
    "precision": ("at_auto_accept.precision", "at_auto_accept.correct", "at_auto_accept.accepted"),
    "recall_labelled": ("at_auto_accept.recall_labelled", "at_auto_accept.correct", "labelled_a_reachable"),
    "recall_overall": ("recall_overall", "at_auto_accept.correct", "labelled_a"),
    "f1": ("at_auto_accept.f1", None, None),
    "coverage": ("coverage", "accepted_all", "test_a"),
    "pair_completeness_test": ("pair_completeness_test", "labelled_a_reachable", "labelled_a"),
    "unverified_accepts_share": ("unverified_accepts.share_of_accepts", "unverified_accepts.count", "accepted_all"),
    "precision_or_review": ("at_auto_accept_or_review.precision", "at_auto_accept_or_review.correct", "at_auto_accept_or_review.accepted"),
    "recall_labelled_or_review": ("at_auto_accept_or_review.recall_labelled", "at_auto_accept_or_review.correct", "labelled_a_reachable"),
    "f1_or_review": ("at_auto_accept_or_review.f1", None, None),
}


def method_figures(run: Run, method: str) -> dict:
    """Metrics with numerator, denominator and source key, counts, policy and sweep of one method.

    The exhibit's rows are counted anew and every ratio is recomputed from its parts; what does not agree is an error.
    """
    metrics, source = run.evaluations[method]["metrics"], f"eval_{method}.json#metrics"
    tiers = {r["tier"]: r["n"] for r in run.exhibits[method].groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    accepted, queued = tiers.get("auto_accept", 0), tiers.get("review", 0)
    counted = {"auto_accept": accepted, "review": queued, "reject": metrics["test_a"] - accepted - queued}
    wrong = [f"{t}: {n} rows of {metrics['test_a']}, the share is {metrics['tier_shares'][t]}" for t, n in counted.items() if metrics["test_a"] and n / metrics["test_a"] != metrics["tier_shares"][t]]
    if queued != metrics["ambiguity_rule"]["review_queue"]:
        wrong.append(f"{queued} exhibit rows in review, the queue is {metrics['ambiguity_rule']['review_queue']}")
    held, figures = metrics | {"accepted_all": accepted}, {}
    for name, (place, above, below) in PARTS.items():
        value, n, d = _at(held, place), above and _at(held, above), below and _at(held, below)
        if above and value != rate(n, d):
            wrong.append(f"{name}: {value} is not {n} / {d}")
        figures[name] = {"value": value, "numerator": n, "denominator": d, "source_key": f"{source}.{place}"}
    if wrong:
        raise ContractError(f"{method}: " + "; ".join(wrong))
    count = lambda n, key: {"value": n, "source_key": key}
    exhibit = f"mapping/mapping_{method}.test.csv.gz"
    counts = {k: count(metrics[k], f"{source}.{k}") for k in ("test_a", "labelled_a", "labelled_a_reachable")}
    counts |= {"review_queue": count(queued, f"{source}.ambiguity_rule.review_queue"), "unverified_accepts": count(metrics["unverified_accepts"]["count"], f"{source}.unverified_accepts.count"), "exhibit_rows": count(accepted + queued, exhibit)}
    counts |= {f"tier_{t}": count(n, f"{exhibit}#tier={t}" if t != "reject" else f"{source}.test_a - {exhibit}") for t, n in counted.items()}
    sweep = run.sensitivity.get("methods", {}).get(method, {}).get("review_floor_sweep", {}).get("points", [])
    calibration = {f"{level}_{k}": metrics["calibration"][f"{level}_level"][k] for level in ("decision", "pair") for k in ("ece", "brier")} if "calibration" in metrics else {}
    return {"metrics": figures, "counts": counts, "policy": asdict(run.policy(method)), "policy_source": f"methods/{method}.json#thresholds", "calibration": calibration, "review_floor": {"source_key": f"review_sensitivity.json#methods.{method}.review_floor_sweep", "points": sweep}}


def snapshot(run: Run) -> dict:
    """All methods' figures under an id that follows from them."""
    body = {"run_id": run.manifest["run_id"], "methods": {m: method_figures(run, m) for m in run.evaluations}}
    test = run.split["folds"]["test"]
    any_ = next(iter(run.evaluations.values()))["metrics"]
    body["population"] = {"a_records": test["a_records"], "labelled_a": test["labelled_a_records"], "labelled_a_reachable": any_["labelled_a_reachable"]}
    digest = sha256_canonical(body)
    return body | {"snapshot_id": f"snap-{digest[:16]}", "analytical_digest": digest}


# labels of cases


def label_blocks(evidence: DataFrame, truth: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each case and method: case_id, a_id, method_version, labelled, truth_b_ids, n_candidates, truth_reachable,
    truth_visible (in what any method published), chosen_correct, unrounded_gap, unrounded_ambiguous.

    evidence: as cases.evidence() gives it; rows: replay rows with method_version, which have the unrounded values.
    """
    sets = truth.groupBy("a_id").agg(F.array_sort(F.collect_set("b_id")).alias("truth_b_ids"))
    visible = evidence.join(sets, "a_id").groupBy("a_id").agg(F.bool_or(F.col("exported") & F.array_contains("truth_b_ids", F.col("b_id"))).alias("_seen"))
    held = rows.select("a_id", "method_version", "v1", "v2", "n_candidates", "truth_reachable")
    out = evidence.join(sets, "a_id", "left").join(visible, "a_id", "left").join(held, ["a_id", "method_version"], "left")
    lab, gap = F.col("truth_b_ids").isNotNull(), F.col("v1") - F.col("v2")
    return out.select(
        "case_id",
        "a_id",
        "method_version",
        lab.alias("labelled"),
        F.coalesce("truth_b_ids", F.array().cast("array<string>")).alias("truth_b_ids"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(lab, F.coalesce("truth_reachable", F.lit(False))).alias("truth_reachable"),
        F.when(lab, F.coalesce("_seen", F.lit(False))).alias("truth_visible"),
        F.when(lab & F.col("exported"), F.array_contains("truth_b_ids", F.col("b_id"))).alias("chosen_correct"),
        gap.alias("unrounded_gap"),
        (gap < F.col("ambiguity_gap")).alias("unrounded_ambiguous"),
    )


def case_problems(published: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("case_id", "method_version")) -> DataFrame:
    """(keys, problem): rows that only one of two frames has, and columns in which they differ, all computed anew.

    Both are read as they are: a published document of cases against evidence, comparison or labels computed again.
    """
    columns = [c for c in fresh.columns if c not in keys]
    mine = published.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_p"))
    theirs = fresh.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in columns], F.lit(True).alias("_f"))
    both = mine.join(theirs, list(keys), "full_outer")
    known = F.col("_p").isNotNull() & F.col("_f").isNotNull()
    notes = [F.when(F.col("_f").isNull(), F.lit("published but not found again")), F.when(F.col("_p").isNull(), F.lit("found again but not published"))]
    notes += [F.when(known & ~F.col(f"_p_{c}").eqNullSafe(F.col(f"_f_{c}")), F.lit(f"{c} differs")) for c in columns]
    return both.select(*keys, F.explode(F.filter(F.array(*notes), lambda x: x.isNotNull())).alias("problem"))


def label_problems(blocks: DataFrame, evidence: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """(case_id, method_version, problem): label blocks that contradict themselves, the evidence or the tags beside them."""
    e = evidence.select("case_id", "method_version", "exported", "b_id", "tier", "top2_gap", "ambiguity_gap")
    b = blocks.join(e, ["case_id", "method_version"], "left")
    lab, gap = F.col("labelled"), F.col("unrounded_gap")
    rules = {
        "labelled without true links, or the other way round": lab != (F.size("truth_b_ids") > 0),
        "a labelled case without reachability": lab & F.col("truth_reachable").isNull(),
        "an unlabelled case with reachability": ~lab & (F.col("truth_reachable").isNotNull() | F.col("truth_visible").isNotNull()),
        "a true link is published but not reachable": F.col("truth_visible") & ~F.col("truth_reachable"),
        "chosen_correct is not what the links say": ~F.col("chosen_correct").eqNullSafe(F.when(lab & F.col("exported"), F.array_contains("truth_b_ids", F.col("b_id")))),
        "the unrounded gap does not round to the published one": F.col("exported") & (F.abs(F.round(gap, 6) - F.col("top2_gap")) > 1e-9),
        "ambiguous is not what the gap says": gap.isNotNull() & ~F.col("unrounded_ambiguous").eqNullSafe(gap < F.col("ambiguity_gap")),
    }
    found = b.select("case_id", "method_version", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in rules.items()]), lambda x: x.isNotNull())).alias("problem"))
    if tagged is None:
        return found
    per = b.groupBy("case_id").agg(F.bool_or("labelled").alias("lab"), F.max("n_candidates").alias("n"), F.bool_or("exported").alias("some"), F.bool_or(F.col("exported") & (F.col("tier") == "auto_accept") & ~F.coalesce("chosen_correct", F.lit(False))).alias("wrong"))
    t = tagged.select("case_id", "tag").join(per, "case_id")
    breaks = {"unverified_accept": F.col("lab"), "verified_wrong_accept": ~F.col("wrong"), "no_candidate": (F.col("n") != 0) | F.col("some"), "reject_all_methods": (F.col("n") == 0) | F.col("some")}
    wrong = F.lit(False)
    for tag, broken in breaks.items():
        wrong = wrong | ((F.col("tag") == tag) & F.coalesce(broken, F.lit(False)))
    return found.unionByName(t.filter(wrong).select("case_id", F.lit(None).cast("string").alias("method_version"), F.concat(F.lit("not a case of "), "tag").alias("problem")))


def selection_block(tagged: DataFrame, caps: dict[str, int] = cases.CAPS) -> dict:
    """Counts of a selection: available and selected by criterion, cases in all."""
    chosen = cases.selection(tagged, caps)
    free = {r["tag"]: r["available"] for r in cases.available(tagged).collect()}
    held = {r["tag"]: r["n"] for r in chosen.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"total_cases": chosen.count(), "counts_by_reason": held, "criteria": [{"reason_code": t, "cap": n, "available": free.get(t, 0), "selected": min(n, free.get(t, 0))} for t, n in caps.items()]}


# publication


def publish(files: dict[str, object], folder: str, allowed: frozenset[str], hidden: frozenset[str] = frozenset()) -> dict[str, str]:
    """Write objects as canonical JSON and bytes as they are, and a list of their digests; nothing outside the allowed names,
    and no object with a hidden key."""
    if extra := sorted(set(files) - allowed):
        raise ContractError(f"not to be published: {', '.join(extra)}")
    digests = {}
    for name, made in files.items():
        if not isinstance(made, bytes) and (bad := forbidden_keys(made, hidden)):
            raise ContractError(f"{name}: {', '.join(bad)}")
        data = made if isinstance(made, bytes) else canonical(made).encode("ascii")
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        digests[name] = sha256_bytes(data)
    Path(folder, "digests.json").write_text(canonical({"files": digests, "analytical_digest": sha256_canonical(digests)}), encoding="ascii")
    return digests


def published_problems(folder: str, allowed: frozenset[str], hidden: frozenset[str] = frozenset(), fresh: dict[str, object] | None = None) -> list[str]:
    """What is wrong with a published folder: files that are missing, not allowed or changed, JSON that is not canonical or has
    a hidden key, and with fresh, objects that come out otherwise now."""
    index = json.loads(Path(folder, "digests.json").read_text(encoding="ascii"))
    digests, found = index["files"], []
    if index["analytical_digest"] != sha256_canonical(digests):
        found.append("digests.json: the digest over all files is another")
    there = {p.relative_to(folder).as_posix() for p in Path(folder).rglob("*") if p.is_file()} - {"digests.json"}
    found += [f"{n}: missing" for n in sorted(set(digests) - there)] + [f"{n}: not in the list" for n in sorted(there - set(digests))] + [f"{n}: not allowed" for n in sorted(there - allowed)]
    for name in sorted(there & set(digests)):
        data = Path(folder, name).read_bytes()
        if sha256_bytes(data) != digests[name]:
            found.append(f"{name}: changed since it was published")
        if name.endswith(".json"):
            try:
                held = json.loads(data)
            except ValueError:
                found.append(f"{name}: not JSON")
                continue
            found += [f"{name}: not canonical"] * (canonical(held).encode("ascii") != data) + [f"{name}: {k}" for k in forbidden_keys(held, hidden)]
        if fresh and name in fresh and (fresh[name] if isinstance(fresh[name], bytes) else canonical(fresh[name]).encode("ascii")) != data:
            found.append(f"{name}: comes out otherwise now")
    return found


# replay bundles


def bundle_meta(rows: DataFrame, method: str, snapshot_id: str, policy: Policy, population: dict, evaluation: dict) -> dict:
    """What is published beside a bundle; an error if the rows do not reproduce the evaluation or are not its population."""
    evaluate.conservation(rows, population)
    replayed = evaluate.evaluate(rows, policy)
    shared = {k: evaluation[k] for k in replayed if k in evaluation}
    if differ := evaluate.unequal({k: replayed[k] for k in shared}, shared):
        raise ContractError(f"{method}: a replay differs from the evaluation in {', '.join(differ)}")
    return {"method_version": method, "snapshot_id": snapshot_id, "columns": list(BUNDLE_COLUMNS), "rows": population["a_records"], "population": population, "native_policy": asdict(policy), "metrics": shared, "floors": evaluate.legacy_floors(rows, policy), "divergence": divergences(rows, policy)}


def divergences(rows: DataFrame, policy: Policy) -> list[dict]:
    """The thresholds of the accept sweep at which the legacy and the corrected form differ."""
    legacy = decide.legacy_sweep(rows, policy, list(evaluate.ACCEPT_POINTS))
    return [r.asDict() for r in evaluate.divergence(legacy, evaluate.accept_sweep(rows, policy.review_min, policy.ambiguity_gap)).orderBy("threshold").collect()]


def write_bundle(rows: DataFrame, folder: str, meta: dict) -> bytes:
    """The bundle in the order of the A ids, which it does not hold, and its description."""
    data = bundle_bytes(rows, BUNDLE_COLUMNS, "a_id")
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    (place / f"replay_{meta['method_version']}.csv.gz").write_bytes(data)
    (place / f"replay_{meta['method_version']}.json").write_text(canonical(meta), encoding="ascii")
    return data


def bundle_problems(spark: SparkSession, folder: str, method: str, snapshot_id: str, policy: Policy, population: dict, evaluation: dict) -> list[str]:
    """What is wrong with a published bundle, from its two files and the evaluation alone."""
    data_path, meta_path = Path(folder, f"replay_{method}.csv.gz"), Path(folder, f"replay_{method}.json")
    if not data_path.exists() or not meta_path.exists():
        return [f"the bundle of {method} is not whole"]
    meta, found = json.loads(meta_path.read_text(encoding="ascii")), []
    rows = replay_bundle(spark, str(data_path))
    expected = {"snapshot_id": snapshot_id, "native_policy": asdict(policy), "population": population, "rows": rows.count()}
    found += [f"{k}: {meta.get(k)} instead of {v}" for k, v in expected.items() if meta.get(k) != v]
    if expected["rows"] != population["a_records"]:
        found.append(f"{expected['rows']} rows, the population has {population['a_records']}")
    found += [f"{r['n']} rows: {r['problem']}" for r in decide.bad_replay_rows(rows).collect()]
    replayed = evaluate.evaluate(rows, policy)
    found += [f"a replay differs from the evaluation in {k}" for k in evaluate.unequal({k: replayed[k] for k in replayed if k in evaluation}, {k: evaluation[k] for k in replayed if k in evaluation})]
    found += ["the floor sweep comes out otherwise"] * (evaluate.legacy_floors(rows, policy) != meta["floors"])
    found += ["the divergence of the sweeps comes out otherwise"] * (divergences(rows, policy) != meta["divergence"])
    with gzip.open(data_path, "rt", encoding="ascii") as f:
        header = f.readline().rstrip("\n").split(",")
    if header != list(BUNDLE_COLUMNS):
        found.append("the header is another")
    else:
        # the file has no ids: its rows keep the order they are read in
        again = bundle_bytes(rows.coalesce(1).withColumn("_at", F.monotonically_increasing_id()), BUNDLE_COLUMNS, "_at")
        found += ["the bytes are not those that its rows are written as"] * (again != data_path.read_bytes())
    return found


# scenarios and receipts

SCENARIO = re.compile(r"^[A-Za-z0-9_.:@-]{1,120}$")


def scenario_id(kind: str, name: str, *numbers: float) -> str:
    """native:<method>, floor:<method>:<floor>, replay:<method>:<accept>:<review>:<gap> or synthetic:<preset>"""
    wanted = {"native": 0, "floor": 1, "replay": 3, "synthetic": 0}
    if wanted.get(kind) != len(numbers):
        raise ValueError(f"a scenario of kind {kind!r} with {len(numbers)} numbers")
    if kind == "synthetic":
        name = re.sub(r"[^A-Za-z0-9_.:@-]", "_", name)[:100]
    made = ":".join([kind, name, *(repr(float(x)) if x != int(x) else str(int(x)) for x in numbers)])
    if not SCENARIO.match(made):
        raise ValueError(f"not a scenario id: {made!r}")
    return made


@dataclass(frozen=True)
class Receipt:
    """A decision about a scenario, with what was seen, what else there was and what is not known."""

    snapshot_id: str
    analytical_digest: str
    scenario: str
    decision: str
    rationale: str
    observations: list[dict] = field(default_factory=list)
    alternatives: list[dict] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)

    def export(self) -> str:
        body = asdict(self)
        return canonical(body | {"receipt_id": f"r-{sha256_canonical(body)[:16]}"})


def observations(figures: dict, method: str, floor: float | None = None, replayed: dict | None = None, policy: Policy | None = None) -> list[dict]:
    """(claim, value, source_key, verified_by) of a method's recorded figures, of a floor of its sweep, and of a replay."""
    m, out = figures["methods"][method], []
    see = lambda claim, value, key, by="artifact": out.append({"claim": claim, "value": value, "source_key": key, "verified_by": by})
    for key in ("precision", "recall_labelled", "recall_overall", "f1", "coverage"):
        x = m["metrics"][key]
        see(f"{key} of {method} at its recorded policy", x["value"] if x["denominator"] != 0 else None, x["source_key"])
    for key in ("review_queue", "unverified_accepts"):
        see(f"{key} of {method} at its recorded policy", m["counts"][key]["value"], m["counts"][key]["source_key"])
    for p in m["review_floor"]["points"] if floor is not None else ():
        if p["floor"] == floor:
            for key in ("queue_total", "queue_floor", "queue_ambiguity", "recall_with_review"):
                see(f"{key} at floor {floor}", p[key], f"{m['review_floor']['source_key']}[floor={floor}].{key}")
    if replayed and policy:
        name = f"replay({policy.accept_min}, {policy.review_min}, {policy.ambiguity_gap})"
        for place in ("at_auto_accept.precision", "at_auto_accept.recall_labelled", "at_auto_accept.f1", "coverage", "ambiguity_rule.review_queue", "unverified_accepts.count"):
            see(f"{place} of {method} under another policy", _at(replayed, place), f"{name}#{place}", "replay")
    return out


def alternatives(figures: dict, method: str, chosen_floor: float | None = None, most: int = 50) -> list[dict]:
    """The other methods at their own policies and the other floors of the chosen one."""
    out = [{"option": scenario_id("native", m), "figures": {"f1": x["metrics"]["f1"]["value"], "review_queue": x["counts"]["review_queue"]["value"]}} for m, x in figures["methods"].items() if m != method]
    for p in sorted(figures["methods"][method]["review_floor"]["points"], key=lambda p: p["floor"]):
        if p["floor"] != chosen_floor:
            out.append({"option": scenario_id("floor", method, p["floor"]), "figures": {"queue_total": p["queue_total"], "recall_with_review": p["recall_with_review"]}})
    return out[:most]


def import_receipt(text: str, figures: dict) -> tuple[Receipt | None, list[str]]:
    """(the receipt, problems): one of other evidence or with figures that are not the evidence's is not taken."""
    try:
        body = json.loads(text)
        claimed = body.pop("receipt_id")
        made = Receipt(**body)
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        return None, [f"not a receipt: {e}"]
    found = []
    if claimed != f"r-{sha256_canonical(body)[:16]}":
        found.append("the id is not that of the content")
    if (made.snapshot_id, made.analytical_digest) != (figures["snapshot_id"], figures["analytical_digest"]):
        found.append("made from other evidence")
    elif not SCENARIO.match(made.scenario):
        found.append("the scenario's id is malformed")
    else:
        known = {o["source_key"]: o["value"] for m in figures["methods"] for f in [None, *[p["floor"] for p in figures["methods"][m]["review_floor"]["points"]]] for o in observations(figures, m, f)}
        found += [f"{o['claim']}: {o['value']} instead of {known[o['source_key']]}" for o in made.observations if o["verified_by"] == "artifact" and o["source_key"] in known and o["value"] != known[o["source_key"]]]
        found += [f"{o['claim']}: no such figure" for o in made.observations if o["verified_by"] == "artifact" and o["source_key"] not in known]
    return (None if found else made), found


# a sandbox and fixtures

#: Policies that a sandbox is decided under.
PRESETS = {"native": Policy(0.95, 0.5, 0.1), "lowered_accept": Policy(0.75, 0.5, 0.1), "wide_gap": Policy(0.95, 0.5, 0.25)}
#: (A id, candidates with their values): each reason of the rule, ties, boundaries and a record without candidates.
SANDBOX = (
    ("s01", {"1": 0.98, "2": 0.4}),
    ("s02", {"1": 0.97, "2": 0.93}),
    ("s03", {"1": 0.96, "2": 0.96}),
    ("s04", {"1": 0.8, "2": 0.6}),
    ("s05", {"1": 0.8}),
    ("s06", {"1": 0.55, "2": 0.5}),
    ("s07", {"1": 0.5}),
    ("s08", {"1": 0.49, "2": 0.1}),
    ("s09", {"1": 0.95, "2": 0.85}),
    ("s10", {"1": 1.0, "2": 0.8}),
    ("s11", {}),
    ("s12", {"10": 0.9, "9": 0.9}),
)


def expected_decision(values: dict[str, float], policy: Policy) -> dict:
    """A record's decision as the rule says it, for a few candidates on the driver."""
    ranked = sorted(values.items(), key=lambda x: (-x[1], x[0]))
    v1, v2 = (ranked[0][1] if ranked else None), (ranked[1][1] if len(ranked) > 1 else None)
    told = evaluate.why(v1, v2, policy)
    return {"b_id": ranked[0][0] if ranked else None, "tier": told["tier"], "reason": told["reason"], "gap": told["gap"], "demoted": told["reason"] == "ambiguity_gap_below_threshold" and v1 >= policy.accept_min}


def sandbox_decisions(spark: SparkSession, policy: Policy, records=SANDBOX) -> DataFrame:
    """(a_id, b_id, tier, reason, gap, demoted) of the sandbox's records by the engine."""
    pairs = spark.createDataFrame([(a, b, float(v)) for a, values in records for b, v in values.items()], "a_id string, b_id string, probability double")
    every = spark.createDataFrame([(a,) for a, _ in records], "a_id string")
    c = decide.decision_columns(F.lit(policy.accept_min), F.lit(policy.review_min), F.lit(policy.ambiguity_gap))
    return every.join(decide.top_two(pairs), "a_id", "left").withColumns(c).select("a_id", "b_id", "tier", "reason", "gap", "demoted")


def unmet_expectations(spark: SparkSession, records=SANDBOX, presets=PRESETS) -> list[str]:
    """Where the engine's decisions about the sandbox are not those the rule says, by preset and record."""
    found = []
    for name, policy in presets.items():
        got = {r["a_id"]: r.asDict() for r in sandbox_decisions(spark, policy, records).collect()}
        for a, values in records:
            wanted, held = expected_decision(values, policy), got[a]
            found += [f"{name}/{a}: {k} is {held[k]}, {wanted[k]} expected" for k in wanted if held[k] != wanted[k]]
    return found


def policy_fixtures(records=SANDBOX, presets=PRESETS) -> dict:
    """Cases for other implementations of the rule: rows, policies with the decisions they lead to, policies that must be
    refused, and rankings of candidates with ties."""
    rows = [{"a_id": a, "candidates": [{"b_id": b, "value": v} for b, v in values.items()]} for a, values in records]
    refused = [(1.2, 0.5, 0.1), (0.5, 0.6, 0.1), (0.9, -0.1, 0.1), (0.9, 0.5, -0.1), (0.9, 0.5, 1.1), (True, 0.5, 0.1)]
    for p in (*refused, (math.nan, 0.5, 0.1)):
        try:
            Policy(*p)
        except decide.PolicyError:
            continue
        raise AssertionError(f"{p} was not refused")
    return {
        "rows": rows,
        "policies": [{"name": n, "policy": asdict(p), "expected": [{"a_id": a} | expected_decision(v, p) for a, v in records]} for n, p in presets.items()],
        "refused": [list(p) for p in refused],
        "rankings": [{"candidates": [{"b_id": b, "value": v} for b, v in values.items()], "order": [b for b, _ in sorted(values.items(), key=lambda x: (-x[1], x[0]))]} for _, values in records if len(values) > 1],
    }
