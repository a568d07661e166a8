"""The full build: sample, check, block, featurise, decide and evaluate with each method, and write what is published.

python -m weftline.plans.build TABLES OUT

Stages in order: load, truth, sample, contracts, truth audit, blocking, split, features, methods, publication. Each is timed;
what it says goes into an artifact of its own, in the shapes that the warehouse reads.
"""

from __future__ import annotations

import resource
import sys
import time
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.hashing import fold_of, sorted_digest
from weftline.functions.rounding import rate
from weftline.operators import blocking, decide, evaluate, methods, sampling
from weftline.operators.decide import Policy
from weftline.operators.features import pair_features
from weftline.schemas import KEY_TYPES
from weftline.sinks import read_scored, sha256_canonical, write_exhibit, write_json, write_scored, write_table
from weftline.sources import catalogue

FEATURE_VERSION = "f1"
SCOPE, UNLINKED_SHARE = "en", 0.5
BOUNDS = {"fit": [0, 60], "calibrate": [60, 80], "test": [80, 100]}


class Runtime:
    """Seconds of each stage, the bytes under the output folder after it, and the most memory that the driver's Python has held."""

    def __init__(self, spark: SparkSession, out: str):
        self.stages: dict[str, dict] = {}
        self.spark, self.out = spark, out
        self.clock = time.monotonic()

    def size(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.out)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(path).getLength() if files.exists(path) else 0

    def done(self, stage: str, **facts) -> None:
        now = time.monotonic()
        self.stages[stage] = {"seconds": round(now - self.clock, 3), "output_bytes": self.size(), "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024} | facts
        self.clock = now


def blocking_report(a: DataFrame, b: DataFrame, truth: DataFrame, cap: int, gate: int) -> tuple[DataFrame, dict]:
    """(candidates, the report): the gate is on all pairs of the union, before the cap and before any feature."""
    keys_a, keys_b = blocking.key_frame(a), blocking.key_frame(b)
    pairs = blocking.pair_keys(keys_a, keys_b)
    union = blocking.union_pairs(pairs)
    n_union = blocking.gate(union, gate)
    kept = blocking.capped(union, cap)
    n_a, n_b, n_kept = a.count(), b.count(), kept.count()
    found = {r["measure"]: (r["found"], r["truth_pairs"]) for r in blocking.completeness(truth, pairs, union, kept).collect()}
    share = lambda k: rate(*found[k]) if k in found else None
    by_key = {r["key_type"]: r for r in blocking.counts_by_key(keys_a, pairs).collect()}
    largest: dict[str, list[int]] = {}
    for r in blocking.largest_blocks(keys_a).orderBy("key_type", "rank").collect():
        largest.setdefault(r["key_type"], []).append(r["block_size"])
    report = {
        "candidate_cap_per_a": cap,
        "union_pairs": n_union,
        "candidate_pairs_after_cap": n_kept,
        "cross_product": n_a * n_b,
        "reduction_ratio": blocking.reduction_ratio(n_a, n_b, n_kept),
        "overflow": blocking.overflow(union, cap).first().asDict(),
        "keys_emitted": {"a": {k: r["keys_emitted"] for k, r in by_key.items()}, "b": {r["key_type"]: r["keys_emitted"] for r in blocking.counts_by_key(keys_b).collect()}},
        "per_key_pairs": {k: by_key[k]["pairs"] if k in by_key else 0 for k in KEY_TYPES},
        "largest_blocks": largest,
        "pair_completeness": {"union": share("union"), "after_cap": share("after_cap"), "per_key": {k: share(k) for k in KEY_TYPES if k in found}, "lost_to_cap": found["union"][0] - found["after_cap"][0]},
    }
    return kept, report


def contracts_of(side: DataFrame, last_year: int) -> list[dict]:
    return [{"name": r["check_name"], "passed": r["passed"], "violations": r["violations"]} for r in sampling.contract_report(side, last_year).collect()]


def truth_report(truth: DataFrame, links: DataFrame) -> dict:
    held = {r["measure"]: r["n"] for r in sampling.truth_audit(truth, links).collect()}
    held["links_distinct"] = held["links_raw"] - held["duplicate_links"]
    examples: dict[str, list[str]] = {}
    for r in sampling.anomaly_examples(truth).orderBy("status", "pair_hash").collect():
        examples.setdefault(r["status"], []).append(r["pair_hash"])
    return held | {"truth_dead_rate": rate(held["truth_dead"], held["links_distinct"]), "examples": examples}


def decision_values(spark: SparkSession, out: str, run_id: str, method: str, features: DataFrame) -> DataFrame | None:
    """The scored pairs of a method: those that its run has written, if they are whole, else computed again; None for the
    learned method without them, which no features can replace."""
    kept = read_scored(spark, f"{out}/scored/{method}", run_id, method)
    if kept is not None:
        return kept
    again = {"exact_v1": methods.exact_score, "rules_v1": methods.rules_score}.get(method)
    return methods.scored(features, again()) if again else None


def run(spark: SparkSession, tables: str, out: str, cap: int = blocking.CAP, learned: bool = True, today: date | None = None, unlinked_share: float = UNLINKED_SHARE, gate: int = blocking.PAIR_GATE) -> dict:
    """The metrics of each method. Candidates' features are written once, since every method reads them."""
    runtime, started = Runtime(spark, out), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    last_year = sampling.last_year_of(today or datetime.now(UTC).date())
    save = lambda obj, name: write_json(obj, f"{out}/{name}", spark=spark)

    every_a, every_b = catalogue.sides(spark, tables, phonetic=True)
    links = catalogue.links(spark, tables)
    runtime.done("load")
    truth = sampling.classify_links(links, every_a, every_b, SCOPE)
    inside = truth.filter("status = 'truth_in_sample'")
    runtime.done("truth")

    pool_a, pool_b = sampling.pools(every_a, every_b, links, SCOPE)
    samples, thresholds = {}, {}
    for side, frame, pool in (("a", every_a, pool_a), ("b", every_b, pool_b)):
        linked = inside.select(F.col(f"{side}_id").alias("native_id")).distinct()
        n = sampling.unlinked_wanted(linked.count(), unlinked_share)
        sample, thresholds[side] = sampling.side_sample(frame, side, linked, n, pool)
        written = write_table(sampling.without_wild_years(sample, last_year), f"{out}/sample/{side}")
        samples[side] = spark.read.parquet(written["path"])
        thresholds[side] = {"threshold": thresholds[side], "unlinked_wanted": n, "rows": written["rows"], "content": written["content"], "years_nulled": sampling.wild_years(sample, last_year).first()[0]}
    a, b = samples["a"], samples["b"]
    truth = sampling.apply_sample(truth, a, b)
    write_table(truth, f"{out}/truth")
    truth = spark.read.parquet(f"{out}/truth")
    inside = truth.filter("status = 'truth_in_sample'").select("a_id", "b_id")
    runtime.done("sample", rows={s: t["rows"] for s, t in thresholds.items()})

    checks = {"a": contracts_of(a, last_year), "b": contracts_of(b, last_year)}
    save(checks, "contracts.json")
    runtime.done("contracts")
    save(truth_report(truth, links), "truth_audit.json")
    runtime.done("truth_audit")

    pairs, report = blocking_report(a, b, inside, cap, gate)
    save(report, "blocking_report.json")
    runtime.done("blocking")
    split = {r["fold"]: {k: r[k] for k in ("a_records", "labelled_a_records", "truth_pairs", "candidate_pairs")} for r in sampling.split_report(a, inside, pairs).collect()}
    save({"bounds": BOUNDS, "folds": split}, "split.json")
    runtime.done("split")

    written = write_table(pair_features(pairs, a, b).withColumn("fold", fold_of(F.col("a_id"))), f"{out}/features", ("fold",))
    features = spark.read.parquet(f"{out}/features")
    run_id = f"run-{written['content'][:16]}"
    runtime.done("features", rows=written["rows"])

    population = a.select(F.col("native_id").alias("a_id"))
    test_a = population.filter(fold_of(F.col("a_id")) == "test")
    scored: dict[str, tuple[DataFrame, Policy, dict]] = {"exact_v1": (methods.scored(features, methods.exact_score()), Policy(), {})}
    rules = methods.scored(features, methods.rules_score())
    labelled = methods.with_labels(rules.filter("fold = 'fit'"), inside).filter("label is not null")
    best = decide.top_two(labelled, ("label",)).select(F.col("v1").alias("score"), (F.col("label") == 1).alias("correct"))
    base = labelled.filter("label = 1").select("a_id").distinct().count()
    scored["rules_v1"] = (rules, Policy(*methods.fit_thresholds(best, base)), {"fitted_on": base})
    if learned:
        model = methods.fit_learned(features, inside)
        scored["learned_v1"] = (model.score(features).select("a_id", "b_id", "fold", "block_keys", "score", "probability"), Policy(), model.record)
    results, sweeps = {}, {}
    for name, (frame, policy, parameters) in scored.items():
        about = write_scored(frame, f"{out}/scored/{name}", run_id, name)
        frame = spark.read.parquet(f"{out}/scored/{name}")
        published = decide.mapping(decide.decide(frame, policy), name, FEATURE_VERSION, run_id, started)
        write_table(published, f"{out}/mapping/{name}")
        exhibit = write_exhibit(published.filter("fold = 'test'"), f"{out}/mapping/mapping_{name}.test.csv.gz")
        rows = decide.replay_rows(frame.filter("fold = 'test'"), test_a, inside)
        results[name] = evaluate.full_evaluation(frame, population, rows, inside, policy)
        points = {"auto_accept_min": policy.accept_min, "review_min": policy.review_min, "ambiguity_gap": policy.ambiguity_gap}
        save({"method_version": name, "generated_at_utc": started, "run_id": run_id, "fold_counts": evaluate.fold_counts(frame, population, inside, policy), "metrics": results[name], "thresholds": points, "definitions": evaluate.DEFINITIONS}, f"eval_{name}.json")
        save({"method_version": name, "feature_version": FEATURE_VERSION, "thresholds": points, "parameters": parameters, "scored_pairs": about, "mapping": {"test_rows": exhibit["rows"], "content": exhibit["content"]}}, f"methods/{name}.json")
        sweeps[name] = {"review_min": policy.review_min, "chosen_accept_threshold": policy.accept_min, "points": evaluate.legacy_costs(rows, policy), "review_floor_sweep": {"points": evaluate.legacy_floors(rows, policy)}}
        runtime.done(name)
    save({"methods": sweeps}, "review_sensitivity.json")
    suspicious = methods.too_good({m: x["at_auto_accept"] for m, x in results.items()})
    manifest = {"run_id": run_id, "created_at_utc": started, "sources": [{"name": s, "records": t["rows"], "sha256": sorted_digest(samples[s].select("native_id", "title", "artist_credit", "year"))} for s, t in thresholds.items()], "sample": thresholds, "features": written["content"], "rows": written["rows"], "suspicious": suspicious}
    manifest |= {"digested": ["features", "rows", "sample"], "sha256": sha256_canonical({k: manifest[k] for k in ("features", "rows", "sample")}), "runtime": runtime.stages}
    save(manifest, "manifest.json")
    methods.stop_if_too_good({m: x["at_auto_accept"] for m, x in results.items()})
    return results


if __name__ == "__main__":
    from weftline.session import session

    try:
        print(run(session("build"), sys.argv[1], sys.argv[2]))
    except methods.TooGood as stopped:
        print(stopped, file=sys.stderr)
        sys.exit(methods.TooGood.exit_code)
