"""Evaluation on the held-out fold: counts on executors, rates on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.hashing import fold_of
from weftline.functions.rounding import rate
from weftline.operators.decide import Policy, decide, legacy_sweep, policy_table, replay
from weftline.operators.methods import with_labels

# The upper edges of the calibration bins as evenly spaced doubles come out, and the sweeps' points.
BIN_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)
COST_RATIOS = (1, 5, 20)
ACCEPT_POINTS = tuple(round(0.5 + 0.01 * i, 2) for i in range(50))
FLOOR_POINTS = tuple(round(0.05 * i, 2) for i in range(1, 20))

#: What each figure of an evaluation is.
DEFINITIONS = {
    "test_a": "A records of the test fold, labelled or not.",
    "labelled_a": "Test records of A that have a true link in the sample.",
    "labelled_a_reachable": "Those of them with a true link among their candidates.",
    "pair_completeness_test": "labelled_a_reachable over labelled_a: what blocking lets through, by A record.",
    "precision": "Of the accepted labelled test records, the share whose accepted B is a true link.",
    "recall_labelled": "Right accepts over labelled_a_reachable; a record without a link is not counted against it.",
    "recall_overall": "Right accepts over labelled_a, so what blocking loses counts too.",
    "f1": "Harmonic mean of the rounded precision and recall_labelled.",
    "at_auto_accept_or_review": "The same if every queued record were resolved rightly: an upper bound.",
    "coverage": "Accepted test records over all test records. A volume, not a quality.",
    "coverage_all_folds": "Accepted records over all sampled A records of every fold. A volume, not a quality.",
    "unverified_accepts": "Accepted test records without a label, and their share of all test accepts.",
    "tier_shares": "The share of test records in each tier; a record without candidates is a reject. They add up to one.",
    "ambiguity_rule": "Decisions that a second candidate close behind moved from accept to review, and the queue's length.",
    "calibration": "Ten bins of equal width: decision_level over the best candidates of labelled test records, pair_level over all their pairs. ECE weighs the gaps between mean and observed rate by the bins' sizes; Brier is the mean squared error.",
    "confusion": "Labelled test pairs at or above each tier's boundary (tp, fp) and below it (fn, tn).",
}


def prf(correct: int, accepted: int, base: int) -> dict:
    """F1 from the rounded precision and recall; 0 if nothing is right though something was asked for."""
    p, r = rate(correct, accepted), rate(correct, base)
    f1 = round(2 * p * r / (p + r), 6) if p and r else 0.0 if accepted or base else None
    return {"accepted": accepted, "correct": correct, "precision": p, "recall_labelled": r, "f1": f1}


def bin_of(p: Column) -> Column:
    """0 to 9; an edge belongs to the bin above it."""
    out = F.lit(len(BIN_EDGES))
    for i, edge in reversed(list(enumerate(BIN_EDGES))):
        out = F.when(p < edge, i).otherwise(out)
    return out


def calibration_bins(judged: DataFrame, prob: str = "probability", label: str = "label") -> DataFrame:
    """(bin_index, n, mean_probability, observed_rate) of all ten bins."""
    held = judged.groupBy(bin_of(F.col(prob)).alias("bin_index")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("observed_rate"))
    return judged.sparkSession.range(10).select(F.col("id").cast("int").alias("bin_index")).join(held, "bin_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reliability(judged: DataFrame, prob: str = "probability", label: str = "label") -> dict:
    bins = calibration_bins(judged, prob, label).orderBy("bin_index").collect()  # ten rows
    edges = (0.0, *BIN_EDGES, 1.0)
    n = sum(b["n"] for b in bins)
    brier = judged.agg(F.avg((F.col(prob) - F.col(label).cast("double")) ** 2)).first()[0]
    ece = sum(b["n"] / n * abs(b["mean_probability"] - b["observed_rate"]) for b in bins if b["n"]) if n else None
    six = lambda x: None if x is None else round(x, 6)
    shown = [{"lower": six(edges[i]), "upper": six(edges[i + 1]), "n": b["n"], "mean_probability": six(b["mean_probability"]), "observed_rate": six(b["observed_rate"])} for i, b in enumerate(bins)]
    return {"n": n, "bins": shown, "ece": None if ece is None else round(ece, 6), "brier": None if brier is None else round(brier, 6)}


def confusion(judged: DataFrame, at: float, prob: str = "probability", label: str = "label") -> DataFrame:
    above, right = F.col(prob) >= at, F.col(label) == 1
    return judged.agg(F.count_if(above & right).alias("tp"), F.count_if(above & ~right).alias("fp"), F.count_if(~above & right).alias("fn"), F.count_if(~above & ~right).alias("tn"))


def metrics_of(counts: dict) -> dict:
    """Every rate of a policy from its replay counts."""
    c = counts
    at = prf(c["correct"], c["accepted"], c["labelled_a_reachable"])
    either = prf(c["correct"] + c["queued_reachable"], c["accepted"] + c["queued_labelled"], c["labelled_a_reachable"])
    share = lambda k: c[k] / c["test_a"] if c["test_a"] else None
    return {
        "test_a": c["test_a"],
        "labelled_a": c["labelled_a"],
        "labelled_a_reachable": c["labelled_a_reachable"],
        "no_candidate_a": c["no_candidate_a"],
        "pair_completeness_test": rate(c["labelled_a_reachable"], c["labelled_a"]),
        "at_auto_accept": at,
        "at_auto_accept_or_review": either,
        "recall_overall": rate(c["correct"], c["labelled_a"]),
        "coverage": rate(c["accepted_all"], c["test_a"]),
        "accepted_all": c["accepted_all"],
        "unverified_accepts": {"count": c["unverified"], "share_of_accepts": rate(c["unverified"], c["accepted_all"])},
        "tier_shares": {"auto_accept": share("accepted_all"), "review": share("review_all"), "reject": share("rejected_all")},
        "ambiguity_rule": {"decisions_moved_to_review": c["demoted"], "ambiguous_non_reject": c["ambiguous"], "review_queue": c["review_all"]},
    }


def evaluate(rows: DataFrame, policy: Policy) -> dict:
    """All metrics of one policy over replay rows."""
    got = replay(rows, policy_table(rows.sparkSession, [policy])).first()
    zero = dict.fromkeys(("test_a", "labelled_a", "labelled_a_reachable", "no_candidate_a", "accepted", "correct", "queued_labelled", "queued_reachable", "accepted_all", "review_all", "rejected_all", "unverified", "demoted", "ambiguous"), 0)
    return metrics_of(got.asDict() if got else zero)


def coverage_all_folds(decisions: DataFrame, population: DataFrame) -> float | None:
    """Accepted records over all sampled A records, whatever their fold."""
    return rate(decisions.filter("tier = 'auto_accept'").count(), population.count())


def judged_decisions(rows: DataFrame) -> DataFrame:
    """(probability, label) of the best candidates of labelled records, from replay rows."""
    return rows.filter("labelled and v1 is not null").select(F.col("v1").alias("probability"), F.col("top1_correct").cast("int").alias("label"))


def full_evaluation(pairs: DataFrame, population: DataFrame, rows: DataFrame, truth: DataFrame, policy: Policy) -> dict:
    """Every figure of a method: evaluate() and what needs all folds or all pairs.

    pairs: scored pairs with their fold; population: (a_id) of all sampled A records; rows: replay rows of the test fold.
    """
    metrics = evaluate(rows, policy)
    metrics["coverage_all_folds"] = coverage_all_folds(decide(pairs, policy), population)
    test = judged_pairs(pairs.filter("fold = 'test'"), truth)
    metrics["calibration"] = {"decision_level": reliability(judged_decisions(rows)), "pair_level": reliability(test)}
    metrics["confusion"] = {name: confusion(test, at).first().asDict() for name, at in (("auto_accept", policy.accept_min), ("review", policy.review_min))}
    return metrics


def fold_counts(pairs: DataFrame, population: DataFrame, truth: DataFrame, policy: Policy) -> dict:
    """By fold: A records, labelled ones, candidate pairs and decisions."""
    labelled = truth.select("a_id").distinct()
    by = lambda df: {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    folded = population.select("a_id", fold_of(F.col("a_id")).alias("fold"))
    counts = {"a_records": by(folded), "labelled_a_records": by(folded.join(labelled, "a_id", "left_semi")), "candidate_pairs": by(pairs), "decisions": by(decide(pairs, policy))}
    return {f: {k: v.get(f, 0) for k, v in counts.items()} for f in ("fit", "calibrate", "test")}


class NotConserved(ValueError):
    """Replay rows that are not the population they are said to be."""


def conservation(rows: DataFrame, expected: dict) -> dict:
    """How many records the rows hold, of which kinds; an error if a number differs from the expected one."""
    got = rows.agg(F.count(F.lit(1)).alias("a_records"), F.countDistinct("a_id").alias("distinct_a"), F.count_if(F.col("n_candidates") > 0).alias("with_candidates"), F.count_if("labelled").alias("labelled_a"), F.count_if(F.col("labelled") & F.col("truth_reachable")).alias("labelled_a_reachable")).first().asDict()
    got["without_candidates"] = got["a_records"] - got["with_candidates"]
    wrong = [f"{k}: {got[k]} instead of {n}" for k, n in expected.items() if got[k] != n]
    if got["distinct_a"] != got["a_records"]:
        wrong.append(f"{got['a_records'] - got['distinct_a']} repeated A records")
    if wrong:
        raise NotConserved("; ".join(wrong))
    return got


def judged_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The labelled pairs with their label."""
    return with_labels(pairs, truth).filter("label is not null")


def accept_sweep(rows: DataFrame, review_min: float, gap: float, thresholds=ACCEPT_POINTS) -> DataFrame:
    """A full replay at every threshold from review_min on: counts as in replay()."""
    return replay(rows, policy_table(rows.sparkSession, [Policy(t, review_min, gap) for t in thresholds if t >= review_min]))


def floor_sweep(rows: DataFrame, accept_min: float, gap: float, floors=FLOOR_POINTS) -> DataFrame:
    """A full replay at every floor below accept_min."""
    return replay(rows, policy_table(rows.sparkSession, [Policy(accept_min, f, gap) for f in floors if f < accept_min]))


def review_costs(sweep: DataFrame, ratios=COST_RATIOS) -> DataFrame:
    """(threshold, cost_ratio, ..., total_cost): a unit for each queued record, the ratio for each expected false accept."""
    wrong = F.col("accepted_all") * (1 - F.col("correct") / F.col("accepted"))
    expected = F.when(F.col("accepted") > 0, wrong)
    return sweep.withColumn("expected_false_accepts", expected).withColumn("cost_ratio", F.explode(F.array(*map(F.lit, ratios)))).select(F.col("accept_min").alias("threshold"), "cost_ratio", F.col("accepted_all").alias("accepts"), F.col("review_all").alias("review_queue"), "expected_false_accepts", (F.col("review_all") + F.col("expected_false_accepts") * F.col("cost_ratio")).alias("total_cost"))


def legacy_costs(rows: DataFrame, baseline: Policy, thresholds=ACCEPT_POINTS, ratios=COST_RATIOS) -> list[dict]:
    """The points of the legacy sweep with labelled precision, expected false accepts and the cost at each ratio.

    The numbers of a few thresholds come to the driver, where they are rounded.
    """
    points = []
    for p in sorted(legacy_sweep(rows, baseline, list(thresholds)).collect(), key=lambda r: r["threshold"]):
        precision = p["correct"] / p["labelled_accepts"] if p["labelled_accepts"] else None
        wrong = None if precision is None else round(p["accepts"] * (1 - precision), 3)
        cost = {str(r): None if wrong is None else round(p["review_queue"] + wrong * r, 3) for r in ratios}
        points.append({k: p[k] for k in ("threshold", "accepts", "queue_floor", "queue_ambiguity", "review_queue")} | {"precision_labelled": None if precision is None else round(precision, 6), "expected_false_accepts": wrong, "total_cost": cost})
    return points


def legacy_floors(rows: DataFrame, baseline: Policy, floors=FLOOR_POINTS) -> list[dict]:
    """Queue and recall at each floor below accept_min, with the baseline's demotions at every floor."""
    from weftline.operators.decide import decision_columns

    c = decision_columns(F.lit(baseline.accept_min), F.lit(baseline.review_min), F.lit(baseline.ambiguity_gap))
    flagged = rows.withColumns(c).withColumn("found", F.coalesce(F.col("labelled") & F.col("truth_reachable"), F.lit(False)))
    v, moved, found = F.col("v1"), F.col("demoted"), F.col("found")
    right = F.coalesce(F.col("labelled") & F.col("top1_correct"), F.lit(False))
    one = flagged.agg(F.count(F.lit(1)).alias("test_a"), F.count_if(found).alias("reachable"), F.count_if((F.col("tier") == "auto_accept") & right).alias("correct"), F.count_if(moved).alias("moved"), F.count_if(moved & found).alias("moved_found"), *[F.count_if((v >= f) & (v < baseline.accept_min)).alias(f"n{i}") for i, f in enumerate(floors)], *[F.count_if((v >= f) & (v < baseline.accept_min) & found).alias(f"f{i}") for i, f in enumerate(floors)]).first()
    out = []
    for i, f in enumerate(floors):
        if f < baseline.accept_min:
            total = one[f"n{i}"] + one["moved"]
            out.append({"floor": f, "queue_floor": one[f"n{i}"], "queue_ambiguity": one["moved"], "queue_total": total, "queue_share_of_test_a": rate(total, one["test_a"]), "recall_with_review": rate(one["correct"] + one[f"f{i}"] + one["moved_found"], one["reachable"])})
    return out


def divergence(legacy: DataFrame, corrected: DataFrame) -> DataFrame:
    """(threshold, accepts_legacy, accepts_corrected, difference) where two sweeps differ."""
    both = legacy.select("threshold", F.col("accepts").alias("accepts_legacy")).join(corrected.select(F.col("accept_min").alias("threshold"), F.col("accepted_all").alias("accepts_corrected")), "threshold")
    return both.withColumn("difference", F.col("accepts_corrected") - F.col("accepts_legacy")).filter("difference <> 0")


def unequal(left: dict, right: dict, prefix: str = "") -> list[str]:
    """The dotted keys at which two metric trees differ, exactly."""
    found = []
    for key in sorted(left.keys() | right.keys()):
        a, b, name = left.get(key), right.get(key), f"{prefix}{key}"
        found += unequal(a, b, f"{name}.") if isinstance(a, dict) and isinstance(b, dict) else [] if a == b else [name]
    return found


def feasible_floors(points: list[dict], budget: int) -> list[dict]:
    """The floor points whose queue fits the budget, highest floor first."""
    return sorted((p for p in points if p["queue_total"] <= budget), key=lambda p: -p["floor"])


def best_by(metrics: dict[str, float | None]) -> str | None:
    """The method with the highest value; the first of equals, in the given order."""
    known = [(m, v) for m, v in metrics.items() if v is not None]
    return max(known, key=lambda x: x[1])[0] if known else None


def statements(methods: dict[str, dict]) -> list[dict]:
    """What the figures of several methods say, each statement with the keys it rests on.

    methods: by name {"metrics": {...}, "counts": {...}, "policy": {...}, "calibrated": bool}, in the order in which the first
    of equals wins.
    """
    of = lambda part, key: {m: x[part].get(key) for m, x in methods.items()}
    out = []
    say = lambda text, *keys: out.append({"text": text, "keys": list(keys)})
    f1, precision = best_by(of("metrics", "f1")), best_by(of("metrics", "precision"))
    queue = best_by({m: None if n is None else -n for m, n in of("counts", "review_queue").items()})
    if f1:
        say(f"{f1} has the highest F1 at its own policy, {methods[f1]['metrics']['f1']}.", f"{f1}.metrics.f1")
    if precision:
        say(f"{precision} has the highest precision on labelled records, {methods[precision]['metrics']['precision']}.", f"{precision}.metrics.precision")
    if queue:
        say(f"{queue} has the shortest review queue, {methods[queue]['counts']['review_queue']} records.", f"{queue}.counts.review_queue")
    if f1 and precision and f1 != precision:
        less = [k for k in ("recall_labelled", "coverage") if None not in (a := (methods[precision]["metrics"].get(k), methods[f1]["metrics"].get(k))) and a[0] < a[1]]
        if less:
            say(f"For its precision {precision} pays with less {' and '.join(less)} than {f1}.", *[f"{m}.metrics.{k}" for k in less for m in (precision, f1)])
    if len({tuple(sorted(x["policy"].items())) for x in methods.values()}) > 1:
        say("The methods have policies of their own, so their queues are not compared at equal recall.", *[f"{m}.policy" for m in methods])
    for m, x in methods.items():
        if not x["calibrated"]:
            say(f"The score of {m} is not calibrated; its thresholds are not probabilities.", f"{m}.calibrated")
    return out


def why(v1: float | None, v2: float | None, policy: Policy, published_gap: float | None = None) -> dict:
    """Why a record is in its tier: the reason, and the gap with where it was taken from.

    With unrounded values the gap is theirs; a published row, rounded, has only the gap that was published with it.
    """
    if v1 is None:
        return {"tier": "reject", "reason": "no_candidate", "gap": None, "gap_from": None}
    gap, origin = (v1 - v2, "unrounded values") if v2 is not None else (published_gap, None if published_gap is None else "published row")
    base = "auto_accept" if v1 >= policy.accept_min else "review" if v1 >= policy.review_min else "reject"
    reasons = {"auto_accept": "value_at_or_above_accept_min", "review": "value_at_or_above_review_min", "reject": "value_below_review_min"}
    if base != "reject" and gap is not None and gap < policy.ambiguity_gap:
        return {"tier": "review", "reason": "ambiguity_gap_below_threshold", "gap": gap, "gap_from": origin}
    return {"tier": base, "reason": reasons[base], "gap": gap, "gap_from": origin}


def effort_minutes(queue: int, minutes_each: float) -> float:
    return queue * minutes_each
