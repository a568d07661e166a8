"""One decision for each A record, and policies replayed over frozen decision values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the decision rule.
GAP, ACCEPT, REVIEW = 0.10, 0.95, 0.50


class PolicyError(ValueError):
    """A policy whose numbers do not make sense."""


@dataclass(frozen=True)
class Policy:
    accept_min: float = ACCEPT
    review_min: float = REVIEW
    ambiguity_gap: float = GAP

    def __post_init__(self):
        for name in ("accept_min", "review_min", "ambiguity_gap"):
            x = getattr(self, name)
            if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
                raise PolicyError(f"{name} must be a finite number, got {x!r}")
        if not (0 <= self.review_min <= self.accept_min <= 1 and 0 <= self.ambiguity_gap <= 1):
            raise PolicyError(f"0 <= review_min <= accept_min <= 1 and a gap in [0, 1] are needed, got {self}")


def top_two(pairs: DataFrame, carry: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a_id, b_id, v1, v2, carried columns of the best): value descending, ties to the smaller B id as text. by: columns
    whose values have their best each.

    An aggregation with the two best rows as its state would need a function of its own; the ranked window is limited to
    two rows for each A record before the shuffle, and the best row carries the second's value by lead().
    """
    order = Window.partitionBy(*by, "a_id").orderBy(F.desc("probability"), "b_id")
    ranked = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= 2)
    best = ranked.withColumn("v2", F.lead("probability").over(order)).filter(F.col("_n") == 1)
    return best.select(*by, "a_id", "b_id", F.col("probability").alias("v1"), "v2", *carry)


def base_tier(v: Column, accept: Column, review: Column) -> Column:
    return F.when(v >= accept, "auto_accept").when(v >= review, "review").otherwise("reject")


def decision_columns(accept: Column, review: Column, gap: Column) -> dict[str, Column]:
    """tier, reason, gap, ambiguous and demoted from v1 and v2; without a candidate v1 is null. The gap test is strict
    and made on unrounded values."""
    v1, apart = F.col("v1"), F.col("v1") - F.col("v2")
    base = base_tier(v1, accept, review)
    unclear = F.coalesce((base != "reject") & (apart < gap), F.lit(False)) & v1.isNotNull()
    reason = F.when(v1.isNull(), "no_candidate").when(unclear, "ambiguity_gap_below_threshold").when(v1 >= accept, "value_at_or_above_accept_min").when(v1 >= review, "value_at_or_above_review_min").otherwise("value_below_review_min")
    return {"tier": F.when(v1.isNull(), "reject").when(unclear, "review").otherwise(base), "reason": reason, "gap": apart, "ambiguous": unclear, "demoted": unclear & F.coalesce(v1 >= accept, F.lit(False))}


def decide(pairs: DataFrame, policy: Policy = Policy(), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a_id, b_id, score, probability, tier, fold, top2_gap, ambiguity_review, block_keys) from scored pairs."""
    carry = tuple(c for c in ("score", "fold", "block_keys") if c in pairs.columns)
    made = decision_columns(F.lit(policy.accept_min), F.lit(policy.review_min), F.lit(policy.ambiguity_gap))
    return top_two(pairs, carry, by).withColumns(made).select(*by, "a_id", "b_id", *carry, F.col("v1").alias("probability"), "tier", F.col("gap").alias("top2_gap"), F.col("demoted").alias("ambiguity_review"))


def tier_of(p: Column, policy: Policy = Policy()) -> Column:
    """The tier of a probability; one outside [0, 1] is an error."""
    return F.when(p.between(0, 1), base_tier(p, F.lit(policy.accept_min), F.lit(policy.review_min))).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), F.coalesce(p.cast("string"), F.lit("null")))))


def mapping(decisions: DataFrame, method: str, feature_version: str, run_id: str, decided_at: str) -> DataFrame:
    """What is published: non-reject decisions, values to six places, keys joined."""
    from weftline.functions.rounding import round6

    kept = decisions.filter("tier <> 'reject'")
    return kept.select("a_id", "b_id", F.lit(method).alias("method_version"), F.lit(feature_version).alias("feature_version"), round6("score").alias("score"), round6("probability").alias("probability"), "tier", F.array_join("block_keys", "|").alias("block_keys"), round6("top2_gap").alias("top2_gap"), "fold", F.lit(run_id).alias("run_id"), F.lit(decided_at).alias("decided_at_utc"))


def replay_rows(pairs: DataFrame, population: DataFrame, truth: DataFrame) -> DataFrame:
    """(a_id, b_id, v1, v2, n_candidates, labelled, top1_correct, truth_reachable), one row for each A record of the
    population (a_id), also those without candidates."""
    links = truth.select("a_id", "b_id").distinct().withColumn("_hit", F.lit(1))
    marked = pairs.select("a_id", "b_id", "probability").join(links, ["a_id", "b_id"], "left")
    facts = marked.groupBy("a_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("_hit").alias("reach"))
    best = top_two(marked, ("_hit",))
    labelled = truth.select("a_id").distinct().withColumn("_lab", F.lit(True))
    out = population.select("a_id").join(best, "a_id", "left").join(facts, "a_id", "left").join(labelled, "a_id", "left").withColumn("labelled", F.coalesce("_lab", F.lit(False)))
    return out.select("a_id", "b_id", "v1", "v2", F.coalesce("n", F.lit(0)).alias("n_candidates"), "labelled", F.when(F.col("labelled") & F.col("v1").isNotNull(), F.col("_hit").isNotNull()).alias("top1_correct"), F.when(F.col("labelled"), F.coalesce(F.col("reach") == 1, F.lit(False))).alias("truth_reachable"))


def bad_replay_rows(rows: DataFrame) -> DataFrame:
    """(problem, n): rows that contradict themselves."""
    v1, v2, n, labelled = F.col("v1"), F.col("v2"), F.col("n_candidates"), F.col("labelled")
    finite = lambda v: v.isNull() | (~F.isnan(v) & (F.abs(v) != float("inf")))
    rules = {
        "a negative number of candidates": n < 0,
        "v1 without candidates, or candidates without v1": v1.isNull() != (n == 0),
        "v2 with fewer than two candidates": v2.isNotNull() & (n < 2),
        "no v2 with two candidates or more": v2.isNull() & (n >= 2),
        "a value that is not finite": ~(finite(v1) & finite(v2)),
        "v2 above v1": v2 > v1,
        "an unlabelled row with correctness or reachability": ~labelled & (F.col("top1_correct").isNotNull() | F.col("truth_reachable").isNotNull()),
        "a labelled row without reachability": labelled & F.col("truth_reachable").isNull(),
        "a labelled row with a candidate and no correctness": labelled & v1.isNotNull() & F.col("top1_correct").isNull(),
        "correctness without a candidate": v1.isNull() & F.col("top1_correct").isNotNull(),
    }
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("problem"), F.col(f"c{i}").alias("n")) for i, p in enumerate(rules)])).alias("r")).select("r.*").filter("n > 0")


#: Counts of one policy's replay; rates follow from them on the driver.
COUNTS = ("test_a", "labelled_a", "labelled_a_reachable", "no_candidate_a", "accepted", "correct", "queued_labelled", "queued_reachable", "accepted_all", "review_all", "rejected_all", "unverified", "demoted", "ambiguous")


def replay(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Counts for each policy (policy_id, accept_min, review_min, ambiguity_gap).

    policies is a literal table of a sweep's points. Rows with equal values and flags behave alike under every policy, so
    they are counted first; the few policies then meet the counted rows as a broadcast side, in one aggregation.
    """
    keys = ("v1", "v2", "labelled", "top1_correct", "truth_reachable")
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"))
    met = counted.crossJoin(F.broadcast(policies)).withColumns(decision_columns(F.col("accept_min"), F.col("review_min"), F.col("ambiguity_gap")))
    w, lab = F.col("w"), F.col("labelled")
    accept, review = F.col("tier") == "auto_accept", F.col("tier") == "review"
    right, reach = F.coalesce("top1_correct", F.lit(False)), F.coalesce("truth_reachable", F.lit(False))
    when = {"test_a": F.lit(True), "labelled_a": lab, "labelled_a_reachable": lab & reach, "no_candidate_a": F.col("v1").isNull(), "accepted": accept & lab, "correct": accept & lab & right, "queued_labelled": review & lab, "queued_reachable": review & lab & reach, "accepted_all": accept, "review_all": review, "rejected_all": F.col("tier") == "reject", "unverified": accept & ~lab, "demoted": F.col("demoted"), "ambiguous": F.col("ambiguous")}
    return met.groupBy("policy_id", "accept_min", "review_min", "ambiguity_gap").agg(*[F.sum(F.when(c, w).otherwise(0)).alias(name) for name, c in when.items()])


def policy_table(spark, policies: list[Policy]) -> DataFrame:
    return spark.createDataFrame([(i, float(p.accept_min), float(p.review_min), float(p.ambiguity_gap)) for i, p in enumerate(policies)], "policy_id int, accept_min double, review_min double, ambiguity_gap double")


def legacy_sweep(rows: DataFrame, baseline: Policy, thresholds: list[float]) -> DataFrame:
    """(threshold, accepts, queue_floor, queue_ambiguity, review_queue, labelled_accepts, correct) with the baseline's demotions
    at every threshold."""
    keys = ("v1", "demoted", "labelled", "top1_correct")
    flagged = rows.filter("v1 is not null").withColumns(decision_columns(F.lit(baseline.accept_min), F.lit(baseline.review_min), F.lit(baseline.ambiguity_gap))).groupBy(*keys).agg(F.count(F.lit(1)).alias("w"))
    points = rows.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    v, t, w, lab = F.col("v1"), F.col("threshold"), F.col("w"), F.col("labelled")
    accept = (v >= t) & ~F.col("demoted")
    total = lambda c: F.sum(F.when(c, w).otherwise(0))
    out = flagged.crossJoin(F.broadcast(points)).groupBy("threshold").agg(total(accept).alias("accepts"), total((v >= baseline.review_min) & (v < t)).alias("queue_floor"), total((v >= t) & F.col("demoted")).alias("queue_ambiguity"), total(accept & lab).alias("labelled_accepts"), total(accept & lab & F.coalesce("top1_correct", F.lit(False))).alias("correct"))
    return out.withColumn("review_queue", F.col("queue_floor") + F.col("queue_ambiguity"))
