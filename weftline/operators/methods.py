"""The three matching methods and how they are fitted."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.hashing import index_hash
from weftline.operators import boosting
from weftline.schemas import PAIR_FEATURES
from weftline.session import stored

# Fixed values of the rules method and of the gates.
TITLE_WEIGHT, ARTIST_WEIGHT, YEAR_WEIGHT = 0.45, 0.35, 0.20
LEAST_PRECISION = 0.50
F1_LEAD, PRECISION_GATE, ACCEPTS_GATE = 0.15, 0.995, 1000
#: Slices of the scores' range that a curve is summed up in.
SLICES = 4096
#: Labelled pairs that a task of the training reads at least, where there are so many.
TASK_ROWS = 20_000


def exact_score() -> Column:
    """1 if titles and full credits are equal and years do not differ."""
    return F.when((F.col("title_exact_norm") == 1) & (F.col("artist_full_exact") == 1) & (F.coalesce("year_diff", F.lit(0)) == 0), 1.0).otherwise(0.0)


def year_agreement() -> Column:
    return F.when(F.col("year_diff").isNull(), 0.25).when(F.col("year_diff") == 0, 1.0).when(F.col("year_diff") == 1, 0.5).otherwise(0.0)


def rules_score(title: str = "title_token_set", artist: str = "artist_token_set") -> Column:
    """The weighted sum, added up in this order."""
    return F.lit(TITLE_WEIGHT) * F.col(title) + F.lit(ARTIST_WEIGHT) * F.col(artist) + F.lit(YEAR_WEIGHT) * year_agreement()


def scored(features: DataFrame, score: Column) -> DataFrame:
    """(a_id, b_id, fold, block_keys, score, probability) where the score is the probability."""
    kept = [c for c in ("a_id", "b_id", "fold", "block_keys") if c in features.columns]
    return features.select(*kept, score.alias("score")).withColumn("probability", F.col("score"))


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Add label: 1 for a truth pair, 0 for another pair of a labelled A record, null for an unlabelled one."""
    links = truth.select("a_id", "b_id").distinct().withColumn("_hit", F.lit(True))
    labelled = truth.select("a_id").distinct().withColumn("_lab", F.lit(True))
    out = pairs.join(links, ["a_id", "b_id"], "left").join(labelled, "a_id", "left")
    return out.withColumn("label", F.when(F.col("_hit"), 1).when(F.col("_lab"), 0)).drop("_hit", "_lab")


def threshold_curve(decisions: DataFrame, recall_base: int) -> DataFrame:
    """(score, n, right, precision, recall, f1) at each different score, from the highest down.

    Decisions are counted by score first. Scores of a learned method are nearly all different, so the running sums are taken
    in two steps: inside slices of the scores' range, and over the slices' totals, of which there are SLICES at most; no
    task holds more than a slice.
    """
    by_score = decisions.groupBy("score").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("correct")).alias("_right"))
    # scores are shares; what is not falls into the first slice or the last
    sliced = by_score.withColumn("_s", F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * (SLICES - 1)).cast("int"))
    above = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("_s").agg(F.sum("_n").alias("n"), F.sum("_right").alias("r"))
    before = totals.select("_s", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n_above"), F.coalesce(F.sum("r").over(above), F.lit(0)).alias("_r_above"))
    down = Window.partitionBy("_s").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sliced.join(F.broadcast(before), "_s").select("score", (F.sum("_n").over(down) + F.col("_n_above")).alias("n"), (F.sum("_right").over(down) + F.col("_r_above")).alias("right"))
    p, r = F.col("right") / F.col("n"), F.col("right") / F.lit(float(max(recall_base, 1)))
    return run.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def fit_thresholds(decisions: DataFrame, recall_base: int) -> tuple[float, float]:
    """(accept, review): the score of best F1, ties to the higher one; the first score whose precision is under one half,
    else the lowest, and never above accept."""
    curve = threshold_curve(decisions, recall_base)
    got = curve.agg(F.max_by("score", F.struct("f1", "score")).alias("accept"), F.max(F.when(F.col("precision") < LEAST_PRECISION, F.col("score"))).alias("low"), F.min("score").alias("least")).first()
    if got["accept"] is None:
        raise ValueError("no decisions to fit thresholds on")
    review = got["least"] if got["low"] is None else got["low"]
    return got["accept"], min(review, got["accept"])


@dataclass
class Learned:
    """Boosted trees, calibrated."""

    trees: boosting.Trees
    calibration: object
    record: dict = field(default_factory=dict)

    def score(self, features: DataFrame) -> DataFrame:
        raw = features.withColumn("score", self.trees.score(design()))
        calibrated = self.calibration.transform(raw.withColumn("features", F.col("score")).withColumn("features", _vector("features")))
        return calibrated.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction", "features")


def _vector(column: str):
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(column))


def design() -> list[Column]:
    """The columns that trees are grown on. A missing year difference is -1 beside its own flag."""
    return [*(F.col(f) for f in PAIR_FEATURES if f != "year_diff"), F.coalesce("year_diff", F.lit(-1))]


def fit_learned(features: DataFrame, truth: DataFrame, trees: int = 30, depth: int = 5, rate: float = 0.1, least_leaf: int = 50, seed: int = 0) -> Learned:
    """Trees on the labelled fit-fold pairs with balanced weights, isotonic calibration on the calibrate fold.

    The labelled pairs of the two folds are made once and cut off, as they are read several times and the plan of the features is
    large. They are read in tasks of TASK_ROWS rows at least, as the driver keeps a record of every task.
    """
    used = features.filter(F.col("fold").isin("fit", "calibrate")).join(truth.select("a_id").distinct(), "a_id", "left_semi")
    labelled = stored(with_labels(used, truth).filter("label is not null").select("a_id", "b_id", "fold", "label", *PAIR_FEATURES))
    counts = {(r["fold"], r["label"]): r["n"] for r in labelled.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labelled = labelled.coalesce(max(1, math.ceil(sum(counts.values()) / TASK_ROWS)))
    fit, held = labelled.filter("fold = 'fit'"), labelled.filter("fold = 'calibrate'")
    sizes = {label: n for (fold, label), n in counts.items() if fold == "fit"}
    if len(sizes) < 2:
        raise ValueError("the fit fold needs pairs of both labels")
    total = sum(sizes.values())
    with ThreadPoolExecutor(1) as beside:  # trees may be grown by one task, so other work is done meanwhile
        hashes = beside.submit(lambda: {"fit_index_sha256": index_hash(fit), "calibrate_index_sha256": index_hash(held)})
        model = boosting.fit(fit, design(), (total / (2 * sizes[0]), total / (2 * sizes[1])), trees, depth, rate, least_leaf)
    raw = held.select(model.score(design()).alias("score"), F.col("label").cast("double").alias("label"))
    base = raw.withColumn("features", _vector("score"))
    calibration = IsotonicRegression(labelCol="label", featuresCol="features").fit(base)
    counts = {"trained_on": total, "positive": sizes[1], "calibrated_on": sum(n for (fold, _), n in counts.items() if fold == "calibrate")}
    return Learned(model, calibration, {"trees": trees, "depth": depth, "rate": rate, "least_leaf": least_leaf, "seed": seed, "features": list(PAIR_FEATURES)} | counts | hashes.result())


class TooGood(RuntimeError):
    """Results that must be explained before anything is published."""

    exit_code = 4


def stop_if_too_good(metrics: dict[str, dict]) -> None:
    """The gate of the build: too_good() results stop it."""
    if found := too_good(metrics):
        raise TooGood("; ".join(found))


def too_good(metrics: dict[str, dict]) -> list[str]:
    """Results that are suspicious: a large lead of the learned method, or near-perfect precision on many accepts."""
    found = []
    learned, rules = metrics.get("learned_v1"), metrics.get("rules_v1")
    if learned and rules and None not in (learned["f1"], rules["f1"]) and learned["f1"] - rules["f1"] > F1_LEAD:
        found.append("learned_v1 leads rules_v1 by more than allowed")
    found += [f"{m}: precision {x['precision']} on {x['accepted']} accepts" for m, x in metrics.items() if m != "exact_v1" and x["precision"] is not None and x["precision"] >= PRECISION_GATE and x["accepted"] > ACCEPTS_GATE]
    return found
