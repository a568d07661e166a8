"""The bronze, silver and gold models over published artifacts, as functions of the frames that they need.

Each model is registered with what it reads; build() makes them in that order and names each as a temporary view.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import cases
from weftline.schemas import FOLDS, MAPPING_COLUMNS
from weftline.sources.dumps import csv_text, json_artifacts, json_variants

_D, _L, _S, _I, _B = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PRF = struct(accepted=_L, correct=_L, precision=_D, recall_labelled=_D, f1=_D)
BIN = struct(lower=_D, upper=_D, n=_I, mean_probability=_D, observed_rate=_D)
LEVEL = struct(n=_I, ece=_D, brier=_D, bins=T.ArrayType(BIN))
METRICS = struct(test_a=_L, labelled_a=_L, labelled_a_reachable=_L, pair_completeness_test=_D, at_auto_accept=PRF, at_auto_accept_or_review=PRF, recall_overall=_D, coverage=_D, coverage_all_folds=_D, unverified_accepts=struct(count=_L, share_of_accepts=_D), tier_shares=struct(auto_accept=_D, review=_D, reject=_D), ambiguity_rule=struct(decisions_moved_to_review=_L, review_queue=_L), calibration=struct(decision_level=LEVEL, pair_level=LEVEL))
FOLD = struct(a_records=_I, labelled_a_records=_I, candidate_pairs=_I, decisions=_I)
THRESHOLDS = struct(auto_accept_min=_D, review_min=_D, ambiguity_gap=_D)
EVAL = struct(method_version=_S, generated_at_utc=_S, fold_counts=struct(**dict.fromkeys(FOLDS, FOLD)), thresholds=THRESHOLDS, metrics=METRICS)
SOURCE = struct(name=_S, records=_L, sha256=_S)
MANIFEST = struct(run_id=_S, created_at_utc=_S, sources=T.ArrayType(SOURCE))
METHOD = struct(method_version=_S, feature_version=_S, thresholds=THRESHOLDS)
TRUTH_AUDIT = struct(links_raw=_L, links_distinct=_L, truth_dead=_L, truth_out_of_scope=_L, truth_unsampled=_L, truth_in_sample=_L, truth_dead_rate=_D)
CHECK = struct(name=_S, passed=_B, violations=_L)
CONTRACTS = struct(a=T.ArrayType(CHECK), b=T.ArrayType(CHECK))
BLOCKING = struct(candidate_cap_per_a=_L, union_pairs=_L, candidate_pairs_after_cap=_L, per_key_pairs=T.MapType(_S, _L), pair_completeness=struct(union=_D, after_cap=_D, per_key=T.MapType(_S, _D)))
SPLIT = struct(bounds=T.MapType(_S, T.ArrayType(_I)), folds=T.MapType(_S, struct(a_records=_L, truth_pairs=_L, candidate_pairs=_L)))
POINT = struct(threshold=_D, accepts=_L, queue_floor=_L, queue_ambiguity=_L, review_queue=_L, precision_labelled=_D, expected_false_accepts=_D, total_cost=T.MapType(_S, _D))
FLOOR = struct(floor=_D, queue_floor=_L, queue_ambiguity=_L, queue_total=_L, queue_share_of_test_a=_D, recall_with_review=_D)
SENSITIVITY = struct(methods=T.MapType(_S, struct(review_min=_D, chosen_accept_threshold=_D, points=T.ArrayType(POINT), review_floor_sweep=struct(points=T.ArrayType(FLOOR)))))
SELECTION = struct(cases=T.ArrayType(struct(case_id=_S, a_id=_S, reason_codes=T.ArrayType(_S), selection_rank=_L)))

#: Metric names and where each is in an artifact's metrics.
METRIC_PATHS = {
    "test_a": "test_a", "labelled_a": "labelled_a", "labelled_a_reachable": "labelled_a_reachable", "pair_completeness": "pair_completeness_test",
    "accepted": "at_auto_accept.accepted", "correct": "at_auto_accept.correct", "precision_auto_accept": "at_auto_accept.precision", "recall_labelled_auto_accept": "at_auto_accept.recall_labelled", "f1_auto_accept": "at_auto_accept.f1",
    "precision_auto_accept_or_review": "at_auto_accept_or_review.precision", "recall_labelled_auto_accept_or_review": "at_auto_accept_or_review.recall_labelled", "f1_auto_accept_or_review": "at_auto_accept_or_review.f1",
    "recall_overall": "recall_overall", "coverage": "coverage", "coverage_all_folds": "coverage_all_folds", "unverified_accepts": "unverified_accepts.count", "unverified_accepts_share": "unverified_accepts.share_of_accepts",
    "tier_share_auto_accept": "tier_shares.auto_accept", "tier_share_review": "tier_shares.review", "tier_share_reject": "tier_shares.reject", "ambiguity_moved_to_review": "ambiguity_rule.decisions_moved_to_review", "review_queue": "ambiguity_rule.review_queue",
    "ece": "calibration.decision_level.ece", "brier": "calibration.decision_level.brier", "ece_pair_level": "calibration.pair_level.ece", "brier_pair_level": "calibration.pair_level.brier",
}
COUNTS = ("test_a", "labelled_a", "labelled_a_reachable", "accepted", "correct", "unverified_accepts", "ambiguity_moved_to_review", "review_queue")

MODELS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}


def model(name: str, *needs: str):
    def add(f):
        MODELS[name] = (needs, f)
        return f

    return add


def artifact(name: str, pattern: str, schema: T.StructType):
    MODELS[name] = ((), lambda spark, root: json_artifacts(spark, f"{root}/{pattern}", schema))


for _name, _pattern, _schema in (("art_manifest", "manifest.json", MANIFEST), ("art_methods", "methods/*.json", METHOD), ("art_eval", "eval_*.json", EVAL), ("art_truth", "truth_audit.json", TRUTH_AUDIT), ("art_contracts", "contracts.json", CONTRACTS), ("art_blocking", "blocking_report.json", BLOCKING), ("art_split", "split.json", SPLIT), ("art_sensitivity", "review_sensitivity.json", SENSITIVITY), ("art_selection", "lab/case_selection.json", SELECTION)):
    artifact(_name, _pattern, _schema)


@model("brz_manifest", "art_manifest")
def brz_manifest(m):
    return m.select("run_id", F.to_timestamp("created_at_utc").alias("created_at_utc"), F.size("sources").alias("n_sources"))


@model("brz_manifest_sources", "art_manifest")
def brz_manifest_sources(m):
    return m.select("run_id", F.explode("sources").alias("s")).select("run_id", "s.*")


@model("brz_method_versions", "art_methods")
def brz_method_versions(m):
    return m.select("method_version", "feature_version", "thresholds.*")


@model("brz_eval_artifacts", "art_eval")
def brz_eval_artifacts(e):
    return e.select("method_version", F.to_timestamp("generated_at_utc").alias("generated_at_utc"), F.to_json("metrics").alias("metrics"), F.to_json("fold_counts").alias("fold_counts"))


@model("brz_truth_audit", "art_truth")
def brz_truth_audit(t):
    return t.drop("filename")


@model("brz_contracts", "art_contracts")
def brz_contracts(c):
    sides = [c.select(F.lit(s).alias("side"), F.explode(s).alias("k")).select("side", F.col("k.name").alias("check_name"), "k.passed", "k.violations") for s in ("a", "b")]
    return sides[0].unionByName(sides[1])


@model("brz_blocking_report", "art_blocking")
def brz_blocking_report(b):
    run = ("candidate_cap_per_a", "union_pairs", "candidate_pairs_after_cap")
    return b.select(*run, F.col("pair_completeness.union").alias("completeness_union"), F.col("pair_completeness.after_cap").alias("completeness_after_cap"), F.col("pair_completeness.per_key").alias("_pk"), F.explode("per_key_pairs").alias("block_key", "pairs")).withColumn("completeness", F.col("_pk")[F.col("block_key")]).drop("_pk")


@model("brz_split", "art_split")
def brz_split(s):
    return s.select("bounds", F.explode("folds").alias("fold", "f")).select("fold", F.element_at(F.col("bounds")[F.col("fold")], 1).alias("bucket_from"), F.element_at(F.col("bounds")[F.col("fold")], 2).alias("bucket_to"), "f.*")


@model("brz_review_sensitivity", "art_sensitivity")
def brz_review_sensitivity(s):
    points = s.select(F.explode("methods").alias("method_version", "m")).select("method_version", "m.review_min", "m.chosen_accept_threshold", F.explode("m.points").alias("p"))
    return points.select("method_version", "review_min", "chosen_accept_threshold", "p.*").select("*", F.explode("total_cost").alias("cost_ratio", "_cost")).drop("total_cost").withColumn("cost_ratio", F.col("cost_ratio").cast("int")).withColumnRenamed("_cost", "total_cost")


@model("brz_review_floor", "art_sensitivity")
def brz_review_floor(s):
    return s.select(F.explode("methods").alias("method_version", "m")).select("method_version", F.explode("m.review_floor_sweep.points").alias("p")).select("method_version", "p.*")


@model("art_mapping")
def art_mapping(spark, root):
    return csv_text(spark, f"{root}/mapping/mapping_*.test.csv.gz", list(MAPPING_COLUMNS))


@model("brz_mapping", "art_mapping")
def brz_mapping(m):
    return m.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("score", "probability", "top2_gap")}).withColumn("decided_at_utc", F.to_timestamp("decided_at_utc"))


@model("brz_lab_case_selection", "art_selection")
def brz_lab_case_selection(s):
    return s.select(F.explode("cases").alias("c")).select("c.case_id", "c.a_id", F.array_join("c.reason_codes", "|").alias("reason_codes"), "c.selection_rank")


@model("art_cases")
def art_cases(spark, root):
    return json_variants(spark, f"{root}/lab/cases.json")


@model("brz_lab_cases", "art_cases")
def brz_lab_cases(v):
    """Cases and their evidence out of a document whose rows differ from one another."""
    v.createOrReplaceTempView("_art_cases")
    get = lambda e, p, t: f"try_variant_get({e}.value, '$.{p}', '{t}')"
    return v.sparkSession.sql(f"SELECT {get('c', 'case_id', 'string')} AS case_id, {get('e', 'method_version', 'string')} AS method_version, {get('e', 'exported', 'boolean')} AS exported, {get('e', 'b_id', 'string')} AS b_id, {get('e', 'score', 'double')} AS score, {get('e', 'probability', 'double')} AS probability, {get('e', 'tier', 'string')} AS tier, {get('e', 'top2_gap', 'double')} AS top2_gap, {get('e', 'gap_state', 'string')} AS gap_state, array_join({get('e', 'block_keys', 'array<string>')}, '|') AS block_keys, {get('c', 'comparison.agreement_class', 'string')} AS agreement_class FROM _art_cases, LATERAL variant_explode(variant_get(doc, '$.cases', 'variant')) AS c, LATERAL variant_explode(variant_get(c.value, '$.evidence', 'variant')) AS e")


@model("slv_eval_folds", "art_eval")
def slv_eval_folds(e):
    return e.select("method_version", F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"fold_counts.{f}").alias("x")) for f in FOLDS])).alias("r")).select("method_version", "r.fold", "r.x.*")


@model("slv_eval_metrics", "art_eval")
def slv_eval_metrics(e):
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"metrics.{p}").cast("double").alias("value")) for n, p in METRIC_PATHS.items()])
    return e.filter("metrics is not null").select("method_version", F.lit("test").alias("fold"), F.explode(rows).alias("r")).select("method_version", "fold", "r.metric", "r.value")


@model("slv_calibration", "art_eval")
def slv_calibration(e):
    levels = F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"metrics.calibration.{x}").alias("x")) for x in ("decision_level", "pair_level")])
    out = e.filter("metrics is not null").select("method_version", F.explode(levels).alias("l")).select("method_version", "l.level", F.col("l.x.n").alias("n_total"), "l.x.ece", "l.x.brier", F.posexplode("l.x.bins").alias("bin_index", "b"))
    return out.select("method_version", "level", "bin_index", F.col("b.lower").alias("lower_bound"), F.col("b.upper").alias("upper_bound"), "b.n", "b.mean_probability", "b.observed_rate", "n_total", "ece", "brier")


@model("slv_mapping", "brz_mapping")
def slv_mapping(m):
    """One row for each A record and method: the highest probability, then the smallest B id."""
    rest = [c for c in MAPPING_COLUMNS if c not in ("a_id", "method_version")]
    from pyspark.sql import Window

    order = Window.partitionBy("a_id", "method_version").orderBy(F.desc("probability"), "b_id")
    return m.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("a_id", "method_version", *rest)


@model("slv_tier_thresholds", "brz_method_versions")
def slv_tier_thresholds(m):
    return m.select("method_version", "auto_accept_min", "review_min", "ambiguity_gap")


@model("dim_source", "brz_manifest_sources")
def dim_source(s):
    return s.select(F.col("name").alias("source"), "records", "sha256")


@model("dim_method_version", "brz_method_versions")
def dim_method_version(m):
    return m.select("method_version", "feature_version", "auto_accept_min", "review_min", "ambiguity_gap")


@model("fct_mapping", "slv_mapping")
def fct_mapping(m):
    return m


@model("fct_blocking", "brz_blocking_report")
def fct_blocking(b):
    return b


@model("fct_calibration", "slv_calibration")
def fct_calibration(c):
    return c


@model("fct_review_floor", "brz_review_floor")
def fct_review_floor(f):
    return f


@model("fct_eval_metrics", "slv_eval_metrics")
def fct_eval_metrics(long):
    wide = long.groupBy("method_version").pivot("metric", list(METRIC_PATHS)).agg(F.max("value"))
    return wide.select("method_version", *[F.col(m).cast("long" if m in COUNTS else "double").alias(m) for m in METRIC_PATHS], F.lit("test").alias("fold"))


@model("fct_review_queue", "brz_review_sensitivity")
def fct_review_queue(s):
    return s.withColumns({"total_cost_recomputed": F.col("review_queue") + F.col("expected_false_accepts") * F.col("cost_ratio"), "is_chosen": F.col("threshold") == F.col("chosen_accept_threshold")})


@model("fct_lab_case_evidence", "brz_lab_case_selection", "dim_method_version", "fct_mapping")
def fct_lab_case_evidence(selection, methods, mapping):
    points = methods.select("method_version", F.col("auto_accept_min").alias("accept_min"), "review_min", "ambiguity_gap")
    return cases.evidence(selection, points, mapping)


@model("fct_lab_case_comparison", "fct_lab_case_evidence")
def fct_lab_case_comparison(e):
    return cases.comparison(e)


def build(spark: SparkSession, root: str, only: tuple[str, ...] = (), given: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every model over the artifacts under root, each after what it needs, named as a temporary view. Missing artifacts
    are empty relations; given frames stand for artifacts."""
    made: dict[str, DataFrame] = {}

    def make(name: str) -> DataFrame:
        if name not in made:
            needs, f = MODELS[name]
            made[name] = given[name] if given is not None and name.startswith("art_") else f(*[make(n) for n in needs]) if needs else f(spark, root)
            if not name.startswith("art_"):
                made[name].createOrReplaceTempView(name)
        return made[name]

    for name in only or MODELS:
        make(name)
    return made


#: Layers by the prefix of their models; a layer's name is its schema's, without anything before it.
LAYERS = {"brz": "bronze", "slv": "silver", "dim": "gold", "fct": "gold"}


def layer(name: str) -> str:
    """The schema of a model; artifacts have none."""
    return LAYERS[name.partition("_")[0]]


def materialise(spark: SparkSession, made: dict[str, DataFrame]) -> list[str]:
    """Write models as tables bronze.*, silver.* and gold.* of the session's catalogue; their full names."""
    written = []
    for name, df in made.items():
        if not name.startswith("art_"):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer(name)}")
            df.write.mode("overwrite").saveAsTable(f"{layer(name)}.{name}")
            written.append(f"{layer(name)}.{name}")
    return written
