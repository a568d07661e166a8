"""Registered queries over the warehouse's models, on artifacts that are made from the small tables.

The artifacts are nested as published ones are; each query is a model of plans/warehouse.py as it is, and its SQL computes the
model's rows straight from the tables, without the nesting. What goes into an artifact is stated once, as expressions that
both engines read (FACTS, METRICS); what is tested is how the models take it out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import warehouse as W
from weftline.schemas import FOLDS, MAPPING_COLUMNS
from weftline.sources.catalogue import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A method for each region, with numbers of its customers.
FACTS = "SELECT r_name AS method_version, CAST(r_regionkey AS BIGINT) AS k, count(*) AS n, count(CASE WHEN c_acctbal > 5000 THEN 1 END) AS acc, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS neg FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, r_regionkey"
METRICS = {
    "test_a": "n",
    "labelled_a": "n - neg",
    "labelled_a_reachable": "acc + neg",
    "pair_completeness": "CAST(acc + neg AS DOUBLE) / n",
    "accepted": "acc",
    "correct": "acc - k",
    "precision_auto_accept": "CAST(acc - k AS DOUBLE) / acc",
    "recall_labelled_auto_accept": "CAST(acc - k AS DOUBLE) / n",
    "f1_auto_accept": "CASE WHEN k <> 2 THEN CAST(k AS DOUBLE) / 8 END",
    "precision_auto_accept_or_review": "CAST(acc AS DOUBLE) / (n + k)",
    "recall_labelled_auto_accept_or_review": "CAST(acc AS DOUBLE) / (2 * n)",
    "f1_auto_accept_or_review": "CAST(k + 1 AS DOUBLE) / 16",
    "recall_overall": "CAST(neg AS DOUBLE) / n",
    "coverage": "CAST(acc AS DOUBLE) / n",
    "coverage_all_folds": "CAST(acc + 1 AS DOUBLE) / (n + 2)",
    "unverified_accepts": "neg",
    "unverified_accepts_share": "CAST(neg AS DOUBLE) / acc",
    "tier_share_auto_accept": "CAST(acc AS DOUBLE) / n",
    "tier_share_review": "CAST(neg AS DOUBLE) / n",
    "tier_share_reject": "CAST(n - acc - neg AS DOUBLE) / n",
    "ambiguity_moved_to_review": "k",
    "review_queue": "neg + k",
    "ece": "CAST(k AS DOUBLE) / 64",
    "brier": "CAST(k AS DOUBLE) / 128",
    "ece_pair_level": "CAST(k AS DOUBLE) / 256",
    "brier_pair_level": "CAST(k AS DOUBLE) / 512",
}
THRESHOLDS = {"auto_accept_min": "CAST(60 + k AS DOUBLE) / 64", "review_min": "CAST(32 + k AS DOUBLE) / 64", "ambiguity_gap": "CAST(4 + k AS DOUBLE) / 64"}
BIN = {"lower": "CAST(i AS DOUBLE) / 16", "upper": "CAST(i + 1 AS DOUBLE) / 16", "n": "CAST(i + k AS INTEGER)", "mean_probability": "CAST(2 * i + 1 AS DOUBLE) / 32", "observed_rate": "CASE WHEN i % 3 <> 0 THEN CAST(i + k AS DOUBLE) / 64 END"}
POINT = {"threshold": "CAST(32 + n_nationkey AS DOUBLE) / 64", "accepts": "acc - n_nationkey", "queue_floor": "CAST(n_nationkey AS BIGINT)", "queue_ambiguity": "k", "review_queue": "CAST(n_nationkey AS BIGINT) + k", "precision_labelled": "CASE WHEN n_nationkey % 4 <> 3 THEN CAST(n_nationkey AS DOUBLE) / 32 END", "expected_false_accepts": "CASE WHEN n_nationkey % 4 <> 3 THEN CAST(n_nationkey AS DOUBLE) / 8 END"}
FLOOR = {"floor": "CAST(n_nationkey AS DOUBLE) / 32", "queue_floor": "CAST(n_nationkey AS BIGINT)", "queue_ambiguity": "k", "queue_total": "CAST(n_nationkey AS BIGINT) + k", "queue_share_of_test_a": "CAST(n_nationkey + k AS DOUBLE) / n", "recall_with_review": "CAST(n_nationkey AS DOUBLE) / 64"}
RATIOS = (1, 5, 20)
FOLD_PARTS = {"a_records": "CAST(n + {i} AS INTEGER)", "labelled_a_records": "CAST(acc + {i} AS INTEGER)", "candidate_pairs": "CAST(neg * {i} AS INTEGER)", "decisions": "CAST(k + {i} AS INTEGER)"}


def as_struct(kind, values: dict[str, str], prefix: str = "") -> str:
    """A Spark expression for a struct of that type; values: expression by dotted path."""
    parts = []
    for f in kind.fields:
        path = f"{prefix}{f.name}"
        inner = as_struct(f.dataType, values, f"{path}.") if f.dataType.typeName() == "struct" else f"CAST({values.get(path, 'NULL')} AS {f.dataType.simpleString()})"
        parts.append(f"'{f.name}', {inner}")
    return f"named_struct({', '.join(parts)})"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("region", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    return spark.sql(FACTS.replace("FROM region", "FROM _region region").replace("JOIN nation", "JOIN _nation nation").replace("JOIN customer", "JOIN _customer customer"))


def art_eval(spark, sf_dir):
    bins = f"transform(sequence(0, 9), i -> named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {e}' for c, e in BIN.items())}))"
    values = {W.METRIC_PATHS[m]: e for m, e in METRICS.items()}
    for level in ("decision_level", "pair_level"):
        values |= {f"calibration.{level}.bins": bins, f"calibration.{level}.n": "n"}
    folds = ", ".join(f"'{f}', named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, ' + e.format(i=i) for c, e in FOLD_PARTS.items())})" for i, f in enumerate(FOLDS))
    return facts(spark, sf_dir).select("method_version", F.lit("2026-01-02T03:04:05Z").alias("generated_at_utc"), F.expr(f"named_struct({folds})").alias("fold_counts"), F.expr(as_struct(W.THRESHOLDS, THRESHOLDS)).alias("thresholds"), F.expr(as_struct(W.METRICS, values)).alias("metrics"))


def art_manifest(spark, sf_dir):
    held = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return held.groupBy(F.col("r_name").alias("run_id"), F.concat(F.lit("2026-01-0"), (F.col("r_regionkey") + 1).cast("string"), F.lit("T00:00:00Z")).alias("created_at_utc")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("records"), F.sha2("n_name", 256).alias("sha256"))).alias("sources"))


def art_methods(spark, sf_dir):
    return facts(spark, sf_dir).select("method_version", F.lit("f1").alias("feature_version"), F.expr(as_struct(W.THRESHOLDS, THRESHOLDS)).alias("thresholds"))


def art_contracts(spark, sf_dir):
    check = F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("passed"), F.col("n_nationkey").cast("long").alias("violations"))
    return table(spark, sf_dir, "nation").agg(*[F.collect_list(F.when((F.col("n_regionkey") < 2) == (s == "a"), check)).alias(s) for s in ("a", "b")])


def art_truth(spark, sf_dir):
    return facts(spark, sf_dir).select(F.col("n").alias("links_raw"), (F.col("n") - F.col("k")).alias("links_distinct"), F.col("neg").alias("truth_dead"), F.col("acc").alias("truth_out_of_scope"), F.col("k").alias("truth_unsampled"), (F.col("n") - F.col("acc")).alias("truth_in_sample"), (F.col("neg") / F.col("n")).alias("truth_dead_rate"), F.lit("file").alias("filename"))


def art_blocking(spark, sf_dir):
    entry = lambda value: F.struct(F.col("n_name"), value)
    held = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(entry(F.col("n_nationkey").cast("long")))).alias("per_key_pairs"), F.map_from_entries(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, entry(F.col("n_nationkey") / 32)))).alias("_pk"))
    return held.select(F.lit(200).cast("long").alias("candidate_cap_per_a"), F.lit(9000).cast("long").alias("union_pairs"), F.lit(8000).cast("long").alias("candidate_pairs_after_cap"), "per_key_pairs", F.struct(F.lit(0.75).alias("union"), F.lit(0.5).alias("after_cap"), F.col("_pk").alias("per_key")).alias("pair_completeness"))


def art_split(spark, sf_dir):
    fold = lambda a: F.struct(F.col(a).alias("a_records"), F.col("neg").alias("truth_pairs"), F.col("k").alias("candidate_pairs"))
    one = facts(spark, sf_dir).filter("k = 1")
    bounds = F.create_map(*[x for i, f in enumerate(FOLDS) for x in (F.lit(f), F.array(F.lit(20 * i), F.lit(20 * i + 20)))])
    return one.select(bounds.alias("bounds"), F.create_map(F.lit("fit"), fold("n"), F.lit("test"), fold("acc")).alias("folds"))


def art_sensitivity(spark, sf_dir):
    named = lambda parts: ", ".join(f"'{c}', {e}" for c, e in parts.items())
    cost = ", ".join(f"'{r}', CAST(n_nationkey + {r} AS DOUBLE)" for r in RATIOS)
    points = facts(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_regionkey"))
    per = points.groupBy("method_version", "k").agg(F.collect_list(F.expr(f"named_struct({named(POINT)}, 'total_cost', map({cost}))")).alias("points"), F.collect_list(F.expr(f"named_struct({named(FLOOR)})")).alias("floors"))
    method = F.struct(F.expr(THRESHOLDS["review_min"]).alias("review_min"), F.expr("CAST(32 + k AS DOUBLE) / 64").alias("chosen_accept_threshold"), F.col("points"), F.struct(F.col("floors").alias("points")).alias("review_floor_sweep"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("method_version", method.alias("m")))).alias("methods"))


def art_mapping(spark, sf_dir):
    """Text columns, as a CSV gives them, with repeated keys."""
    values = {"a_id": "CAST(l_orderkey AS STRING)", "b_id": "CAST(l_partkey AS STRING)", "method_version": "element_at(array('AFRICA', 'AMERICA', 'ASIA'), CAST(l_linenumber % 3 + 1 AS INT))", "feature_version": "'f1'", "score": "CAST(l_discount AS STRING)", "probability": "CAST(l_discount AS STRING)", "tier": "CASE WHEN l_discount >= 0.05D THEN 'auto_accept' ELSE 'review' END", "block_keys": "'k_title3'", "top2_gap": "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS STRING) END", "fold": "'test'", "run_id": "'r'", "decided_at_utc": "'2026-01-02T03:04:05Z'"}
    return table(spark, sf_dir, "lineitem").filter("l_orderkey <= 2000").select(*[F.expr(values[c]).alias(c) for c in MAPPING_COLUMNS])


def art_selection(spark, sf_dir):
    case = F.struct(F.concat(F.lit("c"), "n_nationkey").alias("case_id"), (F.col("n_nationkey") * 8 + 1).cast("string").alias("a_id"), F.array("n_name", F.concat(F.lit("r"), "n_regionkey")).alias("reason_codes"), F.col("n_nationkey").cast("long").alias("selection_rank"))
    return table(spark, sf_dir, "nation").agg(F.collect_list(case).alias("cases"))


def art_cases(spark, sf_dir):
    """One document whose evidence rows differ in the fields that they have."""
    n = F.col("n_nationkey")
    exported = F.to_json(F.struct(F.lit("AFRICA").alias("method_version"), F.lit(True).alias("exported"), n.cast("string").alias("b_id"), (n / 32).alias("score"), (n / 64).alias("probability"), F.lit("review").alias("tier"), F.lit("exported").alias("gap_state"), (n / 128).alias("top2_gap"), F.array(F.lit("k1"), F.col("n_name")).alias("block_keys")))
    absent = F.lit('{"method_version":"ASIA","exported":false,"reason":"rejected"}')
    case = F.concat(F.lit('{"case_id":"c'), n.cast("string"), F.lit('","comparison":{"agreement_class":"single_method_exported"},"evidence":['), exported, F.lit(","), absent, F.lit("]}"))
    doc = F.concat(F.lit('{"cases":['), F.array_join(F.collect_list(case), ","), F.lit("]}"))
    return table(spark, sf_dir, "nation").agg(doc.alias("d")).select(F.lit("file").alias("filename"), F.parse_json("d").alias("doc"))


ARTIFACTS = {f.__name__: f for f in (art_eval, art_manifest, art_methods, art_contracts, art_truth, art_blocking, art_split, art_sensitivity, art_mapping, art_selection, art_cases)}


def mart(model: str, sql: str, *columns: str) -> None:
    """Register the model as a query, of these columns (timestamps as text)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        class Given(dict):  # artifacts are made when a model asks for them
            def __missing__(self, name):
                if name not in ARTIFACTS:
                    raise KeyError(name)
                self[name] = ARTIFACTS[name](spark, sf_dir)
                return self[name]

        out = W.build(spark, sf_dir, (model,), Given())[model]
        return out.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if out.schema[c].dataType.typeName() == "timestamp" else F.col(c) for c in columns])

    QUERIES[f"mart_{model}"] = run
    ORACLES[f"mart_{model}"] = sql


M = f"m AS ({FACTS})"
listed = lambda parts: ", ".join(f"{e} AS {c}" for c, e in parts.items())
mart("brz_manifest", "SELECT r_name AS run_id, '2026-01-0' || (r_regionkey + 1) || ' 00:00:00' AS created_at_utc, CAST(count(*) AS INTEGER) AS n_sources FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey", "run_id", "created_at_utc", "n_sources")
mart("brz_manifest_sources", "SELECT r_name AS run_id, n_name AS name, CAST(n_nationkey AS BIGINT) AS records, sha256(n_name) AS sha256 FROM nation JOIN region ON n_regionkey = r_regionkey", "run_id", "name", "records", "sha256")
mart("dim_source", "SELECT n_name AS source, CAST(n_nationkey AS BIGINT) AS records, sha256(n_name) AS sha256 FROM nation", "source", "records", "sha256")
POINTS = f"WITH {M} SELECT method_version, 'f1' AS feature_version, {listed(THRESHOLDS)} FROM m"
mart("brz_method_versions", POINTS, "method_version", "feature_version", *THRESHOLDS)
mart("dim_method_version", POINTS, "method_version", "feature_version", *THRESHOLDS)
mart("slv_tier_thresholds", POINTS.replace("'f1' AS feature_version, ", ""), "method_version", *THRESHOLDS)
mart("brz_eval_artifacts", f"WITH {M} SELECT method_version, '2026-01-02 03:04:05' AS generated_at_utc FROM m", "method_version", "generated_at_utc")
mart("brz_contracts", "SELECT CASE WHEN n_regionkey < 2 THEN 'a' ELSE 'b' END AS side, n_name AS check_name, n_nationkey % 2 = 0 AS passed, CAST(n_nationkey AS BIGINT) AS violations FROM nation", "side", "check_name", "passed", "violations")
mart("brz_truth_audit", f"WITH {M} SELECT n AS links_raw, n - k AS links_distinct, neg AS truth_dead, acc AS truth_out_of_scope, k AS truth_unsampled, n - acc AS truth_in_sample, CAST(neg AS DOUBLE) / n AS truth_dead_rate FROM m", "links_raw", "links_distinct", "truth_dead", "truth_out_of_scope", "truth_unsampled", "truth_in_sample", "truth_dead_rate")
BLOCKED = "SELECT CAST(200 AS BIGINT) AS candidate_cap_per_a, CAST(9000 AS BIGINT) AS union_pairs, CAST(8000 AS BIGINT) AS candidate_pairs_after_cap, 0.75::DOUBLE AS completeness_union, 0.5::DOUBLE AS completeness_after_cap, n_name AS block_key, CAST(n_nationkey AS BIGINT) AS pairs, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) / 32 END AS completeness FROM nation"
for _model in ("brz_blocking_report", "fct_blocking"):
    mart(_model, BLOCKED, "candidate_cap_per_a", "union_pairs", "candidate_pairs_after_cap", "completeness_union", "completeness_after_cap", "block_key", "pairs", "completeness")
mart("brz_split", f"WITH {M} SELECT 'fit' AS fold, 0 AS bucket_from, 20 AS bucket_to, n AS a_records, neg AS truth_pairs, k AS candidate_pairs FROM m WHERE k = 1 UNION ALL SELECT 'test', 40, 60, acc, neg, k FROM m WHERE k = 1", "fold", "bucket_from", "bucket_to", "a_records", "truth_pairs", "candidate_pairs")
SENSED = f"WITH {M} SELECT method_version, {THRESHOLDS['review_min']} AS review_min, CAST(32 + k AS DOUBLE) / 64 AS chosen_accept_threshold, {listed(POINT)}, r.cost_ratio, CAST(n_nationkey + r.cost_ratio AS DOUBLE) AS total_cost FROM m JOIN nation ON n_regionkey = k CROSS JOIN (VALUES {', '.join(f'({r})' for r in RATIOS)}) AS r(cost_ratio)"
mart("brz_review_sensitivity", SENSED, "method_version", "review_min", "chosen_accept_threshold", *POINT, "cost_ratio", "total_cost")
mart("fct_review_queue", f"SELECT *, review_queue + expected_false_accepts * cost_ratio AS total_cost_recomputed, threshold = chosen_accept_threshold AS is_chosen FROM ({SENSED})", "method_version", "review_min", "chosen_accept_threshold", *POINT, "cost_ratio", "total_cost", "total_cost_recomputed", "is_chosen")
for _model in ("brz_review_floor", "fct_review_floor"):
    mart(_model, f"WITH {M} SELECT method_version, {listed(FLOOR)} FROM m JOIN nation ON n_regionkey = k", "method_version", *FLOOR)
mart("slv_eval_folds", " UNION ALL ".join(f"SELECT method_version, '{f}' AS fold, {', '.join(e.format(i=i) + ' AS ' + c for c, e in FOLD_PARTS.items())} FROM ({FACTS}) AS m{i}" for i, f in enumerate(FOLDS)), "method_version", "fold", *FOLD_PARTS)
mart("slv_eval_metrics", f"WITH {M} SELECT method_version, 'test' AS fold, metric, value FROM (SELECT method_version, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in METRICS.items())} FROM m) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(METRICS)}))", "method_version", "fold", "metric", "value")
mart("fct_eval_metrics", f"WITH {M} SELECT method_version, 'test' AS fold, {', '.join(f'CAST({e} AS {chr(66)}IGINT) AS {c}' if c in W.COUNTS else f'CAST({e} AS DOUBLE) AS {c}' for c, e in METRICS.items())} FROM m", "method_version", "fold", *METRICS)
CALIBRATED = f"WITH {M} SELECT method_version, l.level, CAST(b.i AS INTEGER) AS bin_index, {BIN['lower']} AS lower_bound, {BIN['upper']} AS upper_bound, {BIN['n'].replace('k', 'm.k')} AS n, {BIN['mean_probability']} AS mean_probability, {BIN['observed_rate']} AS observed_rate, CAST(m.n AS INTEGER) AS n_total, CASE l.level WHEN 'decision_level' THEN {METRICS['ece']} ELSE {METRICS['ece_pair_level']} END AS ece, CASE l.level WHEN 'decision_level' THEN {METRICS['brier']} ELSE {METRICS['brier_pair_level']} END AS brier FROM m CROSS JOIN range(10) AS b(i) CROSS JOIN (VALUES ('decision_level'), ('pair_level')) AS l(level)"
for _model in ("slv_calibration", "fct_calibration"):
    mart(_model, CALIBRATED, "method_version", "level", "bin_index", "lower_bound", "upper_bound", "n", "mean_probability", "observed_rate", "n_total", "ece", "brier")
MAPPED = "SELECT CAST(l_orderkey AS VARCHAR) AS a_id, CAST(l_partkey AS VARCHAR) AS b_id, CASE l_linenumber % 3 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' ELSE 'ASIA' END AS method_version, l_discount AS score, l_discount AS probability, CASE WHEN l_discount >= 0.05::DOUBLE THEN 'auto_accept' ELSE 'review' END AS tier, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS top2_gap, '2026-01-02 03:04:05' AS decided_at_utc FROM lineitem WHERE l_orderkey <= 2000"
mart("brz_mapping", MAPPED, "a_id", "b_id", "method_version", "score", "probability", "tier", "top2_gap", "decided_at_utc")
BEST = f"SELECT a_id, method_version, b_id, probability, tier FROM (SELECT *, row_number() OVER (PARTITION BY a_id, method_version ORDER BY probability DESC, b_id) AS rn FROM ({MAPPED})) WHERE rn = 1"
for _model in ("slv_mapping", "fct_mapping"):
    mart(_model, BEST, "a_id", "method_version", "b_id", "probability", "tier")
mart("brz_lab_case_selection", "SELECT 'c' || n_nationkey AS case_id, CAST(n_nationkey * 8 + 1 AS VARCHAR) AS a_id, n_name || '|r' || n_regionkey AS reason_codes, CAST(n_nationkey AS BIGINT) AS selection_rank FROM nation", "case_id", "a_id", "reason_codes", "selection_rank")
mart("brz_lab_cases", "SELECT 'c' || n_nationkey AS case_id, 'AFRICA' AS method_version, TRUE AS exported, CAST(n_nationkey AS VARCHAR) AS b_id, CAST(n_nationkey AS DOUBLE) / 32 AS score, CAST(n_nationkey AS DOUBLE) / 64 AS probability, 'review' AS tier, CAST(n_nationkey AS DOUBLE) / 128 AS top2_gap, 'exported' AS gap_state, 'k1|' || n_name AS block_keys, 'single_method_exported' AS agreement_class FROM nation UNION ALL SELECT 'c' || n_nationkey, 'ASIA', FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'single_method_exported' FROM nation", "case_id", "method_version", "exported", "b_id", "score", "probability", "tier", "top2_gap", "gap_state", "block_keys", "agreement_class")
EVIDENCE = f"SELECT c.case_id, c.a_id, p.method_version, b.b_id, b.probability, b.tier, b.b_id IS NOT NULL AS exported FROM (SELECT 'c' || n_nationkey AS case_id, CAST(n_nationkey * 8 + 1 AS VARCHAR) AS a_id FROM nation) c CROSS JOIN (SELECT r_name AS method_version FROM region) p LEFT JOIN ({BEST}) b ON b.a_id = c.a_id AND b.method_version = p.method_version"
mart("fct_lab_case_evidence", EVIDENCE, "case_id", "a_id", "method_version", "b_id", "probability", "tier", "exported")
mart("fct_lab_case_comparison", f"SELECT case_id, a_id, methods_exported, distinct_chosen_b_ids, CASE WHEN methods_exported = 0 THEN 'none_exported' WHEN methods_exported = 1 THEN 'single_method_exported' WHEN distinct_chosen_b_ids = 1 THEN 'all_exported_agree' ELSE 'methods_disagree' END AS agreement_class FROM (SELECT case_id, any_value(a_id) AS a_id, count(*) FILTER (WHERE exported) AS methods_exported, count(DISTINCT b_id) AS distinct_chosen_b_ids FROM ({EVIDENCE}) GROUP BY 1)", "case_id", "a_id", "methods_exported", "distinct_chosen_b_ids", "agreement_class")
