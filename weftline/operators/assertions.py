"""Assertions over the warehouse: each gives the rows that break it, and no rows if it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: tuple) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def relationship(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def holds(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def several_accepts(mapping: DataFrame) -> DataFrame:
    return mapping.filter("tier = 'auto_accept'").groupBy("a_id", "method_version").agg(F.count(F.lit(1)).alias("accepts")).filter("accepts > 1")


def without_block_keys(mapping: DataFrame) -> DataFrame:
    return mapping.filter("block_keys is null or block_keys = ''").select("a_id", "method_version", "block_keys")


def missing_baselines(artifacts: DataFrame, marts: DataFrame, baselines: tuple[str, ...] = ("exact_v1", "rules_v1")) -> DataFrame:
    """Baselines without an artifact or a non-null precision, once there is any artifact."""
    wanted = artifacts.sparkSession.createDataFrame([(b,) for b in baselines], "method_version string")
    some = artifacts.limit(1).select(F.lit(True).alias("_some"))
    good = marts.filter("precision_auto_accept is not null").join(artifacts.select("method_version"), "method_version", "left_semi")
    return wanted.crossJoin(some).join(good, "method_version", "left_anti").select("method_version")


def not_whole(long: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return long.filter(F.col("metric").isin(*names) & (F.col("value") != F.floor("value")))


def unreconciled(long: DataFrame, wide: DataFrame, metrics: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """(method_version, metric, artifact_value, mart_value): where a long table and its pivot differ or one side is missing."""
    unpivoted = wide.unpivot("method_version", [F.col(m).cast("double").alias(m) for m in metrics], "metric", "mart_value")
    both = long.select("method_version", "metric", F.col("value").alias("artifact_value"), F.lit(True).alias("_l")).join(unpivoted.withColumn("_u", F.lit(True)), ["method_version", "metric"], "full_outer")
    x, y = F.col("artifact_value"), F.col("mart_value")
    return both.filter(F.col("_l").isNull() | F.col("_u").isNull() | (x.isNull() != y.isNull()) | (F.abs(x - y) > tolerance)).select("method_version", "metric", "artifact_value", "mart_value")


def unequal_evidence(bundle: DataFrame, mart: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(case_id, method_version) where two frames of evidence differ or one side is missing."""
    texts, numbers = ("exported", "b_id", "tier", "gap_state"), ("score", "probability", "top2_gap")
    keys = ["case_id", "method_version"]
    left = bundle.select(*keys, *[F.col(c).alias(f"{c}_l") for c in (*texts, *numbers)], F.lit(True).alias("_l"))
    right = mart.select(*keys, *[F.col(c).alias(f"{c}_r") for c in (*texts, *numbers)], F.lit(True).alias("_r"))
    wrong = F.col("_l").isNull() | F.col("_r").isNull()
    for c in texts:
        wrong = wrong | ~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))
    for c in numbers:
        wrong = wrong | (F.abs(F.coalesce(f"{c}_l", F.lit(-1.0)) - F.coalesce(f"{c}_r", F.lit(-1.0))) > tolerance)
    return left.join(right, keys, "full_outer").filter(wrong).select(*keys)


def shares_outside(frames: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """(source, metric, value): shares that are not in [0, 1]."""
    out = None
    for name, (df, columns) in frames.items():
        part = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select(F.lit(name).alias("source"), "s.metric", "s.value").filter("value is not null and (value < 0 or value > 1)")
        out = part if out is None else out.unionByName(part)
    return out


def recall_above_completeness(wide: DataFrame) -> DataFrame:
    return wide.filter(F.col("recall_overall") > F.col("pair_completeness") + 1e-9)


def wrong_costs(queue: DataFrame) -> DataFrame:
    return queue.filter(F.abs(F.col("total_cost") - F.col("total_cost_recomputed")) > 1e-6)


def shares_not_one(wide: DataFrame) -> DataFrame:
    return wide.filter(F.abs(F.col("tier_share_auto_accept") + F.col("tier_share_review") + F.col("tier_share_reject") - 1) > 1e-9)


def undocumented(schemas: dict[str, list[str]], docs: dict[str, dict[str, str]]) -> list[str]:
    """model or model.column without a description."""
    found = []
    for model, columns in schemas.items():
        held = docs.get(model, {})
        found += [] if held.get("") else [model]
        found += [f"{model}.{c}" for c in columns if not held.get(c)]
    return found
