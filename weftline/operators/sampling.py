"""Deterministic samples, folds, truth statuses and data contracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.hashing import fold_of, membership_hash, pair_hash
from weftline.schemas import FOLDS, TRUTH_STATUSES

EXAMPLES = 20
NO_THRESHOLD = "0" * 64
FIRST_YEAR = 1900


def unlinked_wanted(linked: int, unlinked_share: float) -> int:
    """How many unlinked records make up that share of a sample with the linked ones (Python rounding)."""
    if not 0 <= unlinked_share < 1:
        raise ValueError("the unlinked share must be in [0, 1)")
    return round(linked * unlinked_share / (1 - unlinked_share))


def threshold(pool: DataFrame, n: int, hash_col: str = "membership_hash") -> str:
    """The n-th smallest hash of the pool, of the largest if there are fewer; zeros for n = 0.

    Hashes are counted by their first four digits; then only those that share the digits of the n-th are sorted, a 65,536th of
    the pool, as hashes are spread evenly. So no task sorts a number of rows that grows as n does.
    """
    if n <= 0:
        return NO_THRESHOLD
    counts = {r["p"]: r["c"] for r in pool.groupBy(F.substring(hash_col, 1, 4).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}  # 65,536 rows at most
    before = 0
    for prefix in sorted(counts):
        if before + counts[prefix] >= n or prefix == max(counts):
            rest = min(n - before, counts[prefix])
            return pool.filter(F.substring(hash_col, 1, 4) == prefix).select(hash_col).orderBy(hash_col).limit(rest).agg(F.max(hash_col)).first()[0]
        before += counts[prefix]
    return NO_THRESHOLD


def side_sample(side: DataFrame, source: str, linked_ids: DataFrame, n_unlinked: int, pool: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The linked records and those unlinked ones of the pool whose hash is within the threshold, and the threshold.

    linked_ids: native_id. pool: what unlinked records may come from (all unlinked by default).
    """
    hashed = side.withColumn("membership_hash", membership_hash(F.lit(source), F.col("native_id")))
    linked = hashed.join(linked_ids.select("native_id").distinct().withColumn("is_linked", F.lit(True)), "native_id", "left").withColumn("is_linked", F.coalesce("is_linked", F.lit(False)))
    unlinked = linked.filter("not is_linked")
    if pool is not None:
        unlinked = unlinked.join(pool.select("native_id").distinct(), "native_id", "left_semi")
    limit = threshold(unlinked, n_unlinked)
    return linked.filter("is_linked").unionByName(unlinked.filter(F.col("membership_hash") <= limit)), limit


def pools(a: DataFrame, b: DataFrame, links: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """A's pool: in scope and without any link. B's pool: without a link from the scope; flagged if linked from outside only."""
    pool_a = a.filter(F.col("primary_type") == scope).join(links.select(F.col("a_id").alias("native_id")), "native_id", "left_anti")
    typed = links.join(a.select(F.col("native_id").alias("a_id"), "primary_type"), "a_id", "left")
    inside = typed.filter(F.col("primary_type") == scope).select(F.col("b_id").alias("native_id")).distinct()
    outside = typed.select(F.col("b_id").alias("native_id")).distinct().withColumn("_any", F.lit(True))
    pool_b = b.join(inside, "native_id", "left_anti").join(outside, "native_id", "left").withColumn("b_linked_out_of_scope", F.coalesce("_any", F.lit(False))).drop("_any")
    return pool_a, pool_b


def last_year_of(today: date) -> int:
    """The latest year that a record may have: the next one."""
    return today.year + 1


def without_wild_years(df: DataFrame, last_year: int) -> DataFrame:
    return df.withColumn("year", F.when(F.col("year").between(FIRST_YEAR, last_year), F.col("year")))


def wild_years(df: DataFrame, last_year: int) -> DataFrame:
    """One row: how many years without_wild_years() takes away."""
    return df.agg(F.count_if(F.col("year").isNotNull() & ~F.col("year").between(FIRST_YEAR, last_year)).alias("years_nulled"))


def with_fold(df: DataFrame, id_col: str = "native_id") -> DataFrame:
    return df.withColumn("fold", fold_of(F.col(id_col)))


def split_report(a: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fold, a_records, labelled_a_records, truth_pairs, candidate_pairs): every fold, empty ones too.

    Each input is counted by fold before anything is joined, so only three rows of each meet.
    """
    session = a.sparkSession
    folds = session.createDataFrame([(f,) for f in FOLDS], "fold string")
    n_a = with_fold(a).groupBy("fold").agg(F.count(F.lit(1)).alias("a_records"))
    n_truth = with_fold(truth, "a_id").groupBy("fold").agg(F.countDistinct("a_id").alias("labelled_a_records"), F.count(F.lit(1)).alias("truth_pairs"))
    n_pairs = with_fold(candidates, "a_id").groupBy("fold").agg(F.count(F.lit(1)).alias("candidate_pairs"))
    out = folds.join(n_a, "fold", "left").join(n_truth, "fold", "left").join(n_pairs, "fold", "left")
    return out.select("fold", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("a_records", "labelled_a_records", "truth_pairs", "candidate_pairs")])


def classify_links(links: DataFrame, a: DataFrame, b_ids: DataFrame, scope: str) -> DataFrame:
    """(a_id, b_id, a_primary_type, status) of the distinct links: dead before out of scope before in sample."""
    known = b_ids.select(F.col("native_id").alias("b_id")).distinct().withColumn("_alive", F.lit(True))
    typed = links.select("a_id", "b_id").distinct().join(a.select(F.col("native_id").alias("a_id"), F.col("primary_type").alias("a_primary_type")), "a_id", "left").join(known, "b_id", "left")
    status = F.when(F.col("_alive").isNull(), "truth_dead").when(~F.coalesce(F.col("a_primary_type") == scope, F.lit(False)), "truth_out_of_scope").otherwise("truth_in_sample")
    return typed.select("a_id", "b_id", "a_primary_type", status.alias("status"))


def apply_sample(truth: DataFrame, sample_a: DataFrame, sample_b: DataFrame) -> DataFrame:
    """In-sample links with an end that is not sampled become unsampled."""
    in_a = sample_a.select(F.col("native_id").alias("a_id")).distinct().withColumn("_a", F.lit(True))
    in_b = sample_b.select(F.col("native_id").alias("b_id")).distinct().withColumn("_b", F.lit(True))
    joined = truth.join(in_a, "a_id", "left").join(in_b, "b_id", "left")
    lost = (F.col("status") == "truth_in_sample") & (F.col("_a").isNull() | F.col("_b").isNull())
    return joined.withColumn("status", F.when(lost, "truth_unsampled").otherwise(F.col("status"))).select("a_id", "b_id", "a_primary_type", "status")


def truth_audit(truth: DataFrame, raw_links: DataFrame) -> DataFrame:
    """(measure, n): counts of links, statuses, types out of scope and one-to-many records."""
    raw = raw_links.agg(F.count(F.lit(1)).alias("links_raw"), F.countDistinct("a_id", "b_id").alias("_d"))
    raw = raw.select(F.explode(F.map_from_arrays(F.array(F.lit("links_raw"), F.lit("duplicate_links")), F.array(F.col("links_raw"), F.col("links_raw") - F.col("_d")))).alias("measure", "n"))
    held = truth.groupBy(F.col("status").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    statuses = truth.sparkSession.createDataFrame([(s,) for s in TRUTH_STATUSES], "measure string").join(held, "measure", "left").select("measure", F.coalesce("n", F.lit(0)).alias("n"))
    types = truth.filter("status = 'truth_out_of_scope'").groupBy(F.concat(F.lit("out_of_scope:"), F.coalesce("a_primary_type", F.lit("none"))).alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    inside = truth.filter("status = 'truth_in_sample'")
    per = []
    for side, other in (("a", "b"), ("b", "a")):
        counts = inside.groupBy(f"{side}_id").agg(F.countDistinct(f"{other}_id").alias("m")).agg(F.count(F.lit(1)).alias("r"), F.count_if(F.col("m") > 1).alias("o"))
        per.append(counts.select(F.explode(F.map_from_arrays(F.array(F.lit(f"{side}_records"), F.lit(f"one_to_many_{side}")), F.array("r", "o"))).alias("measure", "n")))
    out = raw
    for part in (statuses, types, *per):
        out = out.unionByName(part)
    return out.select("measure", F.col("n").cast("long").alias("n"))


def anomaly_examples(truth: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(status, pair_hash): for each status but in-sample the links with the smallest pair hashes."""
    from pyspark.sql import Window

    hashed = truth.filter("status <> 'truth_in_sample'").select("status", pair_hash(F.col("a_id"), F.col("b_id")).alias("pair_hash"))
    order = Window.partitionBy("status").orderBy("pair_hash")
    return hashed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def contract_report(side: DataFrame, last_year: int, keys: tuple[str, ...] = ("native_id",), id_pattern: str = r"^[0-9]+$", most_null: dict[str, float] | None = None) -> DataFrame:
    """(check_name, violations, checked, passed): unique grain, id format, year range and null rates.

    Everything but the grain is one aggregation; the grain groups by the keys.
    """
    limits = most_null or {"title": 0.01, "artist_credit": 0.05}
    gone = [c for c in limits if c not in side.columns]
    one = side.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(F.col("native_id").rlike(id_pattern), F.lit(False))).alias("bad_id"),
        F.count_if(F.col("year").isNotNull() & ~F.col("year").between(FIRST_YEAR, last_year)).alias("bad_year"),
        *[F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(f"null_{c}") for c in limits if c not in gone],
    )
    grain = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("twice"))
    both = one.crossJoin(grain)  # one row each
    rows = [F.struct(F.lit("grain_unique").alias("check_name"), F.col("twice").cast("long").alias("violations"), (F.col("twice") == 0).alias("passed")), F.struct(F.lit("id_format").alias("check_name"), F.col("bad_id").alias("violations"), (F.col("bad_id") == 0).alias("passed")), F.struct(F.lit("year_range").alias("check_name"), F.col("bad_year").alias("violations"), (F.col("bad_year") == 0).alias("passed"))]
    for c, most in limits.items():
        count = F.col("n") if c in gone else F.col(f"null_{c}")
        rows.append(F.struct(F.lit(f"null_rate:{c}").alias("check_name"), count.alias("violations"), (F.lit(c not in gone) & (count <= most * F.col("n"))).alias("passed")))
    return both.select(F.col("n").alias("checked"), F.explode(F.array(*rows)).alias("r")).select("r.check_name", "r.violations", "checked", "r.passed")
