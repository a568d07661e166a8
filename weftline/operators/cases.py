"""Cases for review: evidence of each method, how methods agree, tags and a deterministic selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Criteria and how many cases each selects.
CAPS = {"worked_example": 3, "agreement_all_accept": 6, "method_disagreement": 8, "ambiguity_tie": 6, "ambiguity_demoted": 6, "gap_at_rounded_boundary": 4, "single_candidate": 5, "partial_export": 5, "unverified_accept": 5, "verified_wrong_accept": 5, "no_candidate": 4, "reject_all_methods": 3}


def evidence(cases: DataFrame, methods: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row for each case and method, with what the method published for it, if anything.

    cases: case_id, a_id; methods: method_version, accept_min, review_min, ambiguity_gap (a few rows, broadcast).
    """
    grid = cases.crossJoin(F.broadcast(methods))
    held = mapping.select("a_id", "method_version", "b_id", "score", "probability", "tier", "top2_gap", "block_keys")
    out = grid.join(held, ["a_id", "method_version"], "left").withColumn("exported", F.col("b_id").isNotNull())
    known = F.col("exported") & F.col("top2_gap").isNotNull()
    return out.withColumns(
        {
            "gap_state": F.when(~F.col("exported"), F.lit(None).cast("string")).when(F.col("top2_gap").isNull(), "single_candidate").otherwise("exported"),
            "ambiguity_demoted_derived": F.when(known, (F.col("tier") == "review") & (F.col("probability") >= F.col("accept_min")) & (F.col("top2_gap") < F.col("ambiguity_gap"))),
            "gap_at_rounded_boundary": F.when(known, F.col("top2_gap") == F.col("ambiguity_gap")),
        }
    )


def comparison(evidence: DataFrame) -> DataFrame:
    """(case_id, a_id, methods_exported, distinct_chosen_b_ids, agreement_class)"""
    out = evidence.groupBy("case_id").agg(F.any_value("a_id").alias("a_id"), F.count_if("exported").alias("methods_exported"), F.countDistinct(F.when(F.col("exported"), F.col("b_id"))).alias("distinct_chosen_b_ids"))
    kind = F.when(F.col("methods_exported") == 0, "none_exported").when(F.col("methods_exported") == 1, "single_method_exported").when(F.col("distinct_chosen_b_ids") == 1, "all_exported_agree").otherwise("methods_disagree")
    return out.withColumn("agreement_class", kind)


def tags(evidence: DataFrame, truth: DataFrame | None = None, n_candidates: DataFrame | None = None, worked: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, tag): every criterion that a record meets.

    truth: (a_id, b_id) and n_candidates: (a_id, n) add the criteria that need local evidence.
    """
    e = evidence
    if truth is not None:
        links = truth.select("a_id", "b_id").distinct().withColumn("_hit", F.lit(True))
        e = e.join(links, ["a_id", "b_id"], "left").join(truth.select("a_id").distinct().withColumn("_lab", F.lit(True)), "a_id", "left")
    else:
        e = e.withColumns({"_hit": F.lit(None).cast("boolean"), "_lab": F.lit(None).cast("boolean")})
    x, gap, review = F.col("exported"), F.col("top2_gap"), F.col("tier") == "review"
    accept = F.coalesce(x & (F.col("tier") == "auto_accept"), F.lit(False))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = e.groupBy("a_id").agg(
        F.count_if(x).alias("n"),
        F.countDistinct(F.when(x, F.col("b_id"))).alias("d"),
        F.count_if(accept).alias("acc"),
        some(x & gap.isNull()).alias("single"),
        some(x & review & (gap == 0)).alias("tie"),
        some(x & review & (F.col("probability") >= F.col("accept_min")) & (gap > 0) & (gap < F.col("ambiguity_gap"))).alias("demoted"),
        some(x & review & (gap == F.col("ambiguity_gap"))).alias("edge"),
        some(F.col("_lab")).alias("lab"),
        some(accept & F.col("_hit").isNull()).alias("wrong"),
    )
    met = {"worked_example": F.col("a_id").isin(*worked) if worked else F.lit(False), "agreement_all_accept": (F.col("n") == 3) & (F.col("d") == 1) & (F.col("acc") == 3), "method_disagreement": (F.col("n") >= 2) & (F.col("d") > 1), "ambiguity_tie": F.col("tie"), "ambiguity_demoted": F.col("demoted"), "gap_at_rounded_boundary": F.col("edge"), "single_candidate": F.col("single"), "partial_export": F.col("n").between(1, 2)}
    if truth is not None:
        met |= {"unverified_accept": (F.col("acc") > 0) & ~F.col("lab"), "verified_wrong_accept": (F.col("acc") > 0) & F.col("lab") & F.col("wrong")}
    if n_candidates is not None:
        facts = facts.join(n_candidates.select("a_id", F.col("n").alias("_c")), "a_id", "left")
        none = F.coalesce("_c", F.lit(0)) == 0
        met |= {"no_candidate": (F.col("n") == 0) & none, "reject_all_methods": (F.col("n") == 0) & ~none}
    held = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in met.items()]), lambda t: t.isNotNull())
    return facts.select("a_id", F.explode(held).alias("tag"))


def selection(tagged: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """(a_id, tags, selection_rank): the first records of each criterion by id up to its cap; each keeps all its tags."""
    order = Window.partitionBy("tag").orderBy("a_id")
    limit = F.create_map(*[x for t, n in caps.items() for x in (F.lit(t), F.lit(n))])
    chosen = tagged.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(caps.values())).filter(F.col("_n") <= limit[F.col("tag")]).select("a_id").distinct()
    out = tagged.join(chosen, "a_id", "left_semi").groupBy("a_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    # the caps bound the number of rows that are ranked together
    return out.withColumn("selection_rank", F.row_number().over(Window.orderBy("a_id")))


def available(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("available"))


def join_inflation(facts: DataFrame, mapping: DataFrame, key: str, units: str) -> DataFrame:
    """One row: rows and units before an inner join with a mapping and after it; duplicate keys inflate both."""
    before = facts.agg(F.count(F.lit(1)).alias("rows_before"), F.sum(units).alias("units_before"))
    after = facts.join(mapping.select(key), key).agg(F.count(F.lit(1)).alias("rows_after"), F.sum(units).alias("units_after"))
    return before.crossJoin(after)  # one row each
