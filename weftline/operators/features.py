"""Pair features: two look-ups and one projection, or, without Python, found where the pairs are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.similarity import fuzzy_features
from weftline.operators import blocking
from weftline.schemas import FUZZY_FEATURES, NATIVE_FEATURES

LOOKED_UP = ("title_norm", "artist_norm", "artist_norm_full", "title_qualifiers", "year_norm", "is_various_artists")


def with_records(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the looked-up columns of both records, named with _a and _b."""
    left, right = (side.select(F.col("native_id").alias(f"{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in LOOKED_UP]) for s, side in (("a", a), ("b", b)))
    return pairs.join(left, "a_id").join(right, "b_id")


def native() -> dict[str, Column]:
    text = lambda c: F.coalesce(c, F.lit(""))
    same = lambda c: (text(f"{c}_a") == text(f"{c}_b")).cast("int")
    words = lambda s: F.array_sort(F.array_distinct(F.coalesce(f"title_qualifiers_{s}", F.array().cast("array<string>"))))
    return {
        "artist_full_exact": same("artist_norm_full"),
        "title_exact_norm": same("title_norm"),
        "year_diff": F.abs(F.col("year_norm_a") - F.col("year_norm_b")),
        "year_either_missing": (F.col("year_norm_a").isNull() | F.col("year_norm_b").isNull()).cast("int"),
        "both_va": (F.coalesce("is_various_artists_a", F.lit(False)) & F.coalesce("is_various_artists_b", F.lit(False))).cast("int"),
        "title_len_diff": F.abs(F.length(text("title_norm_a")) - F.length(text("title_norm_b"))),
        "n_block_keys": F.size("block_keys"),
        "qualifier_mismatch": (words("a") != words("b")).cast("int"),
    }


def native_features(a: DataFrame, b: DataFrame, cap: int = blocking.CAP) -> DataFrame:
    """pair_features(candidates(a, b, cap), a, b, fuzzy=False), with the pairs dealt once."""
    found = {f: c for f, c in native().items() if f != "n_block_keys"}
    return blocking.candidates(a, b, cap, LOOKED_UP, found).select("a_id", "b_id", "block_keys", *NATIVE_FEATURES)


def pair_features(pairs: DataFrame, a: DataFrame, b: DataFrame, fuzzy: bool = True, keep: tuple[str, ...] = ("a_id", "b_id", "fold", "block_keys")) -> DataFrame:
    """The kept columns of pairs and the features; without fuzzy only those that need no Python.

    Similarities are computed once for each different quadruple of texts inside an Arrow batch.
    """
    held = with_records(pairs, a, b)
    kept = [c for c in keep if c in pairs.columns]
    if not fuzzy:
        exprs = native()
        return held.select(*kept, *[exprs[f].alias(f) for f in NATIVE_FEATURES])
    return _with_similarities(held, kept)


def candidate_features(a: DataFrame, b: DataFrame, cap: int = blocking.CAP) -> DataFrame:
    """pair_features(candidates(a, b, cap), a, b), without an exchange of pairs."""
    return _with_similarities(blocking.candidates_with_records(a, b, cap, LOOKED_UP), ["a_id", "b_id", "block_keys"])


def _with_similarities(held: DataFrame, kept: list[str]) -> DataFrame:
    exprs = native()
    scored = held.withColumn("_f", fuzzy_features("title_norm_a", "title_norm_b", "artist_norm_a", "artist_norm_b"))
    return scored.select(*kept, *[F.col(f"_f.{f}").alias(f) for f in FUZZY_FEATURES], *[exprs[f].alias(f) for f in NATIVE_FEATURES])
