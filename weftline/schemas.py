"""Enumerations, schemas and the contract that a frame is brought to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the record-linkage domain.
TIERS = ("auto_accept", "review", "reject")
FOLDS = ("fit", "calibrate", "test")
METHODS = ("exact_v1", "rules_v1", "learned_v1")
TRUTH_STATUSES = ("truth_dead", "truth_out_of_scope", "truth_unsampled", "truth_in_sample")
KEY_TYPES = ("k_title3", "k_artist_year", "k_title_sorted", "k_phonetic", "k_self_titled")
REASONS = ("no_candidate", "value_at_or_above_accept_min", "value_at_or_above_review_min", "value_below_review_min", "ambiguity_gap_below_threshold")
AGREEMENT_CLASSES = ("none_exported", "single_method_exported", "all_exported_agree", "methods_disagree")
ACTIONS = ("accept_candidate", "reject_candidate", "defer", "undo")

RECORD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("native_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("artist_credit", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("primary_type", T.StringType()),
    ]
)
TRUTH_LINK = T.StructType([T.StructField("a_id", T.StringType()), T.StructField("b_id", T.StringType())])
NORMALIZED_COLUMNS = ("title_norm", "title_norm_full", "title_qualifiers", "title_tokens", "title_metaphone", "artist_norm", "artist_norm_full", "artist_tokens", "artist_metaphone", "year_norm", "is_various_artists", "is_self_titled")
FUZZY_FEATURES = ("title_ratio", "title_partial", "title_token_sort", "title_token_set", "title_jw", "artist_ratio", "artist_token_set", "artist_jw")
NATIVE_FEATURES = ("artist_full_exact", "title_exact_norm", "year_diff", "year_either_missing", "both_va", "title_len_diff", "n_block_keys", "qualifier_mismatch")
PAIR_FEATURES = FUZZY_FEATURES + NATIVE_FEATURES
MAPPING_COLUMNS = ("a_id", "b_id", "method_version", "feature_version", "score", "probability", "tier", "block_keys", "top2_gap", "fold", "run_id", "decided_at_utc")
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("occurred_at_utc", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("scenario_id", T.StringType()),
        T.StructField("a_id", T.StringType()),
        T.StructField("method_version", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("b_id", T.StringType()),
        T.StructField("reason_code", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("evidence_ref", T.StringType()),
        T.StructField("supersedes_event_id", T.StringType()),
        T.StructField("reverses_event_id", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select, cast and order the columns of schema; a column that df lacks is an error, others are dropped."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the frame: {', '.join(missing)}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
