"""The registered queries: callables (spark, sf_dir) -> DataFrame, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions.hashing import fold_of, membership_hash, pair_hash
from weftline.functions.similarity import jaro_winkler_column
from weftline.operators import assertions, blocking, cases, decide, evaluate, ledger, methods, profile, sampling
from weftline.operators.features import candidate_features, native_features, pair_features, with_records
from weftline.plans import marts
from weftline.plans import oracle as O
from weftline.plans.oracle import CAP, SCOPE, with_parts
from weftline.session import cut, stored
from weftline.sources import catalogue, dumps
from weftline.sources.catalogue import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The latest year allowed is the one after this; fixed, so that queries give the same rows every day.
TODAY = date(2026, 1, 1)
LAST_YEAR = sampling.last_year_of(TODAY)
#: The reference's number of trees of the learned method and the fewest pairs in a leaf.
REFERENCE_TREES, REFERENCE_LEAF = 300, 50
SWEPT, FLOORS = evaluate.ACCEPT_POINTS, tuple(f for f in evaluate.FLOOR_POINTS if f < 0.95)
LONG_METRICS = ("decided", "accepted", "queued", "demoted")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and credits with the decorations that the rules are about, made from `part`."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    five = F.when(key % 5 == 0, F.concat("p_name", F.lit(" [Deluxe Edition]"))).when(key % 5 == 1, F.concat("p_name", F.lit(" (Live) (2001 Remaster)"))).when(key % 5 == 2, F.concat(F.upper("p_name"), F.lit(" & Co."))).when(key % 5 == 3, F.concat(F.lit("Élan "), "p_name")).otherwise(F.col("p_name"))
    six = F.when(key % 6 == 0, F.concat("p_brand", F.lit(", The"))).when(key % 6 == 1, F.concat(F.lit("The "), "p_brand", F.lit(" (2)"))).when(key % 6 == 2, "Various").when(key % 6 == 3, "V/A").when(key % 6 == 4, F.concat(F.lit("Los "), "p_type")).otherwise(F.col("p_brand"))
    size = F.col("p_size")
    return p.select(key.cast("string").alias("native_id"), five.alias("title"), six.alias("artist_credit"), F.when(size > 45, None).when(size < 3, 1800 + size).otherwise(1950 + size).cast("int").alias("year"))


def scored_pairs(spark: SparkSession, sf_dir: str, fuzzy: bool = False, phonetic: bool = False) -> DataFrame:
    """SQL has no phonetic key; what no SQL checks is given that key too."""
    a, b = catalogue.sides(spark, sf_dir, phonetic)
    made = candidate_features(a, b, CAP) if fuzzy else native_features(a, b, CAP)
    return made.withColumn("fold", fold_of(F.col("a_id")))


def native_scores() -> dict[str, Column]:
    """Scores that need no Python on the executors."""
    return {
        "exact_v1": methods.exact_score(),
        "rules_v1": methods.rules_score("title_exact_norm", "artist_full_exact"),
        "names_v1": F.lit(0.6) * F.col("title_exact_norm") + F.lit(0.4) * F.col("artist_full_exact"),
    }


def all_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the three scores that need no Python, in one pass over the features."""
    pairs = scored_pairs(spark, sf_dir).select("a_id", "b_id", "block_keys", F.explode(F.array(*[F.struct(F.lit(m).alias("method_version"), s.cast("double").alias("probability")) for m, s in native_scores().items()])).alias("s")).select("a_id", "b_id", "block_keys", "s.*")
    return decide.decide(pairs.withColumn("score", F.col("probability")), by=("method_version",))


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay rows of the native rules score over the test fold."""
    a, _ = catalogue.sides(spark, sf_dir)
    pairs = methods.scored(scored_pairs(spark, sf_dir), native_scores()["rules_v1"])
    return decide.replay_rows(pairs, a.filter(fold_of(F.col("native_id")) == "test").select(F.col("native_id").alias("a_id")), catalogue.links(spark, sf_dir))


# normalisation


@query("norm_basic", f"SELECT doc_id, md5({O.basic('text')}) AS basic_md5 FROM documents")
def norm_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.basic(F.col("text"))).alias("basic_md5"))


@query("norm_records", with_parts("SELECT native_id, title_norm, title_norm_full, artist_norm, artist_norm_full, is_various_artists, CAST(n_qualifiers AS INTEGER) AS n_qualifiers FROM np", "np"))
def norm_records(spark, sf_dir):
    return N.normalize_frame(decorated(spark, sf_dir)).select("native_id", "title_norm", "title_norm_full", "artist_norm", "artist_norm_full", "is_various_artists", F.size("title_qualifiers").alias("n_qualifiers"))


@query("norm_tokens", with_parts("SELECT native_id, array_to_string(tokens, ' ') AS tokens, is_self_titled FROM nr", "nr"))
def norm_tokens(spark, sf_dir):
    every = N.normalize_frame(catalogue.records(spark, sf_dir))
    return every.select("native_id", F.array_join("title_tokens", " ").alias("tokens"), "is_self_titled")


@query("norm_phonetic")
def norm_phonetic(spark, sf_dir):
    return N.normalize_frame(catalogue.records(spark, sf_dir), phonetic=True).select("native_id", "title_metaphone", "artist_metaphone")


# samples, folds, truth, contracts


@query("membership_sample", with_parts("SELECT native_id, sha256('a|' || native_id) AS membership_hash, native_id IN (SELECT a_id FROM truth) AS is_linked FROM nr WHERE side = 'a' AND (native_id IN (SELECT a_id FROM truth) OR sha256('a|' || native_id) <= (SELECT max(h) FROM (SELECT sha256('a|' || native_id) AS h FROM nr WHERE side = 'a' AND native_id NOT IN (SELECT a_id FROM truth) ORDER BY h LIMIT 60)))", "nr", "truth"))
def membership_sample(spark, sf_dir):
    a, _ = catalogue.sides(spark, sf_dir)
    sample, _ = sampling.side_sample(a, "a", catalogue.links(spark, sf_dir).select(F.col("a_id").alias("native_id")), 60)
    return sample.select("native_id", "membership_hash", "is_linked")


@query("fold_split", with_parts(f"SELECT native_id, {O.fold('native_id')} AS fold FROM nr", "nr"))
def fold_split(spark, sf_dir):
    return sampling.with_fold(catalogue.records(spark, sf_dir)).select("native_id", "fold")


@query(
    "split_report",
    with_parts(
        f"SELECT f.fold, (SELECT count(*) FROM nr WHERE side = 'a' AND {O.fold('native_id')} = f.fold) AS a_records, (SELECT count(DISTINCT a_id) FROM truth WHERE {O.fold('a_id')} = f.fold) AS labelled_a_records, (SELECT count(*) FROM truth WHERE {O.fold('a_id')} = f.fold) AS truth_pairs, (SELECT count(*) FROM cand WHERE {O.fold('a_id')} = f.fold) AS candidate_pairs FROM (VALUES ('fit'), ('calibrate'), ('test')) AS f(fold)",
        "nr",
        "truth",
        "cand",
    ),
)
def split_report(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir)
    return sampling.split_report(a, catalogue.links(spark, sf_dir), blocking.candidates(a, b, CAP))


TRUTH_STATUS = f"SELECT t.a_id, t.b_id, a.primary_type AS a_primary_type, CASE WHEN b.native_id IS NULL THEN 'truth_dead' WHEN a.primary_type IS DISTINCT FROM '{SCOPE}' THEN 'truth_out_of_scope' WHEN {O.bucket('t.b_id')} >= 90 THEN 'truth_unsampled' ELSE 'truth_in_sample' END AS status FROM truth t LEFT JOIN rec a ON a.native_id = t.a_id LEFT JOIN (SELECT native_id FROM rec WHERE side = 'b' AND CAST(native_id AS BIGINT) NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) b ON b.native_id = t.b_id"


def classified(spark, sf_dir):
    from weftline.functions.hashing import bucket100

    every = catalogue.records(spark, sf_dir)
    a, b = every.filter("side = 'a'"), every.filter("side = 'b'")
    removed = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("native_id"))
    truth = sampling.classify_links(catalogue.links(spark, sf_dir), a, b.join(removed, "native_id", "left_anti"), SCOPE)
    return sampling.apply_sample(truth, a, b.filter(bucket100(F.col("native_id")) < 90))


@query("truth_classify", with_parts(TRUTH_STATUS, "truth", "rec"))
def truth_classify(spark, sf_dir):
    return classified(spark, sf_dir)


@query(
    "truth_audit",
    with_parts(
        f", ts AS ({TRUTH_STATUS}), ins AS (SELECT * FROM ts WHERE status = 'truth_in_sample')\nSELECT 'links_raw' AS measure, count(*) + (SELECT count(*) FROM truth WHERE CAST(a_id AS BIGINT) % 4 = 0) AS n FROM ts UNION ALL SELECT 'duplicate_links', count(*) FROM truth WHERE CAST(a_id AS BIGINT) % 4 = 0 UNION ALL SELECT s, (SELECT count(*) FROM ts WHERE status = s) FROM (VALUES ('truth_dead'), ('truth_out_of_scope'), ('truth_unsampled'), ('truth_in_sample')) AS v(s) "
        "UNION ALL SELECT 'out_of_scope:' || coalesce(a_primary_type, 'none'), count(*) FROM ts WHERE status = 'truth_out_of_scope' GROUP BY 1 "
        "UNION ALL SELECT 'a_records', count(DISTINCT a_id) FROM ins UNION ALL SELECT 'one_to_many_a', count(*) FROM (SELECT a_id FROM ins GROUP BY 1 HAVING count(DISTINCT b_id) > 1) UNION ALL SELECT 'b_records', count(DISTINCT b_id) FROM ins UNION ALL SELECT 'one_to_many_b', count(*) FROM (SELECT b_id FROM ins GROUP BY 1 HAVING count(DISTINCT a_id) > 1)",
        "truth",
        "rec",
    ).replace("\n, ts AS", ",\nts AS"),
)
def truth_audit(spark, sf_dir):
    truth = classified(spark, sf_dir)
    links = catalogue.links(spark, sf_dir)
    # some links are given twice
    return sampling.truth_audit(truth, links.unionByName(links.filter(F.col("a_id").cast("long") % 4 == 0)))


@query(
    "contracts_report",
    with_parts(
        ", c AS (SELECT count(*) AS n, count(*) - count(DISTINCT native_id) AS twice, count(*) FILTER (WHERE NOT regexp_full_match(native_id, '[0-9]+')) AS bad_id, count(*) FILTER (WHERE year IS NOT NULL AND NOT year BETWEEN 1900 AND 2027) AS bad_year, count(*) FILTER (WHERE title IS NULL OR title = '') AS nt, count(*) FILTER (WHERE artist_credit IS NULL OR artist_credit = '') AS nc FROM parts_)\n"
        "SELECT 'grain_unique' AS check_name, twice AS violations, n AS checked, twice = 0 AS passed FROM c UNION ALL SELECT 'id_format', bad_id, n, bad_id = 0 FROM c UNION ALL SELECT 'year_range', bad_year, n, bad_year = 0 FROM c UNION ALL SELECT 'null_rate:title', nt, n, nt <= 0.01 * n FROM c UNION ALL SELECT 'null_rate:artist_credit', nc, n, nc <= 0.05 * n FROM c",
        "parts_",
    ).replace("\n, c AS", ",\nc AS"),
)
def contracts_report(spark, sf_dir):
    return sampling.contract_report(decorated(spark, sf_dir), LAST_YEAR)


# blocking


@query("block_keys", with_parts("SELECT side, native_id, key_type, key FROM keys", "keys"))
def block_keys(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir)
    return blocking.key_frame(a).withColumn("side", F.lit("a")).unionByName(blocking.key_frame(b).withColumn("side", F.lit("b")))


@query("block_candidates", with_parts("SELECT * FROM cand", "cand"))
def block_candidates(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir)
    return blocking.candidates(a, b, CAP).withColumn("block_keys", F.array_join("block_keys", "|"))


@query("block_report", with_parts("SELECT k.key_type, k.n AS keys_emitted, coalesce(p.n, 0) AS pairs FROM (SELECT key_type, count(*) AS n FROM keys WHERE side = 'a' GROUP BY 1) k LEFT JOIN (SELECT key_type, count(*) AS n FROM pk GROUP BY 1) p ON k.key_type = p.key_type", "keys", "pk"))
def block_report(spark, sf_dir):
    keys_a, keys_b = map(blocking.key_frame, catalogue.sides(spark, sf_dir))
    return blocking.counts_by_key(keys_a, blocking.pair_keys(keys_a, keys_b))


@query("block_largest", with_parts("SELECT key_type, CAST(rank AS INTEGER) AS rank, block_size FROM (SELECT key_type, count(*) AS block_size, row_number() OVER (PARTITION BY key_type ORDER BY count(*) DESC, key) AS rank FROM keys WHERE side = 'a' GROUP BY key_type, key) WHERE rank <= 5", "keys"))
def block_largest(spark, sf_dir):
    return blocking.largest_blocks(blocking.key_frame(catalogue.sides(spark, sf_dir)[0]))


@query("block_overflow", with_parts(f"SELECT count(*) AS a_with_candidates, CAST(max(n) AS BIGINT) AS max_candidates, CAST(sum(greatest(n - {CAP}, 0)) AS BIGINT) AS pairs_dropped, count(*) FILTER (WHERE n > {CAP}) AS a_over_cap FROM (SELECT a_id, count(*) AS n FROM up GROUP BY 1)", "up"))
def block_overflow(spark, sf_dir):
    keys_a, keys_b = map(blocking.key_frame, catalogue.sides(spark, sf_dir))
    return blocking.overflow(blocking.union_pairs(blocking.pair_keys(keys_a, keys_b)), CAP)


def completeness(spark, sf_dir, phonetic: bool = False) -> DataFrame:
    """Keys are looked up for the truth pairs alone; what the cap keeps needs no pairs of large blocks either."""
    a, b = catalogue.sides(spark, sf_dir, phonetic)
    links = cut(catalogue.links(spark, sf_dir))
    pairs = blocking.truth_pair_keys(links, blocking.key_frame(a), blocking.key_frame(b))
    return blocking.completeness(links, pairs, blocking.union_pairs(pairs), blocking.candidates(a, b, CAP))


@query("pair_completeness", with_parts("SELECT m.measure, m.found, (SELECT count(*) FROM truth) AS truth_pairs FROM (SELECT p.key_type AS measure, count(*) AS found FROM pk p JOIN truth t ON p.a_id = t.a_id AND p.b_id = t.b_id GROUP BY 1 UNION ALL SELECT 'union', count(*) FROM up u JOIN truth t ON u.a_id = t.a_id AND u.b_id = t.b_id UNION ALL SELECT 'after_cap', count(*) FROM cand c JOIN truth t ON c.a_id = t.a_id AND c.b_id = t.b_id) m", "pk", "up", "cand", "truth"))
def pair_completeness(spark, sf_dir):
    return completeness(spark, sf_dir)


# features and methods


@query("pair_features_native", with_parts("SELECT * FROM feat", "feat"))
def pair_features_native(spark, sf_dir):
    return scored_pairs(spark, sf_dir).drop("fold").withColumn("block_keys", F.array_join("block_keys", "|"))


def millionths(x: str) -> str:
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


@query("pair_feature_jw", with_parts(f"SELECT c.a_id, c.b_id, {millionths(O.jaro_winkler('a.title_norm', 'b.title_norm'))} AS title_jw_millionths, {millionths(O.jaro_winkler('a.artist_norm', 'b.artist_norm'))} AS artist_jw_millionths FROM cand c JOIN nr a ON c.a_id = a.native_id JOIN nr b ON c.b_id = b.native_id", "cand", "nr"))
def pair_feature_jw(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir)
    held = with_records(blocking.candidates(a, b, CAP), a, b)
    jw = lambda c: F.round(jaro_winkler_column(F.col(f"{c}_norm_a"), F.col(f"{c}_norm_b")) * 1000000).cast("long")
    return held.select("a_id", "b_id", jw("title").alias("title_jw_millionths"), jw("artist").alias("artist_jw_millionths"))


@query("pair_features_all", with_parts("SELECT * FROM fuzzy", "fuzzy"))
def pair_features_all(spark, sf_dir):
    return scored_pairs(spark, sf_dir, fuzzy=True).drop("fold").withColumn("block_keys", F.array_join("block_keys", "|"))


RULED = ", ranked AS (SELECT *, row_number() OVER w AS rn, lead(probability) OVER w AS v2 FROM fuzzy_scores WINDOW w AS (PARTITION BY a_id ORDER BY probability DESC, b_id))\n"


@query("rules_decisions", with_parts(RULED + "SELECT a_id, b_id, block_keys, probability, probability - v2 AS top2_gap, CASE WHEN probability >= 0.0756756772994995 AND coalesce(probability - v2 < 0.1::DOUBLE, FALSE) THEN 'review' WHEN probability >= 0.65 THEN 'auto_accept' WHEN probability >= 0.0756756772994995 THEN 'review' ELSE 'reject' END AS tier, probability >= 0.65 AND coalesce(probability - v2 < 0.1::DOUBLE, FALSE) AS ambiguity_review FROM ranked WHERE rn = 1", "fuzzy_scores").replace("\n, ranked AS", ",\nranked AS"))
def rules_decisions(spark, sf_dir):
    """The rules method as it is, on token sets, at the policy that was fitted for it."""
    pairs = methods.scored(scored_pairs(spark, sf_dir, fuzzy=True), methods.rules_score())
    return decide.decide(pairs, decide.Policy(0.65, 0.0756756772994995, 0.1)).select("a_id", "b_id", F.array_join("block_keys", "|").alias("block_keys"), "probability", "top2_gap", "tier", "ambiguity_review")


@query("pair_features_fuzzy")
def pair_features_fuzzy(spark, sf_dir):
    return scored_pairs(spark, sf_dir, fuzzy=True, phonetic=True).withColumn("block_keys", F.array_join("block_keys", "|"))


@query("rules_fuzzy_decisions")
def rules_fuzzy_decisions(spark, sf_dir):
    pairs = methods.scored(scored_pairs(spark, sf_dir, fuzzy=True, phonetic=True), methods.rules_score())
    return decide.decide(pairs, decide.Policy(0.65, 0.0756756772994995, 0.1)).withColumn("block_keys", F.array_join("block_keys", "|"))


@query("learned_decisions")
def learned_decisions(spark, sf_dir):
    """Features are dear and needed twice, to train and to be scored; links are read from all texts and needed three times."""
    features = stored(scored_pairs(spark, sf_dir, fuzzy=True, phonetic=True))
    learned = methods.fit_learned(features, cut(catalogue.links(spark, sf_dir)), trees=REFERENCE_TREES, least_leaf=REFERENCE_LEAF)
    return decide.decide(learned.score(features).select("a_id", "b_id", "fold", "block_keys", "score", "probability")).withColumn("block_keys", F.array_join("block_keys", "|"))


@query("decisions", with_parts("SELECT method_version, a_id, b_id, block_keys, probability, top2_gap, tier, ambiguity_review FROM dec", "dec"))
def decisions(spark, sf_dir):
    return all_decisions(spark, sf_dir).select("method_version", "a_id", "b_id", F.array_join("block_keys", "|").alias("block_keys"), "probability", "top2_gap", "tier", "ambiguity_review")


@query("tier_counts", with_parts("SELECT method_version, tier, count(*) AS n FROM dec GROUP BY 1, 2", "dec"))
def tier_counts(spark, sf_dir):
    return all_decisions(spark, sf_dir).groupBy("method_version", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "threshold_curve",
    with_parts(
        f", fit AS (SELECT d.probability AS score, t.b_id IS NOT NULL AS correct FROM dec d LEFT JOIN truth t ON d.a_id = t.a_id AND d.b_id = t.b_id WHERE d.method_version = 'rules_v1' AND d.a_id IN (SELECT a_id FROM truth) AND {O.fold('d.a_id')} = 'fit'), g AS (SELECT score, count(*) AS k, count(*) FILTER (WHERE correct) AS c FROM fit GROUP BY 1)\n"
        "SELECT score, CAST(sum(k) OVER w AS BIGINT) AS n, CAST(sum(c) OVER w AS BIGINT) AS \"right\" FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "dec",
        "truth",
    ).replace("\n, fit AS", ",\nfit AS"),
)
def threshold_curve(spark, sf_dir):
    links = catalogue.links(spark, sf_dir)
    labelled = methods.with_labels(all_decisions(spark, sf_dir).filter("method_version = 'rules_v1'"), links).filter(F.col("label").isNotNull() & (fold_of(F.col("a_id")) == "fit"))
    return methods.threshold_curve(labelled.select(F.col("probability").alias("score"), (F.col("label") == 1).alias("correct")), 1).select("score", "n", "right")


@query("pair_labels", with_parts("SELECT c.a_id, c.b_id, CASE WHEN t.b_id IS NOT NULL THEN 1 WHEN c.a_id IN (SELECT a_id FROM truth) THEN 0 END AS label FROM cand c LEFT JOIN truth t ON c.a_id = t.a_id AND c.b_id = t.b_id", "cand", "truth"))
def pair_labels(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir)
    return methods.with_labels(blocking.candidates(a, b, CAP), catalogue.links(spark, sf_dir)).select("a_id", "b_id", "label")


# replay and evaluation


@query("replay_rows", with_parts("SELECT * FROM rows_", "rows_"))
def replay_rows_query(spark, sf_dir):
    return replay_rows(spark, sf_dir)


@query("eval_counts", O.replayed([(0.95, 0.5, 0.1)]))
def eval_counts(spark, sf_dir):
    return decide.replay(replay_rows(spark, sf_dir), decide.policy_table(spark, [decide.Policy(0.95, 0.5, 0.1)]))


@query("accept_sweep", O.replayed([(t, 0.5, 0.1) for t in SWEPT]))
def accept_sweep(spark, sf_dir):
    return evaluate.accept_sweep(replay_rows(spark, sf_dir), 0.5, 0.1, SWEPT)


@query("floor_sweep", O.replayed([(0.95, f, 0.1) for f in FLOORS]))
def floor_sweep(spark, sf_dir):
    return evaluate.floor_sweep(replay_rows(spark, sf_dir), 0.95, 0.1, FLOORS)


@query(
    "legacy_sweep",
    with_parts(
        f", f AS (SELECT v1, labelled, top1_correct, v1 >= 0.95 AND coalesce(v1 - v2 < 0.1::DOUBLE, FALSE) AS demoted FROM rows_ WHERE v1 IS NOT NULL), t AS (SELECT * FROM (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in SWEPT)}) AS v(threshold))\n"
        "SELECT threshold, count(*) FILTER (WHERE v1 >= threshold AND NOT demoted) AS accepts, count(*) FILTER (WHERE v1 >= 0.5 AND v1 < threshold) AS queue_floor, count(*) FILTER (WHERE v1 >= threshold AND demoted) AS queue_ambiguity, count(*) FILTER (WHERE v1 >= 0.5 AND v1 < threshold) + count(*) FILTER (WHERE v1 >= threshold AND demoted) AS review_queue, count(*) FILTER (WHERE v1 >= threshold AND NOT demoted AND labelled) AS labelled_accepts, count(*) FILTER (WHERE v1 >= threshold AND NOT demoted AND labelled AND top1_correct) AS correct FROM f CROSS JOIN t GROUP BY 1",
        "rows_",
    ).replace("\n, f AS", ",\nf AS"),
)
def legacy_sweep(spark, sf_dir):
    return decide.legacy_sweep(replay_rows(spark, sf_dir), decide.Policy(0.95, 0.5, 0.1), list(SWEPT))


#: Faults planted into replay rows by a record's id, and what each rule then has to find.
FAULTY = """SELECT a_id, labelled, CASE WHEN f = 1 THEN NULL WHEN f = 6 THEN 'inf'::DOUBLE ELSE v1 END AS v1, CASE WHEN f = 2 THEN v1 + 1 ELSE v2 END AS v2, CASE WHEN f = 3 THEN -1 ELSE n_candidates END AS n, CASE WHEN f = 4 THEN NOT labelled ELSE top1_correct END AS top1, CASE WHEN f = 5 THEN NULL ELSE truth_reachable END AS reach
FROM (SELECT *, (CAST(a_id AS BIGINT) // 2) % 7 AS f FROM rows_)"""
RULES = {
    "a negative number of candidates": "n < 0",
    "v1 without candidates, or candidates without v1": "(v1 IS NULL) <> (n = 0)",
    "v2 with fewer than two candidates": "v2 IS NOT NULL AND n < 2",
    "no v2 with two candidates or more": "v2 IS NULL AND n >= 2",
    "a value that is not finite": "isinf(v1) OR isinf(v2)",
    "v2 above v1": "v2 > v1",
    "an unlabelled row with correctness or reachability": "NOT labelled AND (top1 IS NOT NULL OR reach IS NOT NULL)",
    "a labelled row without reachability": "labelled AND reach IS NULL",
    "a labelled row with a candidate and no correctness": "labelled AND v1 IS NOT NULL AND top1 IS NULL",
    "correctness without a candidate": "v1 IS NULL AND top1 IS NOT NULL",
}


@query("bad_replay_rows", with_parts(f", bad AS ({FAULTY})\n" + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS problem, count(*) FILTER (WHERE {c}) AS n FROM bad" for p, c in RULES.items()) + ") WHERE n > 0", "rows_").replace("\n, bad AS", ",\nbad AS"))
def bad_replay_rows(spark, sf_dir):
    fault = F.floor(F.col("a_id").cast("long") / 2) % 7
    changed = {"v1": F.when(fault == 1, None).when(fault == 6, float("inf")).otherwise(F.col("v1")), "v2": F.when(fault == 2, F.col("v1") + 1).otherwise(F.col("v2")), "n_candidates": F.when(fault == 3, -1).otherwise(F.col("n_candidates")), "top1_correct": F.when(fault == 4, ~F.col("labelled")).otherwise(F.col("top1_correct")), "truth_reachable": F.when(fault == 5, None).otherwise(F.col("truth_reachable"))}
    return decide.bad_replay_rows(replay_rows(spark, sf_dir).withColumns(changed))


JUDGED = ", j AS (SELECT h.probability, CAST(h.hit AS INTEGER) AS label FROM hits h WHERE a_id IN (SELECT a_id FROM truth))\n"


def judged(spark, sf_dir):
    return evaluate.judged_pairs(methods.scored(scored_pairs(spark, sf_dir), native_scores()["rules_v1"]), catalogue.links(spark, sf_dir))


@query("calibration_bins", with_parts(JUDGED + f"SELECT CAST(b.i AS INTEGER) AS bin_index, count(j.label) AS n, coalesce(sum(j.label), 0)::BIGINT AS observed FROM range(10) AS b(i) LEFT JOIN j ON {O.bin_case('j.probability')} = b.i GROUP BY 1", "hits", "truth").replace("\n, j AS", ",\nj AS"))
def calibration_bins(spark, sf_dir):
    bins = evaluate.calibration_bins(judged(spark, sf_dir))
    return bins.select("bin_index", "n", F.round(F.coalesce(F.col("observed_rate") * F.col("n"), F.lit(0))).cast("long").alias("observed"))


@query("confusion", with_parts(JUDGED + "SELECT count(*) FILTER (WHERE probability >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE probability >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE probability < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE probability < 0.5 AND label = 0) AS tn FROM j", "hits", "truth").replace("\n, j AS", ",\nj AS"))
def confusion(spark, sf_dir):
    return evaluate.confusion(judged(spark, sf_dir), 0.5)


# warehouse


def long_metrics(spark, sf_dir):
    counts = all_decisions(spark, sf_dir).groupBy("method_version").agg(F.count(F.lit(1)).alias("decided"), F.count_if(F.col("tier") == "auto_accept").alias("accepted"), F.count_if(F.col("tier") == "review").alias("queued"), F.count_if("ambiguity_review").alias("demoted"))
    return counts.unpivot("method_version", [F.col(m).cast("double").alias(m) for m in LONG_METRICS], "metric", "value")


@query("metrics_unpivot", with_parts("SELECT * FROM long", "long"))
def metrics_unpivot(spark, sf_dir):
    return long_metrics(spark, sf_dir)


@query("metrics_pivot", with_parts(O.metric_pivot(LONG_METRICS), "long"))
def metrics_pivot(spark, sf_dir):
    return pivoted(long_metrics(spark, sf_dir))


def pivoted(long: DataFrame) -> DataFrame:
    wide = long.groupBy("method_version").pivot("metric", list(LONG_METRICS)).agg(F.max("value"))
    return wide.select("method_version", *[F.col(m).cast("long").alias(m) for m in LONG_METRICS])


@query("reconcile_full_outer", with_parts(f", wide AS ({O.metric_pivot(LONG_METRICS)}), u AS (UNPIVOT (SELECT * REPLACE (decided + CASE WHEN method_version = 'names_v1' THEN 1 ELSE 0 END AS decided) FROM wide WHERE method_version <> 'exact_v1') ON {', '.join(LONG_METRICS)} INTO NAME metric VALUE v)\nSELECT coalesce(l.method_version, u.method_version) AS method_version, coalesce(l.metric, u.metric) AS metric, l.value AS artifact_value, CAST(u.v AS DOUBLE) AS mart_value FROM long l FULL OUTER JOIN u ON l.method_version = u.method_version AND l.metric = u.metric WHERE l.method_version IS NULL OR u.method_version IS NULL OR abs(l.value - u.v) > 1e-9", "long").replace("\n, wide AS", ",\nwide AS"))
def reconcile_full_outer(spark, sf_dir):
    # one method is taken out of the mart and one figure is changed, so there is something to find
    long = cut(long_metrics(spark, sf_dir))  # a few rows, used twice
    wide = pivoted(long).filter("method_version <> 'exact_v1'").withColumn("decided", F.col("decided") + F.when(F.col("method_version") == "names_v1", 1).otherwise(0))
    return assertions.unreconciled(long, wide, LONG_METRICS)


@query("having_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having_violations(spark, sf_dir):
    return assertions.unique(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("relationship_violations", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def relationship_violations(spark, sf_dir):
    parent = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return assertions.relationship(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", parent, "c_custkey").distinct()


@query("mapping_dedup", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def mapping_dedup(spark, sf_dir):
    # the warehouse's rule for a repeated key, on the table that has repeated keys: max_by needs no sort
    best = F.max_by(F.struct("l_partkey", "l_extendedprice"), F.struct("l_extendedprice", -F.col("l_partkey"), -F.col("l_suppkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(best.alias("x")).select("l_orderkey", "l_linenumber", "x.l_partkey", "x.l_extendedprice")


@query("case_evidence", with_parts("SELECT case_id, method_version, exported, b_id, probability, tier, top2_gap, gap_state, ambiguity_demoted_derived, gap_at_rounded_boundary FROM evid", "evid"))
def case_evidence(spark, sf_dir):
    return evidence(spark, sf_dir).select("case_id", "method_version", "exported", "b_id", "probability", "tier", "top2_gap", "gap_state", "ambiguity_demoted_derived", "gap_at_rounded_boundary")


def evidence(spark, sf_dir):
    every = cut(all_decisions(spark, sf_dir))  # used twice
    points = spark.createDataFrame([(m, 0.95, 0.5, 0.1) for m in native_scores()], "method_version string, accept_min double, review_min double, ambiguity_gap double")
    known = every.select(F.concat(F.lit("case-"), "a_id").alias("case_id"), "a_id").distinct()
    return cases.evidence(known, points, every.filter("tier <> 'reject'").withColumn("block_keys", F.array_join("block_keys", "|")))


@query("agreement_class", with_parts("SELECT case_id, a_id, methods_exported, distinct_chosen_b_ids, CASE WHEN methods_exported = 0 THEN 'none_exported' WHEN methods_exported = 1 THEN 'single_method_exported' WHEN distinct_chosen_b_ids = 1 THEN 'all_exported_agree' ELSE 'methods_disagree' END AS agreement_class FROM (SELECT case_id, any_value(a_id) AS a_id, count(*) FILTER (WHERE exported) AS methods_exported, count(DISTINCT b_id) FILTER (WHERE exported) AS distinct_chosen_b_ids FROM evid GROUP BY 1)", "evid"))
def agreement_class(spark, sf_dir):
    return cases.comparison(evidence(spark, sf_dir))


@query(
    "case_selection",
    with_parts(
        ", fx AS (SELECT a_id, count(*) FILTER (WHERE exported) AS n, count(DISTINCT b_id) FILTER (WHERE exported) AS d, count(*) FILTER (WHERE tier = 'auto_accept') AS acc, bool_or(exported AND top2_gap IS NULL) AS single, coalesce(bool_or(exported AND tier = 'review' AND top2_gap = 0), FALSE) AS tie, coalesce(bool_or(exported AND tier = 'review' AND probability >= accept_min AND top2_gap > 0 AND top2_gap < ambiguity_gap), FALSE) AS demoted, coalesce(bool_or(exported AND tier = 'review' AND top2_gap = ambiguity_gap), FALSE) AS edge FROM evid GROUP BY 1), "
        "tg AS (SELECT a_id, 'agreement_all_accept' AS tag, 6 AS cap FROM fx WHERE n = 3 AND d = 1 AND acc = 3 UNION ALL SELECT a_id, 'method_disagreement', 8 FROM fx WHERE n >= 2 AND d > 1 UNION ALL SELECT a_id, 'ambiguity_tie', 6 FROM fx WHERE tie UNION ALL SELECT a_id, 'ambiguity_demoted', 6 FROM fx WHERE demoted UNION ALL SELECT a_id, 'gap_at_rounded_boundary', 4 FROM fx WHERE edge UNION ALL SELECT a_id, 'single_candidate', 5 FROM fx WHERE single UNION ALL SELECT a_id, 'partial_export', 5 FROM fx WHERE n BETWEEN 1 AND 2), "
        "ch AS (SELECT DISTINCT a_id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY a_id) AS r FROM tg) WHERE r <= cap)\n"
        "SELECT a_id, array_to_string(list_sort(list(tag)), '|') AS tags, CAST(row_number() OVER (ORDER BY a_id) AS INTEGER) AS selection_rank FROM tg WHERE a_id IN (SELECT a_id FROM ch) GROUP BY a_id",
        "evid",
    ).replace("\n, fx AS", ",\nfx AS"),
)
def case_selection(spark, sf_dir):
    return cases.selection(cases.tags(evidence(spark, sf_dir))).withColumn("tags", F.array_join("tags", "|"))


@query("join_inflation", "SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders) AS units_before, count(*) AS rows_after, CAST(sum(o_orderkey) AS BIGINT) AS units_after FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_inflation(spark, sf_dir):
    return cases.join_inflation(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderkey")


# ledger


def ledger_events(spark, sf_dir):
    """A review log made from `events`."""
    n, e = F.col("event_id") % 10, F.col("event_id")
    action = F.when(n < 4, "accept_candidate").when(n < 6, "reject_candidate").when(n < 8, "defer").when(n == 8, "undo").otherwise("reject_candidate")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, sf_dir, "events").select(text("e", e).alias("event_id"), e.alias("seq"), text("s", F.col("user_id") % 3).alias("scenario_id"), (F.col("user_id") % 40).cast("string").alias("a_id"), action.alias("action"), F.when((n < 6) | (n == 9), text("b", e % 7)).alias("b_id"), F.when(n == 8, text("e", e - 1 - e % 4)).alias("reverses_event_id"))


@query("ledger_state", with_parts("SELECT * FROM status", "status"))
def ledger_state(spark, sf_dir):
    return ledger.effective_state(ledger_events(spark, sf_dir)).withColumn("rejected_candidates", F.array_join("rejected_candidates", "|"))


@query("ledger_summary", with_parts(", g AS (SELECT a_id, bool_or(status = 'accepted') AS acc, bool_or(deferred) AS d, bool_or(rejected_candidates <> '') AS r FROM status GROUP BY 1), c AS (SELECT CAST(i AS VARCHAR) AS a_id FROM range(50) AS t(i)), x AS (SELECT c.a_id, coalesce(acc, FALSE) AS acc, coalesce(d, FALSE) AS d, coalesce(r, FALSE) AS r FROM c LEFT JOIN g ON c.a_id = g.a_id)\nSELECT count(*) AS cases, count(*) FILTER (WHERE acc) AS accepted, count(*) FILTER (WHERE NOT acc AND d) AS deferred, count(*) FILTER (WHERE NOT acc AND NOT d AND r) AS rejected_candidate_only, count(*) FILTER (WHERE NOT acc AND NOT d AND NOT r) AS untouched, CAST(NULL AS BIGINT) AS changed_mappings, count(*) FILTER (WHERE NOT acc AND NOT d AND r) AS unresolved_evidence FROM x", "status").replace("\n, g AS", ",\ng AS"))
def ledger_summary(spark, sf_dir):
    return ledger.summary(ledger.effective_state(ledger_events(spark, sf_dir)), spark.range(50).select(F.col("id").cast("string").alias("a_id")))


# profiles


@query("record_profile", with_parts(", s AS (SELECT *, title_norm <> '' AND (title_norm = artist_norm OR title_norm = artist_norm_full) AS st FROM np), k AS (SELECT count(*) AS m FROM np GROUP BY title_norm, artist_norm)\nSELECT count(*) AS total, count(*) FILTER (WHERE title_norm = '') AS empty_title, count(*) FILTER (WHERE artist_norm = '') AS empty_artist, count(*) FILTER (WHERE year IS NULL) AS year_missing, count(*) FILTER (WHERE NOT year BETWEEN 1900 AND 2027) AS year_out_of_range, CAST(min(year) FILTER (WHERE year BETWEEN 1900 AND 2027) AS INTEGER) AS min_year, CAST(max(year) FILTER (WHERE year BETWEEN 1900 AND 2027) AS INTEGER) AS max_year, count(*) FILTER (WHERE is_various_artists) AS various, count(*) FILTER (WHERE st) AS self_titled, count(*) FILTER (WHERE n_qualifiers > 0) AS with_qualifier, (SELECT count(*) FROM k) AS keys, (SELECT count(*) FROM k WHERE m > 1) AS keys_with_duplicates, (SELECT CAST(coalesce(sum(m), 0) AS BIGINT) FROM k WHERE m > 1) AS records_in_duplicate_keys, (SELECT max(m) FROM k) AS largest_key_size FROM s", "np").replace("\n, s AS", ",\ns AS"))
def record_profile(spark, sf_dir):
    return profile.record_profile(N.normalize_frame(decorated(spark, sf_dir)), LAST_YEAR)


@query("decades", "SELECT CAST((1950 + p_size) // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM part WHERE p_size BETWEEN 3 AND 45 GROUP BY 1")
def decades(spark, sf_dir):
    return profile.decades(N.normalize_frame(decorated(spark, sf_dir)), LAST_YEAR)


@query("pair_patterns", with_parts("SELECT t.a_id, t.b_id, CASE WHEN a.title_norm = b.title_norm AND a.artist_norm = b.artist_norm AND a.year = b.year THEN 'identical' WHEN a.title_norm = b.title_norm AND a.artist_norm = b.artist_norm AND a.artist_norm_full <> b.artist_norm_full THEN 'article_position' WHEN a.title_norm = b.title_norm AND a.artist_norm = b.artist_norm THEN 'year_only' WHEN a.is_various_artists <> b.is_various_artists THEN 'various_artists_credit' WHEN a.title_norm || ' ' || a.artist_norm_full = b.title_norm || ' ' || b.artist_norm_full THEN 'case_punct_diacritics' WHEN a.is_self_titled <> b.is_self_titled THEN 'self_titled_vs_named' WHEN a.artist_norm = b.artist_norm AND a.tokens = b.tokens THEN 'title_token_order' WHEN a.artist_norm = b.artist_norm AND a.tokens <> b.tokens AND (list_has_all(a.tokens, b.tokens) OR list_has_all(b.tokens, a.tokens)) THEN 'title_token_subset' WHEN a.title_norm = b.title_norm AND list_sort(list_distinct(string_split(a.artist_norm, ' '))) <> list_sort(list_distinct(string_split(b.artist_norm, ' '))) AND (list_has_all(string_split(a.artist_norm, ' '), string_split(b.artist_norm, ' ')) OR list_has_all(string_split(b.artist_norm, ' '), string_split(a.artist_norm, ' '))) THEN 'artist_credit_join' ELSE 'other' END AS pattern FROM truth t JOIN nr a ON a.native_id = t.a_id JOIN nr b ON b.native_id = t.b_id", "truth", "nr"))
def pair_patterns(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir)
    # SQL names the patterns of normalised names only
    return profile.classified_pairs(catalogue.links(spark, sf_dir), a, b, raw_texts=False)


@query("membership_hashes", "SELECT c_custkey, sha256('c|' || c_custkey) AS membership_hash FROM customer")
def membership_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", membership_hash(F.lit("c"), F.col("c_custkey").cast("string")).alias("membership_hash"))


@query("case_flagship", with_parts("SELECT a_id, b_id, tier, top2_gap FROM dec WHERE method_version = 'exact_v1'", "dec"))
def flagship(spark, sf_dir):
    """Normalise, block, cap, score exactly, decide: the engine's main path, without any Python on the executors."""
    pairs = methods.scored(scored_pairs(spark, sf_dir), methods.exact_score())
    return decide.decide(pairs).select("a_id", "b_id", "tier", "top2_gap")


# single operators on whole tables


@query("pair_hashes", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)) AS pair_hash FROM orders")
def pair_hashes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", pair_hash(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("pair_hash"))


@query("sample_pools", with_parts(f", linked AS (SELECT DISTINCT a_id FROM truth), inside AS (SELECT DISTINCT t.b_id FROM truth t JOIN rec a ON a.native_id = t.a_id WHERE a.primary_type = '{SCOPE}'), every AS (SELECT DISTINCT b_id FROM truth)\nSELECT 'a' AS side, native_id, FALSE AS b_linked_out_of_scope FROM rec WHERE side = 'a' AND primary_type = '{SCOPE}' AND native_id NOT IN (SELECT a_id FROM linked) UNION ALL SELECT 'b', native_id, native_id IN (SELECT b_id FROM every) FROM rec WHERE side = 'b' AND native_id NOT IN (SELECT b_id FROM inside)", "truth", "rec").replace("\n, linked AS", ",\nlinked AS"))
def sample_pools(spark, sf_dir):
    every = catalogue.records(spark, sf_dir)
    a, b = sampling.pools(every.filter("side = 'a'"), every.filter("side = 'b'"), catalogue.links(spark, sf_dir), SCOPE)
    return a.select(F.lit("a").alias("side"), "native_id", F.lit(False).alias("b_linked_out_of_scope")).unionByName(b.select(F.lit("b").alias("side"), "native_id", "b_linked_out_of_scope"))


@query("wild_years", with_parts(f"SELECT count(*) FILTER (WHERE year IS NOT NULL AND NOT year BETWEEN 1900 AND {LAST_YEAR}) AS years_nulled, count(*) FILTER (WHERE year BETWEEN 1900 AND {LAST_YEAR}) AS years_kept FROM parts_", "parts_"))
def wild_years(spark, sf_dir):
    side = decorated(spark, sf_dir)
    kept = sampling.without_wild_years(side, LAST_YEAR).agg(F.count("year").alias("years_kept"))
    return sampling.wild_years(side, LAST_YEAR).crossJoin(kept)  # one row each


@query("published_mapping", with_parts("SELECT a_id, b_id, 'rules_v1' AS method_version, 'f1' AS feature_version, round(probability, 6) AS probability, tier, block_keys, round(top2_gap, 6) AS top2_gap, 'run' AS run_id FROM dec WHERE method_version = 'rules_v1' AND tier <> 'reject'", "dec"))
def published_mapping(spark, sf_dir):
    pairs = methods.scored(scored_pairs(spark, sf_dir), native_scores()["rules_v1"])
    return decide.mapping(decide.decide(pairs), "rules_v1", "f1", "run", "now").drop("score", "fold", "decided_at_utc")


@query("tiers_of_shares", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 >= 0.95 THEN 'auto_accept' WHEN l_discount * 10 >= 0.5 THEN 'review' ELSE 'reject' END AS tier FROM lineitem WHERE l_discount * 10 <= 1")
def tiers_of_shares(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").filter(F.col("l_discount") * 10 <= 1)
    return held.select("l_orderkey", "l_linenumber", "l_partkey", decide.tier_of(F.col("l_discount") * 10).alias("tier"))


COUNTED = O.replayed([(0.95, 0.5, 0.1)])
RATE = lambda n, d: f"round(CAST({n} AS DOUBLE) / nullif({d}, 0), 6)"


@query("policy_metrics", f"SELECT {RATE('labelled_a_reachable', 'labelled_a')} AS pair_completeness_test, {RATE('correct', 'accepted')} AS precision, {RATE('correct', 'labelled_a_reachable')} AS recall_labelled, {RATE('correct + queued_reachable', 'accepted + queued_labelled')} AS precision_or_review, {RATE('correct', 'labelled_a')} AS recall_overall, {RATE('accepted_all', 'test_a')} AS coverage, {RATE('unverified', 'accepted_all')} AS unverified_share, CAST(accepted_all AS DOUBLE) / test_a AS share_accept, CAST(review_all AS DOUBLE) / test_a AS share_review, CAST(rejected_all AS DOUBLE) / test_a AS share_reject, demoted AS decisions_moved_to_review FROM ({COUNTED})")
def policy_metrics(spark, sf_dir):
    """The rates of one policy. They are taken on the driver, from one row of counts."""
    m = evaluate.evaluate(replay_rows(spark, sf_dir), decide.Policy(0.95, 0.5, 0.1))
    row = {"pair_completeness_test": m["pair_completeness_test"], "precision": m["at_auto_accept"]["precision"], "recall_labelled": m["at_auto_accept"]["recall_labelled"], "precision_or_review": m["at_auto_accept_or_review"]["precision"], "recall_overall": m["recall_overall"], "coverage": m["coverage"], "unverified_share": m["unverified_accepts"]["share_of_accepts"], **{f"share_{k}": m["tier_shares"][t] for k, t in (("accept", "auto_accept"), ("review", "review"), ("reject", "reject"))}, "decisions_moved_to_review": m["ambiguity_rule"]["decisions_moved_to_review"]}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'long' if k == 'decisions_moved_to_review' else 'double'}" for k in row))


@query("coverage_all_folds", with_parts("SELECT round(CAST(count(*) FILTER (WHERE tier = 'auto_accept') AS DOUBLE) / (SELECT count(*) FROM rec WHERE side = 'a'), 6) AS coverage_all_folds FROM dec WHERE method_version = 'rules_v1'", "dec", "rec"))
def coverage_all_folds(spark, sf_dir):
    pairs = methods.scored(scored_pairs(spark, sf_dir), native_scores()["rules_v1"])
    value = evaluate.coverage_all_folds(decide.decide(pairs), catalogue.records(spark, sf_dir).filter("side = 'a'"))
    return spark.createDataFrame([(value,)], "coverage_all_folds double")


@query("decision_calibration", with_parts(f"SELECT CAST(b.i AS INTEGER) AS bin_index, count(j.v1) AS n, count(*) FILTER (WHERE j.top1_correct) AS observed FROM range(10) AS b(i) LEFT JOIN (SELECT * FROM rows_ WHERE labelled AND v1 IS NOT NULL) j ON {O.bin_case('j.v1')} = b.i GROUP BY 1", "rows_"))
def decision_calibration(spark, sf_dir):
    bins = evaluate.calibration_bins(evaluate.judged_decisions(replay_rows(spark, sf_dir)))
    return bins.select("bin_index", "n", F.round(F.coalesce(F.col("observed_rate") * F.col("n"), F.lit(0))).cast("long").alias("observed"))


@query("conservation", with_parts("SELECT count(*) AS a_records, count(DISTINCT a_id) AS distinct_a, count(*) FILTER (WHERE n_candidates > 0) AS with_candidates, count(*) FILTER (WHERE n_candidates = 0) AS without_candidates, count(*) FILTER (WHERE labelled) AS labelled_a, count(*) FILTER (WHERE labelled AND truth_reachable) AS labelled_a_reachable FROM rows_", "rows_"))
def conservation(spark, sf_dir):
    got = evaluate.conservation(replay_rows(spark, sf_dir), {})
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


@query("legacy_floors", with_parts(f", f AS (SELECT *, v1 >= 0.95 AND coalesce(v1 - v2 < 0.1::DOUBLE, FALSE) AS moved, labelled AND truth_reachable AS found FROM rows_), t AS (SELECT * FROM (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in FLOORS)}) AS v(floor))\nSELECT floor, count(*) FILTER (WHERE v1 >= floor AND v1 < 0.95) AS queue_floor, count(*) FILTER (WHERE moved) AS queue_ambiguity, count(*) FILTER (WHERE v1 >= floor AND v1 < 0.95 OR moved) AS queue_total, round(CAST(count(*) FILTER (WHERE v1 >= floor AND v1 < 0.95 OR moved) AS DOUBLE) / count(*), 6) AS queue_share_of_test_a, round(CAST(count(*) FILTER (WHERE v1 >= 0.95 AND NOT moved AND labelled AND top1_correct) + count(*) FILTER (WHERE (v1 >= floor AND v1 < 0.95 OR moved) AND found) AS DOUBLE) / nullif(count(*) FILTER (WHERE found), 0), 6) AS recall_with_review FROM f CROSS JOIN t GROUP BY 1", "rows_").replace("\n, f AS", ",\nf AS"))
def legacy_floors(spark, sf_dir):
    points = evaluate.legacy_floors(replay_rows(spark, sf_dir), decide.Policy(0.95, 0.5, 0.1), FLOORS)
    return spark.createDataFrame([tuple(p.values()) for p in points], "floor double, queue_floor long, queue_ambiguity long, queue_total long, queue_share_of_test_a double, recall_with_review double")


@query("sweep_divergence", f"SELECT l.threshold, l.accepts AS accepts_legacy, c.accepted_all AS accepts_corrected, c.accepted_all - l.accepts AS difference FROM ({ORACLES['legacy_sweep']}) l JOIN ({ORACLES['accept_sweep']}) c ON l.threshold = c.accept_min WHERE c.accepted_all <> l.accepts")
def sweep_divergence(spark, sf_dir):
    rows = cut(replay_rows(spark, sf_dir))  # used twice
    return evaluate.divergence(decide.legacy_sweep(rows, decide.Policy(0.95, 0.5, 0.1), list(SWEPT)), evaluate.accept_sweep(rows, 0.5, 0.1, SWEPT))


@query("review_costs", f"SELECT accept_min AS threshold, r.cost_ratio, accepted_all AS accepts, review_all AS review_queue, CASE WHEN accepted > 0 THEN accepted_all * (1 - CAST(correct AS DOUBLE) / accepted) END AS expected_false_accepts, review_all + CASE WHEN accepted > 0 THEN accepted_all * (1 - CAST(correct AS DOUBLE) / accepted) END * r.cost_ratio AS total_cost FROM ({ORACLES['accept_sweep']}) CROSS JOIN (VALUES (1), (5), (20)) AS r(cost_ratio)")
def review_costs(spark, sf_dir):
    return evaluate.review_costs(evaluate.accept_sweep(replay_rows(spark, sf_dir), 0.5, 0.1, SWEPT))


@query("anomaly_examples", with_parts(f", ts AS ({TRUTH_STATUS}), h AS (SELECT status, sha256(a_id || '|' || b_id) AS pair_hash FROM ts WHERE status <> 'truth_in_sample')\nSELECT status, pair_hash FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY pair_hash) AS rn FROM h) WHERE rn <= 20", "truth", "rec").replace("\n, ts AS", ",\nts AS"))
def anomaly_examples(spark, sf_dir):
    return sampling.anomaly_examples(classified(spark, sf_dir))


@query("ledger_consequences", with_parts("SELECT s.scenario_id, s.a_id, CASE WHEN s.accepted_b_id IS NOT NULL AND CAST(s.a_id AS INTEGER) % 3 = 2 THEN 'new_mapping' WHEN s.accepted_b_id = 'b' || (CAST(s.a_id AS INTEGER) % 7) THEN 'confirmed' WHEN s.accepted_b_id IS NOT NULL THEN 'changed' WHEN CAST(s.a_id AS INTEGER) % 3 <> 2 AND list_contains(string_split(s.rejected_candidates, '|'), 'b' || (CAST(s.a_id AS INTEGER) % 7)) THEN 'withdrawn' WHEN s.deferred THEN 'deferred' ELSE 'unchanged' END AS consequence FROM status s", "status"))
def ledger_consequences(spark, sf_dir):
    a = F.col("id").cast("int")
    baseline = spark.range(40).filter("id % 3 <> 2").select(a.cast("string").alias("a_id"), F.concat(F.lit("b"), (a % 7).cast("string")).alias("b_id"))
    return ledger.consequences(ledger.effective_state(ledger_events(spark, sf_dir)), baseline)


@query("ledger_problems", "WITH e AS (SELECT event_id, event_id - 1 - event_id % 4 AS target, user_id % 3 AS s, user_id % 40 AS a, event_id % 10 AS n FROM events) SELECT problem, count(*) AS n FROM (SELECT 'an undo targets another case' AS problem FROM e u JOIN e t ON u.target = t.event_id WHERE u.n = 8 AND (u.s <> t.s OR u.a <> t.a) UNION ALL SELECT 'an undo targets an undo' FROM e u JOIN e t ON u.target = t.event_id WHERE u.n = 8 AND t.n = 8 UNION ALL SELECT 'an undo does not name an earlier event' FROM e u LEFT JOIN e t ON u.target = t.event_id WHERE u.n = 8 AND t.event_id IS NULL) GROUP BY 1")
def ledger_problems(spark, sf_dir):
    """Of the checks of a log, those whose findings SQL can count."""
    text = F.lit(None).cast("string")
    events = ledger_events(spark, sf_dir).withColumns({"snapshot_id": F.lit("s"), "supersedes_event_id": text})
    wanted = ("an undo targets another case", "an undo targets an undo", "an undo does not name an earlier event")
    return ledger.problems(events, "s", superseding=False).filter(F.col("problem").isin(*wanted)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("several_accepts", "SELECT CAST(l_orderkey AS VARCHAR) AS a_id, l_returnflag AS method_version, count(*) AS accepts FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1, 2 HAVING count(*) > 1")
def several_accepts(spark, sf_dir):
    mapping = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("a_id"), F.col("l_returnflag").alias("method_version"), F.when(F.col("l_discount") >= 0.05, "auto_accept").otherwise("review").alias("tier"))
    return assertions.several_accepts(mapping)


@query("flattened_items", "SELECT CAST(l_orderkey AS VARCHAR) AS item, min(year(l_shipdate))::INTEGER AS year, min(l_returnflag) AS class, array_to_string(list_sort(list_distinct(list('s' || l_suppkey))), '; ') AS performers FROM lineitem GROUP BY 1")
def flattened_items(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("item"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("class"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("performer"))
    return dumps.flattened_items(claims)


def dump_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The tables of a dump, in the shapes of its readers, made from orders, customers, suppliers and lineitem."""
    text = lambda c: F.col(c).cast("string")
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return {
        "release_group": o.select(text("o_orderkey").alias("id"), F.concat(F.lit("g"), text("o_orderkey")).alias("gid"), F.col("o_orderpriority").alias("name"), text("o_custkey").alias("artist_credit"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 25).cast("string")).alias("type")),
        "artist_credit": table(spark, sf_dir, "customer").filter("c_custkey % 4 > 0").select(text("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "release_group_primary_type": table(spark, sf_dir, "nation").select(text("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "release": line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), text("l_orderkey").alias("release_group")).distinct(),
        "release_country": line.filter("l_linenumber % 2 = 0").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("release"), F.when(F.col("l_linenumber") < 4, F.year("l_shipdate").cast("string")).otherwise("x").alias("date_year")),
        "release_unknown_country": line.filter("l_linenumber % 2 = 1").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("release"), F.when(F.col("l_linenumber") < 3, "0").otherwise(F.year("l_shipdate").cast("string")).alias("date_year")),
        "l_release_group_url": o.filter("o_orderkey % 3 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("2").alias("link"), text("o_orderkey").alias("entity0"), (F.col("o_custkey") % 50).cast("string").alias("entity1")),
        "url": spark.range(50).select(F.col("id").cast("string").alias("id"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("https://www.discogs.com/master/")).otherwise(F.lit("https://www.discogs.com/artist/")), F.col("id").cast("string")).alias("url")),
        "link": spark.createDataFrame([("1", "10"), ("2", "11")], "id string, link_type string"),
        "link_type": spark.createDataFrame([("10", "discogs")], "id string, name string"),
    }


@query("dump_release_groups", "WITH y AS (SELECT l_orderkey, min(CASE WHEN l_linenumber % 2 = 0 AND l_linenumber < 4 OR l_linenumber % 2 = 1 AND l_linenumber >= 3 THEN year(l_shipdate) END) AS y FROM lineitem GROUP BY 1) SELECT 'a' AS source, 'g' || o_orderkey AS native_id, o_orderpriority AS title, coalesce(c.c_name, '') AS artist_credit, CAST(y.y AS INTEGER) AS year, n.n_name AS primary_type, CAST(CASE WHEN o_orderkey % 3 = 0 AND (o_custkey % 50) % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_links FROM orders LEFT JOIN y ON y.l_orderkey = o_orderkey LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_custkey % 4 > 0 LEFT JOIN nation n ON n.n_nationkey = o_orderkey % 25 AND o_orderkey % 5 > 0")
def dump_release_groups(spark, sf_dir):
    return dumps.release_groups(dump_tables(spark, sf_dir))


@query("dump_links", "SELECT 'g' || o_orderkey AS a_id, CAST(o_custkey % 50 AS VARCHAR) AS b_id, CASE WHEN o_orderkey % 2 = 0 THEN 'discogs' END AS link_type FROM orders WHERE o_orderkey % 3 = 0 AND (o_custkey % 50) % 2 = 0")
def dump_links(spark, sf_dir):
    return dumps.master_links(dump_tables(spark, sf_dir))


@query("links_extras", "WITH l AS (SELECT 'g' || o_orderkey AS a_id, CAST(o_custkey % 50 AS VARCHAR) AS b_id, CASE WHEN o_orderkey % 2 = 0 THEN 'discogs' ELSE 'none' END AS t FROM orders WHERE o_orderkey % 3 = 0 AND (o_custkey % 50) % 2 = 0), d AS (SELECT DISTINCT a_id, b_id FROM l) SELECT 'link_type' AS measure, t AS value, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'distinct', 'links', count(*) FROM d UNION ALL SELECT 'dead', 'b', count(*) FROM d WHERE CAST(b_id AS INTEGER) >= 25 UNION ALL SELECT 'dead', 'a', count(*) FROM d WHERE a_id NOT IN (SELECT 'g' || o_orderkey FROM orders) UNION ALL SELECT 'several', 'a', count(*) FROM (SELECT a_id FROM d GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'several', 'b', count(*) FROM (SELECT b_id FROM d GROUP BY 1 HAVING count(*) > 1)")
def links_extras(spark, sf_dir):
    tables = dump_tables(spark, sf_dir)
    masters = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("native_id"))
    return profile.links_extras(dumps.master_links(tables), dumps.release_groups(tables), masters)


# blocking with the phonetic key, which SQL cannot express: these are held against a brute-force form


@query("block_keys_phonetic")
def block_keys_phonetic(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir, phonetic=True)
    return blocking.key_frame(a).withColumn("side", F.lit("a")).unionByName(blocking.key_frame(b).withColumn("side", F.lit("b")))


@query("block_candidates_phonetic")
def block_candidates_phonetic(spark, sf_dir):
    a, b = catalogue.sides(spark, sf_dir, phonetic=True)
    return blocking.candidates(a, b, CAP).withColumn("block_keys", F.array_join("block_keys", "|"))


@query("pair_completeness_phonetic")
def pair_completeness_phonetic(spark, sf_dir):
    return completeness(spark, sf_dir, phonetic=True)


QUERIES |= marts.QUERIES
ORACLES |= marts.ORACLES
