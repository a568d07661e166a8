"""The registered queries' SQL for DuckDB, put together from shared common table expressions."""

from __future__ import annotations

from weftline.functions.hashing import WORD_WEIGHTS
from weftline.functions.normalize import ARTICLES, QUALIFIERS
from weftline.operators.blocking import CAP
from weftline.operators.evaluate import BIN_EDGES

SCOPE = "en"


def basic(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(strip_accents({t})), 'ß', 'ss'), 'ς', 'σ'), '&', ' and '), '[''’‘ʼ]', '', 'g'), '[\p{{P}}\p{{S}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


ARTICLE = "|".join(ARTICLES)
QUALIFIED = rf"(?i)\s*[(\[](?:[^()\[\]]*[^()\[\]\w])?(?:{'|'.join(QUALIFIERS)})(?:[^()\[\]\w][^()\[\]]*)?[)\]]"


def various(c: str) -> str:
    return f"(lower(trim({c})) IN ('various', 'various artists', 'va', 'v/a') OR {basic(c)} IN ('various', 'various artists', 'va', 'v a'))"


def artist_full(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace({c}, '\s*\(\d+\)', '', 'g'), '(?i)^(.+?),\s*({ARTICLE})\s*$', '\2 \1')"
    return f"CASE WHEN {various(c)} THEN 'various' ELSE {basic(bare)} END"


def artist(c: str) -> str:
    return rf"CASE WHEN {various(c)} THEN 'various' ELSE regexp_replace({artist_full(c)}, '^(?:{ARTICLE}) (.)', '\1') END"


def title(t: str) -> str:
    return basic(f"regexp_replace(strip_accents({t}), '{QUALIFIED}', '', 'g')")


def normalized(source: str) -> str:
    return f"""SELECT *, {title("title")} AS title_norm, {basic("title")} AS title_norm_full, {artist("artist_credit")} AS artist_norm, {artist_full("artist_credit")} AS artist_norm_full,
    {various("artist_credit")} AS is_various_artists, len(regexp_extract_all(strip_accents(title), '{QUALIFIED}')) AS n_qualifiers, list_transform(regexp_extract_all(strip_accents(title), '{QUALIFIED}'), lambda q: {basic("q")}) AS quals FROM {source}"""


def bucket(x: str) -> str:
    return "(" + " + ".join(f"CAST(('0x' || substr(sha256({x}), {8 * i + 1}, 8)) AS UBIGINT) % 100 * {w}" for i, w in enumerate(WORD_WEIGHTS)) + ") % 100"


def fold(x: str) -> str:
    return f"CASE WHEN {bucket(x)} < 60 THEN 'fit' WHEN {bucket(x)} < 80 THEN 'calibrate' ELSE 'test' END"


def lcs(a: str, b: str) -> str:
    """The length of the longest common subsequence: the rows of the dynamic programme, one for each character of b."""
    zeros, rows = f"[list_transform(string_split({a}, ''), lambda x: 0)]", f"list_transform(string_split({b}, ''), lambda c: list_transform(string_split({a}, ''), lambda x: CAST(x = c AS INTEGER)))"
    step = f"lambda acc, m: list_transform(range(1, length({a}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k], coalesce(acc[k - 1], 0) + m[k]))))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN length({a}) ELSE list_reduce(list_concat({zeros}, {rows}), {step})[-1] END"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def in_order(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100::DOUBLE ELSE 200::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def renamed(x: str) -> str:
    """DuckDB's Jaro-Winkler compares bytes: the letters beyond ASCII that normalised names have here are renamed, one for one, to capitals, which they have not."""
    return f"translate({x}, 'đелкаиαθην', 'ABCDEFGHIJ')"


def jaro_winkler(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN CAST({a} = {b} AS DOUBLE) ELSE jaro_winkler_similarity({renamed(a)}, {renamed(b)}) END"


def single(x: str, by: int = 100) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE) / {by}"


# every expression by name, with those it needs
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "w": (r"SELECT doc_id, lang, n_chars, doc_id // 2 AS n, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents", ()),
    "rec": (
        "SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, CAST(doc_id AS VARCHAR) AS native_id, "
        "CASE WHEN n % 13 = 4 AND n % 17 <> 3 AND n % 17 <> 5 THEN cr WHEN n % 11 = 2 THEN ti || ' [Deluxe Edition]' WHEN n % 11 = 6 THEN 'Ёлка й ' || ti WHEN n % 11 = 8 THEN 'Ἀθήνα ' || ti ELSE ti END AS title, "
        "CASE WHEN n % 17 = 3 THEN 'Various Artists' WHEN n % 17 = 5 THEN 'V/A' WHEN n % 7 = 1 THEN cr || ', The' WHEN n % 7 = 2 THEN 'The ' || cr || ' (2)' WHEN n % 7 = 4 THEN 'Đặng ' || cr ELSE cr END AS artist_credit, "
        "CAST(1900 + (n_chars // 25) % 120 AS INTEGER) AS year, lang AS primary_type, CASE WHEN len(w) >= 20 THEN coalesce(lang, '') || '|' || array_to_string(w[9:20], ' ') END AS truth_key "
        "FROM (SELECT *, array_to_string(w[1:6], ' ') AS ti, array_to_string(w[7:8], ' ') AS cr FROM w)",
        ("w",),
    ),
    "nr0": (normalized("rec"), ("rec",)),
    "nr": ("SELECT *, list_sort(list_distinct(list_filter(string_split(title_norm, ' '), lambda x: x <> ''))) AS tokens, title_norm <> '' AND (title_norm = artist_norm OR title_norm = artist_norm_full) AS is_self_titled FROM nr0", ("nr0",)),
    "firsts": ("SELECT truth_key, min(native_id) FILTER (WHERE side = 'a') AS first_a, min(native_id) FILTER (WHERE side = 'b') AS first_b FROM rec WHERE truth_key IS NOT NULL GROUP BY 1", ("rec",)),
    "truth": ("SELECT r.native_id AS a_id, f.first_b AS b_id FROM rec r JOIN firsts f ON r.truth_key = f.truth_key WHERE r.side = 'a' AND f.first_b IS NOT NULL UNION SELECT f.first_a, r.native_id FROM rec r JOIN firsts f ON r.truth_key = f.truth_key WHERE r.side = 'b' AND f.first_a IS NOT NULL", ("rec", "firsts")),
    "keys": (
        "SELECT side, native_id, 'k_title3' AS key_type, array_to_string(string_split(title_norm, ' ')[1:3], ' ') AS key FROM nr WHERE title_norm <> '' "
        "UNION ALL SELECT side, native_id, 'k_title_sorted', substr(sha256(array_to_string(tokens, ' ')), 1, 16) FROM nr WHERE title_norm <> '' "
        "UNION ALL SELECT side, native_id, 'k_artist_year', artist_norm || '|' || CAST(year + d AS VARCHAR) FROM nr, (VALUES (-1), (0), (1)) AS t(d) WHERE NOT is_various_artists AND artist_norm <> '' "
        "UNION ALL SELECT side, native_id, 'k_self_titled', artist_norm FROM nr WHERE NOT is_various_artists AND artist_norm <> '' AND is_self_titled",
        ("nr",),
    ),
    "pk": ("SELECT DISTINCT a.native_id AS a_id, b.native_id AS b_id, a.key_type FROM keys a JOIN keys b ON a.side = 'a' AND b.side = 'b' AND a.key_type = b.key_type AND a.key = b.key", ("keys",)),
    "up": ("SELECT a_id, b_id, array_to_string(list_sort(list(key_type)), '|') AS block_keys, CAST(count(*) AS INTEGER) AS n_block_keys FROM pk GROUP BY 1, 2", ("pk",)),
    "cand": (f"SELECT a_id, b_id, block_keys, n_block_keys FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY n_block_keys DESC, b_id) AS rn FROM up) WHERE rn <= {CAP}", ("up",)),
    "feat": (
        "SELECT c.a_id, c.b_id, c.block_keys, CAST(a.artist_norm_full = b.artist_norm_full AS INTEGER) AS artist_full_exact, CAST(a.title_norm = b.title_norm AS INTEGER) AS title_exact_norm, abs(a.year - b.year) AS year_diff, "
        "CAST(a.year IS NULL OR b.year IS NULL AS INTEGER) AS year_either_missing, CAST(a.is_various_artists AND b.is_various_artists AS INTEGER) AS both_va, CAST(abs(length(a.title_norm) - length(b.title_norm)) AS INTEGER) AS title_len_diff, c.n_block_keys, CAST(list_sort(list_distinct(a.quals)) <> list_sort(list_distinct(b.quals)) AS INTEGER) AS qualifier_mismatch "
        "FROM cand c JOIN nr a ON c.a_id = a.native_id JOIN nr b ON c.b_id = b.native_id",
        ("cand", "nr"),
    ),
    "texts": ("SELECT DISTINCT x, y FROM (SELECT a.title_norm AS x, b.title_norm AS y FROM cand c JOIN nr a ON c.a_id = a.native_id JOIN nr b ON c.b_id = b.native_id UNION ALL SELECT a.artist_norm, b.artist_norm FROM cand c JOIN nr a ON c.a_id = a.native_id JOIN nr b ON c.b_id = b.native_id)", ("cand", "nr")),
    "shapes": (
        f"SELECT *, {in_order(words('x'))} AS xo, {in_order(words('y'))} AS yo, list_distinct({words('x')}) AS xs, list_distinct({words('y')}) AS ys, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS sh, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS lo FROM texts",
        ("texts",),
    ),
    # each window of the longer text, and for texts of one length each window of either
    "windows": (
        "SELECT x, y, sh AS p, substr(lo, greatest(0, s) + 1, least(length(lo), s + length(sh)) - greatest(0, s)) AS q FROM (SELECT *, unnest(range(1 - length(sh), length(lo))) AS s FROM shapes WHERE sh <> '' AND sh <> lo) "
        "UNION ALL SELECT x, y, lo, substr(sh, greatest(0, s) + 1, least(length(sh), s + length(lo)) - greatest(0, s)) FROM (SELECT *, unnest(range(1 - length(lo), length(sh))) AS s FROM shapes WHERE sh <> '' AND sh <> lo AND length(sh) = length(lo))",
        ("shapes",),
    ),
    "partials": (f"SELECT x, y, max(200::DOUBLE * ({lcs('p', 'q')}) / (length(p) + length(q))) AS v FROM windows GROUP BY 1, 2", ("windows",)),
    "sets": (
        f"SELECT x, y, xs, ys, list_intersect(xs, ys) AS common, {in_order('list_filter(xs, lambda w: NOT list_contains(ys, w))')} AS xr, {in_order('list_filter(ys, lambda w: NOT list_contains(xs, w))')} AS yr, length(array_to_string(list_intersect(xs, ys), ' ')) AS sb FROM shapes",
        ("shapes",),
    ),
    "set_parts": (f"SELECT *, sb + CAST(sb > 0 AND xr <> '' AS INTEGER) + length(xr) AS nx, sb + CAST(sb > 0 AND yr <> '' AS INTEGER) + length(yr) AS ny, length(xr) + length(yr) - 2 * ({lcs('xr', 'yr')}) AS apart FROM sets", ("sets",)),
    "set_ratios": (
        "SELECT x, y, CASE WHEN len(xs) = 0 OR len(ys) = 0 THEN 0::DOUBLE WHEN len(common) > 0 AND (xr = '' OR yr = '') THEN 100::DOUBLE ELSE greatest(CASE WHEN nx + ny > 0 THEN 100 * (1 - apart::DOUBLE / (nx + ny)) ELSE 100 END, "
        "CASE WHEN sb > 0 THEN 100 * (1 - (nx - sb)::DOUBLE / (sb + nx)) ELSE 0 END, CASE WHEN sb > 0 THEN 100 * (1 - (ny - sb)::DOUBLE / (sb + ny)) ELSE 0 END) END AS v FROM set_parts",
        ("set_parts",),
    ),
    "alike": (
        f"SELECT s.x, s.y, {single(ratio('s.x', 's.y'))} AS ratio, {single('CASE WHEN s.x = s.y THEN 100 ELSE coalesce(p.v, 0) END')} AS partial, {single(ratio('s.xo', 's.yo'))} AS token_sort, {single('t.v')} AS token_set, {single(jaro_winkler('s.x', 's.y'), 1)} AS jw "
        "FROM shapes s LEFT JOIN partials p ON p.x = s.x AND p.y = s.y JOIN set_ratios t ON t.x = s.x AND t.y = s.y",
        ("shapes", "partials", "set_ratios"),
    ),
    "fuzzy": (
        "SELECT f.a_id, f.b_id, f.block_keys, t.ratio AS title_ratio, t.partial AS title_partial, t.token_sort AS title_token_sort, t.token_set AS title_token_set, t.jw AS title_jw, r.ratio AS artist_ratio, r.token_set AS artist_token_set, r.jw AS artist_jw, "
        "f.artist_full_exact, f.title_exact_norm, f.year_diff, f.year_either_missing, f.both_va, f.title_len_diff, f.n_block_keys, f.qualifier_mismatch "
        "FROM feat f JOIN nr a ON f.a_id = a.native_id JOIN nr b ON f.b_id = b.native_id JOIN alike t ON t.x = a.title_norm AND t.y = b.title_norm JOIN alike r ON r.x = a.artist_norm AND r.y = b.artist_norm",
        ("feat", "nr", "alike"),
    ),
    "fuzzy_scores": ("SELECT a_id, b_id, block_keys, 0.45::DOUBLE * title_token_set + 0.35::DOUBLE * artist_token_set + 0.2::DOUBLE * CASE WHEN year_diff IS NULL THEN 0.25::DOUBLE WHEN year_diff = 0 THEN 1::DOUBLE WHEN year_diff = 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS probability FROM fuzzy", ("fuzzy",)),
    "agree": ("SELECT *, CASE WHEN year_diff IS NULL THEN 0.25::DOUBLE WHEN year_diff = 0 THEN 1::DOUBLE WHEN year_diff = 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS ya FROM feat", ("feat",)),
    "sc": (
        "SELECT a_id, b_id, block_keys, 'exact_v1' AS method_version, CASE WHEN title_exact_norm = 1 AND artist_full_exact = 1 AND coalesce(year_diff, 0) = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS probability FROM agree "
        "UNION ALL SELECT a_id, b_id, block_keys, 'rules_v1', 0.45::DOUBLE * title_exact_norm + 0.35::DOUBLE * artist_full_exact + 0.2::DOUBLE * ya FROM agree "
        "UNION ALL SELECT a_id, b_id, block_keys, 'names_v1', 0.6::DOUBLE * title_exact_norm + 0.4::DOUBLE * artist_full_exact FROM agree",
        ("agree",),
    ),
    "rk": ("SELECT *, row_number() OVER w AS rn, lead(probability) OVER w AS v2 FROM sc WINDOW w AS (PARTITION BY method_version, a_id ORDER BY probability DESC, b_id)", ("sc",)),
    "dec0": ("SELECT method_version, a_id, b_id, block_keys, probability, v2, probability - v2 AS gap, CASE WHEN probability >= 0.95 THEN 'auto_accept' WHEN probability >= 0.5 THEN 'review' ELSE 'reject' END AS base FROM rk WHERE rn = 1", ("rk",)),
    "dec": ("SELECT method_version, a_id, b_id, block_keys, probability, gap AS top2_gap, CASE WHEN base <> 'reject' AND coalesce(gap < 0.1::DOUBLE, FALSE) THEN 'review' ELSE base END AS tier, base <> 'reject' AND coalesce(gap < 0.1::DOUBLE, FALSE) AND probability >= 0.95 AS ambiguity_review FROM dec0", ("dec0",)),
    "test_a": (f"SELECT native_id AS a_id FROM nr WHERE side = 'a' AND {fold('native_id')} = 'test'", ("nr",)),
    "hits": ("SELECT s.*, t.a_id IS NOT NULL AS hit FROM sc s LEFT JOIN truth t ON s.a_id = t.a_id AND s.b_id = t.b_id WHERE method_version = 'rules_v1'", ("sc", "truth")),
    "per": ("SELECT a_id, CAST(count(*) AS INTEGER) AS n, bool_or(hit) AS reach FROM hits GROUP BY 1", ("hits",)),
    "best": ("SELECT *, row_number() OVER w AS rn, lead(probability) OVER w AS v2 FROM hits WINDOW w AS (PARTITION BY a_id ORDER BY probability DESC, b_id)", ("hits",)),
    "rows_": (
        "SELECT p.a_id, b.b_id, b.probability AS v1, b.v2, coalesce(per.n, 0) AS n_candidates, l.a_id IS NOT NULL AS labelled, CASE WHEN l.a_id IS NOT NULL AND b.probability IS NOT NULL THEN b.hit END AS top1_correct, "
        "CASE WHEN l.a_id IS NOT NULL THEN coalesce(per.reach, FALSE) END AS truth_reachable FROM test_a p LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON p.a_id = b.a_id LEFT JOIN per ON p.a_id = per.a_id LEFT JOIN (SELECT DISTINCT a_id FROM truth) l ON p.a_id = l.a_id",
        ("test_a", "best", "per", "truth"),
    ),
    "parts_": (
        "SELECT CAST(p_partkey AS VARCHAR) AS native_id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' [Deluxe Edition]' WHEN 1 THEN p_name || ' (Live) (2001 Remaster)' WHEN 2 THEN upper(p_name) || ' & Co.' WHEN 3 THEN 'Élan ' || p_name ELSE p_name END AS title, "
        "CASE p_partkey % 6 WHEN 0 THEN p_brand || ', The' WHEN 1 THEN 'The ' || p_brand || ' (2)' WHEN 2 THEN 'Various' WHEN 3 THEN 'V/A' WHEN 4 THEN 'Los ' || p_type ELSE p_brand END AS artist_credit, "
        "CASE WHEN p_size > 45 THEN NULL WHEN p_size < 3 THEN 1800 + p_size ELSE 1950 + p_size END AS year FROM part",
        (),
    ),
    "np": (normalized("parts_"), ("parts_",)),
    "ev": (
        "SELECT 'e' || event_id AS event_id, event_id AS seq, 's' || (user_id % 3) AS scenario_id, CAST(user_id % 40 AS VARCHAR) AS a_id, CASE WHEN event_id % 10 < 4 THEN 'accept_candidate' WHEN event_id % 10 < 6 THEN 'reject_candidate' WHEN event_id % 10 < 8 THEN 'defer' WHEN event_id % 10 = 8 THEN 'undo' ELSE 'reject_candidate' END AS action, "
        "CASE WHEN event_id % 10 < 6 OR event_id % 10 = 9 THEN 'b' || (event_id % 7) END AS b_id, CASE WHEN event_id % 10 = 8 THEN 'e' || (event_id - 1 - event_id % 4) END AS reverses_event_id FROM events",
        (),
    ),
    "live": ("SELECT * FROM ev WHERE action <> 'undo' AND event_id NOT IN (SELECT reverses_event_id FROM ev WHERE reverses_event_id IS NOT NULL)", ("ev",)),
    "st0": ("SELECT scenario_id, a_id, max(CASE WHEN action = 'accept_candidate' THEN seq END) AS acc_seq, max(CASE WHEN action = 'defer' THEN seq END) AS defer_seq, list_sort(list_distinct(list(b_id) FILTER (WHERE action = 'reject_candidate'))) AS rejected FROM live GROUP BY 1, 2", ("live",)),
    "st": (
        "SELECT s.scenario_id, s.a_id, CASE WHEN x.seq IS NULL THEN a.b_id END AS accepted_b_id, CASE WHEN x.seq IS NULL THEN a.event_id END AS accepted_event_id, s.defer_seq IS NOT NULL AND (s.acc_seq IS NULL OR s.defer_seq > s.acc_seq) AS deferred, coalesce(array_to_string(s.rejected, '|'), '') AS rejected_candidates "
        "FROM st0 s LEFT JOIN live a ON a.seq = s.acc_seq LEFT JOIN (SELECT l.scenario_id, l.a_id, max(l.seq) AS seq FROM live l JOIN st0 t ON l.scenario_id = t.scenario_id AND l.a_id = t.a_id JOIN live b ON b.seq = t.acc_seq WHERE l.action = 'reject_candidate' AND l.b_id = b.b_id AND l.seq > t.acc_seq GROUP BY 1, 2) x ON x.scenario_id = s.scenario_id AND x.a_id = s.a_id",
        ("st0", "live"),
    ),
    "status": ("SELECT *, CASE WHEN accepted_b_id IS NOT NULL THEN 'accepted' WHEN deferred THEN 'deferred' WHEN rejected_candidates <> '' THEN 'rejected_candidates' ELSE 'none' END AS status FROM st", ("st",)),
    "map_": ("SELECT a_id, method_version, b_id, probability AS score, probability, tier, top2_gap, block_keys FROM dec WHERE tier <> 'reject'", ("dec",)),
    "meth": ("SELECT * FROM (VALUES ('exact_v1', 0.95::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE), ('rules_v1', 0.95::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE), ('names_v1', 0.95::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE)) AS t(method_version, accept_min, review_min, ambiguity_gap)", ()),
    "evid0": ("SELECT 'case-' || c.a_id AS case_id, c.a_id, m.*, p.b_id, p.score, p.probability, p.tier, p.top2_gap, p.b_id IS NOT NULL AS exported FROM (SELECT DISTINCT a_id FROM cand) c CROSS JOIN meth m LEFT JOIN map_ p ON p.a_id = c.a_id AND p.method_version = m.method_version", ("cand", "meth", "map_")),
    "evid": (
        "SELECT *, CASE WHEN NOT exported THEN NULL WHEN top2_gap IS NULL THEN 'single_candidate' ELSE 'exported' END AS gap_state, CASE WHEN NOT exported OR top2_gap IS NULL THEN NULL ELSE tier = 'review' AND probability >= accept_min AND top2_gap < ambiguity_gap END AS ambiguity_demoted_derived, "
        "CASE WHEN NOT exported OR top2_gap IS NULL THEN NULL ELSE top2_gap = ambiguity_gap END AS gap_at_rounded_boundary FROM evid0",
        ("evid0",),
    ),
    "long": (
        "SELECT method_version, 'decided' AS metric, CAST(count(*) AS DOUBLE) AS value FROM dec GROUP BY 1 UNION ALL SELECT method_version, 'accepted', CAST(count(*) FILTER (WHERE tier = 'auto_accept') AS DOUBLE) FROM dec GROUP BY 1 "
        "UNION ALL SELECT method_version, 'queued', CAST(count(*) FILTER (WHERE tier = 'review') AS DOUBLE) FROM dec GROUP BY 1 UNION ALL SELECT method_version, 'demoted', CAST(count(*) FILTER (WHERE ambiguity_review) AS DOUBLE) FROM dec GROUP BY 1",
        ("dec",),
    ),
}


def with_parts(select: str, *names: str) -> str:
    """A statement with the expressions it names, and what these need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in PARTS[name][1]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS ({PARTS[n][0]})" for n in order) + "\n" if order else "") + select


REPLAYED = """SELECT policy_id, accept_min, review_min, ambiguity_gap, CAST(count(*) AS BIGINT) AS test_a, count(*) FILTER (WHERE labelled) AS labelled_a, count(*) FILTER (WHERE labelled AND truth_reachable) AS labelled_a_reachable,
count(*) FILTER (WHERE v1 IS NULL) AS no_candidate_a, count(*) FILTER (WHERE tier = 'auto_accept' AND labelled) AS accepted, count(*) FILTER (WHERE tier = 'auto_accept' AND labelled AND top1_correct) AS correct,
count(*) FILTER (WHERE tier = 'review' AND labelled) AS queued_labelled, count(*) FILTER (WHERE tier = 'review' AND labelled AND truth_reachable) AS queued_reachable, count(*) FILTER (WHERE tier = 'auto_accept') AS accepted_all,
count(*) FILTER (WHERE tier = 'review') AS review_all, count(*) FILTER (WHERE tier = 'reject') AS rejected_all, count(*) FILTER (WHERE tier = 'auto_accept' AND NOT labelled) AS unverified, count(*) FILTER (WHERE unclear AND v1 >= accept_min) AS demoted, count(*) FILTER (WHERE unclear) AS ambiguous
FROM (SELECT *, CASE WHEN v1 IS NULL THEN 'reject' WHEN unclear THEN 'review' ELSE base END AS tier FROM (SELECT *, base <> 'reject' AND v1 IS NOT NULL AND coalesce(v1 - v2 < ambiguity_gap, FALSE) AS unclear FROM (SELECT *, CASE WHEN v1 >= accept_min THEN 'auto_accept' WHEN v1 >= review_min THEN 'review' ELSE 'reject' END AS base FROM rows_ CROSS JOIN (VALUES POLICIES) AS p(policy_id, accept_min, review_min, ambiguity_gap))))
GROUP BY 1, 2, 3, 4"""


def replayed(policies: list[tuple[float, float, float]]) -> str:
    values = ", ".join(f"({i}, {a!r}::DOUBLE, {r!r}::DOUBLE, {g!r}::DOUBLE)" for i, (a, r, g) in enumerate(policies))
    return with_parts(REPLAYED.replace("POLICIES", values), "rows_")


def bin_case(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} < {e!r}::DOUBLE THEN {i}" for i, e in enumerate(BIN_EDGES)) + " ELSE 9 END"


def metric_pivot(names: tuple[str, ...]) -> str:
    return "SELECT method_version, " + ", ".join(f"CAST(max(CASE WHEN metric = '{m}' THEN value END) AS BIGINT) AS {m}" for m in names) + " FROM long GROUP BY 1"
