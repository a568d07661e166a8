"""Profiles of a catalogue and of its true pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.hashing import pair_hash
from weftline.functions.normalize import basic, strip_disambiguator

# How a true pair's names differ, in the order in which a pattern wins.
PATTERNS = ("identical", "edition_qualifier", "article_position", "numeric_disambiguator", "year_only", "various_artists_credit", "ampersand_vs_and", "case_punct_diacritics", "self_titled_vs_named", "title_token_order", "title_token_subset", "artist_credit_join", "other")
#: Those that normalised names cannot tell.
FROM_RAW = ("edition_qualifier", "numeric_disambiguator", "ampersand_vs_and")


def record_profile(side: DataFrame, last_year: int, first_year: int = 1900) -> DataFrame:
    """One row of counts: completeness, years, shares and duplicate keys."""
    year = F.col("year_norm")
    ranged = year.between(first_year, last_year)
    facts = side.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("title_norm") == "").alias("empty_title"),
        F.count_if(F.col("artist_norm") == "").alias("empty_artist"),
        F.count_if(year.isNull()).alias("year_missing"),
        F.count_if(~ranged).alias("year_out_of_range"),
        F.min(F.when(ranged, year)).alias("min_year"),
        F.max(F.when(ranged, year)).alias("max_year"),
        F.count_if("is_various_artists").alias("various"),
        F.count_if("is_self_titled").alias("self_titled"),
        F.count_if(F.size("title_qualifiers") > 0).alias("with_qualifier"),
    )
    sizes = side.groupBy("title_norm", "artist_norm").agg(F.count(F.lit(1)).alias("m"))
    twice = sizes.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("m") > 1).alias("keys_with_duplicates"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).alias("records_in_duplicate_keys"), F.coalesce(F.max("m"), F.lit(0)).alias("largest_key_size"))
    return facts.crossJoin(twice)  # one row each


def decades(side: DataFrame, last_year: int, first_year: int = 1900) -> DataFrame:
    return side.filter(F.col("year_norm").between(first_year, last_year)).groupBy((F.floor(F.col("year_norm") / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def pattern(raw_texts: bool = True) -> Column:
    """The pattern of a pair with the columns of both records, named with _a and _b.

    raw_texts: False leaves out the patterns that need more than normalised names (editions, numbers after a credit, ampersands);
    their pairs have the next pattern that holds, and names are compared as normalised, not as written.
    """
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    differ = lambda c: ~a(c).eqNullSafe(b(c))
    same_title, same_artist = a("title_norm").eqNullSafe(b("title_norm")), a("artist_norm").eqNullSafe(b("artist_norm"))
    same_year = F.coalesce(a("year_norm") == b("year_norm"), F.lit(False))
    numbered = F.coalesce(b("artist_credit").contains("(") & (strip_disambiguator(b("artist_credit")) != b("artist_credit")), F.lit(False))
    qualified = differ("title_norm_full") | (F.size(a("title_qualifiers")) != F.size(b("title_qualifiers")))
    raw = lambda s: F.concat_ws("|", F.coalesce(f"title_{s}", F.lit("")), F.coalesce(f"artist_credit_{s}", F.lit("")))
    worded = lambda s: F.lower(F.replace(raw(s), F.lit("&"), F.lit("and")))
    inside = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(x) < F.size(y))
    subset = lambda c: inside(a(c), b(c)) | inside(b(c), a(c))
    named = lambda s: F.concat_ws(" ", f"title_norm_{s}", f"artist_norm_full_{s}")
    words = lambda s: F.array_distinct(F.split(f"artist_norm_{s}", " "))
    if raw_texts:
        alike, joined = basic(raw("a")) == basic(raw("b")), subset("artist_tokens")
    else:
        alike, joined = named("a") == named("b"), inside(words("a"), words("b")) | inside(words("b"), words("a"))
    rules = [
        ("identical", same_title & same_artist & same_year),
        ("edition_qualifier", same_title & same_artist & qualified),
        ("article_position", same_title & same_artist & differ("artist_norm_full")),
        ("numeric_disambiguator", same_title & same_artist & numbered),
        ("year_only", same_title & same_artist),
        ("various_artists_credit", differ("is_various_artists")),
        ("edition_qualifier", ~differ("title_norm_full") & same_artist),
        ("ampersand_vs_and", (worded("a") == worded("b")) & (raw("a") != raw("b"))),
        ("case_punct_diacritics", alike),
        ("self_titled_vs_named", differ("is_self_titled")),
        ("title_token_order", same_artist & (a("title_tokens") == b("title_tokens"))),
        ("title_token_subset", same_artist & subset("title_tokens")),
        ("artist_credit_join", same_title & joined),
    ]
    out = F.lit("other")
    for name, holds in reversed([r for r in rules if raw_texts or r[0] not in FROM_RAW]):
        out = F.when(holds, name).otherwise(out)
    return out


LOOKED_UP = ("title", "artist_credit", "title_norm", "title_norm_full", "title_qualifiers", "title_tokens", "artist_norm", "artist_norm_full", "artist_tokens", "year_norm", "is_various_artists", "is_self_titled")


def classified_pairs(truth: DataFrame, a: DataFrame, b: DataFrame, raw_texts: bool = True) -> DataFrame:
    """(a_id, b_id, pattern) of the true pairs whose records exist; raw_texts as in pattern()."""
    left, right = (side.select(F.col("native_id").alias(f"{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in LOOKED_UP]) for s, side in (("a", a), ("b", b)))
    return truth.select("a_id", "b_id").distinct().join(left, "a_id").join(right, "b_id").select("a_id", "b_id", pattern(raw_texts).alias("pattern"))


def examples(classified: DataFrame, most: int = 15) -> DataFrame:
    """(pattern, pair_hash): examples dealt round over the patterns, the commonest pattern first, lowest hashes first."""
    counts = classified.groupBy("pattern").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy("pattern").orderBy("pair_hash")
    ranked = classified.filter("pattern <> 'identical'").select("pattern", pair_hash(F.col("a_id"), F.col("b_id")).alias("pair_hash")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return ranked.join(counts, "pattern").orderBy("_n", F.desc("_c"), "pattern").limit(most).select("pattern", "pair_hash")


def shares(side: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: total, and the share of records that each condition holds for, null in an empty catalogue."""
    return side.agg(F.count(F.lit(1)).alias("total"), *[(F.count_if(F.coalesce(c, F.lit(False))) / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1)))).alias(name) for name, c in conditions.items()])


def masters_extras(masters: DataFrame) -> DataFrame:
    """What only the catalogue of masters has: numbered credits, main releases, genres, several artists."""
    numbered = strip_disambiguator(F.col("artist_credit")) != F.col("artist_credit")
    return shares(masters, {"numeric_disambiguator_share": numbered, "main_release_present": F.col("main_release").isNotNull(), "genres_present": F.col("n_genres") > 0, "multi_artist_credit_share": F.col("n_artists") > 1})


def groups_extras(groups: DataFrame) -> DataFrame:
    """(measure, value, n) of the catalogue of release groups: records by type, and by how many links they have."""
    types = groups.groupBy(F.coalesce("primary_type", F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("primary_type").alias("measure"), "value", "n")
    links = groups.groupBy(F.least("n_links", F.lit(3)).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("links").alias("measure"), F.when(F.col("value") == "3", "3 or more").otherwise(F.col("value")).alias("value"), "n")
    return types.unionByName(links)


def links_extras(links: DataFrame, groups: DataFrame, masters: DataFrame) -> DataFrame:
    """(measure, value, n) of the links: by their type, how many name a record that is there, and how many records several name."""
    a, b = groups.select(F.col("native_id").alias("a_id")).distinct(), masters.select(F.col("native_id").alias("b_id")).distinct()
    out = links.groupBy(F.coalesce("link_type", F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("link_type").alias("measure"), "value", "n")
    held = links.select("a_id", "b_id").distinct()
    count = lambda df, measure, value: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), F.lit(value).alias("value"), "n")
    out = out.unionByName(count(held, "distinct", "links")).unionByName(count(held.join(b, "b_id", "left_anti"), "dead", "b")).unionByName(count(held.join(a, "a_id", "left_anti"), "dead", "a"))
    for side in ("a", "b"):
        several = held.groupBy(f"{side}_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        out = out.unionByName(count(several, "several", side))
    return out


def items_extras(items: DataFrame) -> DataFrame:
    """One row: of flattened items, the shares with a year, a class and performers, and with several performers."""
    return shares(items, {"year_present": F.col("year").isNotNull(), "class_present": F.col("class").isNotNull(), "performers_present": F.col("performers") != "", "several_performers": F.col("performers").contains("; ")})


def top_classes(items: DataFrame, most: int = 10) -> DataFrame:
    """(class, n): the commonest classes of flattened items, those without one under none."""
    return items.groupBy(F.coalesce("class", F.lit("none")).alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class").limit(most)
