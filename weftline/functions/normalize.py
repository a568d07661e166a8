"""Normalisation of titles and artist credits as column expressions.

Marks are stripped by character tables that a rule makes from the Unicode data: compatibility decomposition without
combining marks, for every character that decomposes into one; those below U+0250 that decompose into several are replaced
one by one. What is left, characters beyond that decompose into several (ligatures, Hangul, fractions and the like), is
spelled out first by an Arrow function that sees only the texts with such characters (spelled_out()). All else stays in the
JVM, case folding too: lower case and the few letters in which folding differs from it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.phonetic import metaphone_of

# Fixed values of the normalisation rules.
ARTICLES = ("the", "a", "an", "los", "las", "les", "die", "der", "das")
QUALIFIERS = ("remaster", "deluxe", "anniversary", "edition", "expanded", "reissue")
VARIOUS_CREDITS = ("various", "various artists", "va", "v/a")
VARIOUS = "various"
APOSTROPHES = "'’‘ʼ"
TABLE_BELOW = 0x250
#: What case folding does beyond lower case: the tables are for text without marks, which has no other such letters.
FOLDED = (("ß", "ss"), ("ς", "σ"))


def _base(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@cache
def mark_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their bases, longer replacements below TABLE_BELOW)."""
    plain, bases, longer = "", "", []
    for c in map(chr, range(0xA0, 0x30000)):
        base = c if 0xD800 <= ord(c) < 0xE000 else _base(c)
        if base == c or not base:
            continue
        if len(base) == 1:
            plain, bases = plain + c, bases + base
        elif ord(c) < TABLE_BELOW:
            longer.append((c, base))
    return plain, bases, tuple(longer)


def char_class(codes: list[int]) -> str:
    """A regular expression's class of code points, as ranges."""
    out, i = "", 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out += f"\\x{{{codes[i]:x}}}" + (f"-\\x{{{codes[j]:x}}}" if j > i else "")
        i = j + 1
    return f"[{out}]"


@cache
def combining() -> str:
    """The class of all combining marks, and of the characters that decompose into such marks alone."""
    return char_class([i for i in range(0x300, 0x30000) if not 0xD800 <= i < 0xE000 and not _base(chr(i))])


@cache
def any_mark() -> str:
    """A class that holds combining() and is cheap to look for: all marks by their property, what the JVM does not know yet, and
    the few others in it."""
    others = [i for i in range(0x300, 0x30000) if not 0xD800 <= i < 0xE000 and not _base(chr(i)) and unicodedata.category(chr(i))[0] != "M"]
    return r"[\p{M}\p{Cn}" + char_class(others)[1:]


@cache
def several() -> str:
    """The class of the characters from TABLE_BELOW on that decompose into several."""
    return char_class([i for i in range(TABLE_BELOW, 0x30000) if not 0xD800 <= i < 0xE000 and len(_base(chr(i))) > 1])


def strip_marks(text: Column) -> Column:
    """Compatibility decomposition without combining marks, of text that is spelled_out().

    Nothing that one of the three steps writes is changed by another, so they can go in any order: the table comes last, as an
    expression that repeats it for each case is ten times as large, and plans and the driver's memory with it.
    """
    plain, bases, longer = mark_table()
    low = "".join(c for c, _ in longer)
    # most texts hold none of these
    replaced = text
    for c, base in longer:
        replaced = F.replace(replaced, F.lit(c), F.lit(base))
    spelled = F.when(text.rlike(f"[{low}]"), replaced).otherwise(text)
    # the class of combining marks has hundreds of ranges; few texts have any mark
    marked = F.when(text.rlike(any_mark()), F.regexp_replace(spelled, combining(), "")).otherwise(spelled)
    # a scan for any character beyond ASCII is far cheaper than looking each one up
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(marked, plain, bases)).otherwise(text)


@F.pandas_udf(T.StringType())
def _spelled(text: pd.Series) -> pd.Series:
    return text.map(_base, na_action="ignore")


def spelled_out(text: Column) -> Column:
    """text, with its marks stripped if it has a character that decomposes into several: the only texts that reach Python."""
    some = text.rlike(rf"[^\x00-\x{{{TABLE_BELOW - 1:x}}}]") & text.rlike(several())  # the first is cheap and seldom true
    return F.when(some, _spelled(F.when(some, text))).otherwise(text)


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{APOSTROPHES}]", ""), r"[\p{P}\p{S}]", " ")


def basic_of_stripped(text: Column) -> Column:
    """Case folded, `&` written out, punctuation and runs of white space to one space, of text without marks."""
    folded = F.lower(text)
    for letter, written in FOLDED:
        folded = F.replace(folded, F.lit(letter), F.lit(written))
    worded = F.replace(folded, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(strip_punctuation(worded), r"[\s\p{Z}]+", " "))


def basic(text: Column) -> Column:
    """Marks stripped, then basic_of_stripped()."""
    return basic_of_stripped(strip_marks(text))


def basic_text(text: str) -> str:
    """basic() of one string, for any code point."""
    marked = _base(text).casefold().replace("&", " and ")
    spaced = ("" if c in APOSTROPHES else " " if unicodedata.category(c)[0] in "PS" else c for c in marked)
    return " ".join("".join(spaced).split())


@F.pandas_udf(T.StringType())
def exact_basic(text: pd.Series) -> pd.Series:
    return text.map(basic_text, na_action="ignore")


def strip_disambiguator(credit: Column) -> Column:
    return F.regexp_replace(credit, r"\s*\(\d+\)", "")


def reorder_comma_article(credit: Column) -> Column:
    return F.regexp_replace(credit, rf"(?i)^(.+?),\s*({'|'.join(ARTICLES)})\s*$", "$2 $1")


def drop_leading_article(text: Column) -> Column:
    return F.regexp_replace(text, rf"^(?:{'|'.join(ARTICLES)}) (?=.)", "")


#: A bracket, without others inside, that has a qualifier among its words.
QUALIFIED = rf"(?i)\s*[(\[](?:[^()\[\]]*[^()\[\]\w])?(?:{'|'.join(QUALIFIERS)})(?:[^()\[\]\w][^()\[\]]*)?[)\]]"


def title_of_stripped(text: Column) -> Column:
    return basic_of_stripped(F.trim(F.regexp_replace(text, QUALIFIED, "")))


def qualifiers_of_stripped(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({QUALIFIED})"), 1), basic_of_stripped)


def qualifiers(title: Column) -> Column:
    """The bracketed qualifier texts in their order, normalised."""
    return qualifiers_of_stripped(strip_marks(title))


def is_various(credit: Column) -> Column:
    return F.lower(F.trim(credit)).isin(*VARIOUS_CREDITS) | basic(credit).isin("various", "various artists", "va", "v a")


def tokens(text: Column) -> Column:
    """Distinct words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")))


def artist_full(credit: Column) -> Column:
    return F.when(is_various(credit), F.lit(VARIOUS)).otherwise(basic(reorder_comma_article(strip_disambiguator(credit))))


def artist(credit: Column) -> Column:
    return F.when(is_various(credit), F.lit(VARIOUS)).otherwise(drop_leading_article(artist_full(credit)))


def title(text: Column) -> Column:
    return title_of_stripped(strip_marks(text))


def normalize_frame(df: DataFrame, phonetic: bool = False) -> DataFrame:
    """Add the normalised columns to a frame with title, artist_credit and year.

    phonetic: also the two metaphone columns (null without it). They are computed for the different first words only and
    joined back, since there are far fewer words than records.
    """
    df = df.withColumns({"_title": spelled_out(F.coalesce("title", F.lit(""))), "_credit": spelled_out(F.coalesce("artist_credit", F.lit("")))})
    text, credit = F.col("_title"), F.col("_credit")
    # what is used several times is a column of its own, so that no expression holds the tables more than once
    df = df.withColumns({"_title": strip_marks(text), "_bare": reorder_comma_article(strip_disambiguator(credit)), "_various": is_various(credit)}).withColumn("_bare", basic(F.col("_bare")))
    credited = lambda c: F.when(F.col("_various"), F.lit(VARIOUS)).otherwise(c)
    out = df.withColumns({"title_norm": title_of_stripped(text), "title_norm_full": basic_of_stripped(text), "title_qualifiers": qualifiers_of_stripped(text), "artist_norm": credited(drop_leading_article(F.col("_bare"))), "artist_norm_full": credited(F.col("_bare")), "year_norm": F.col("year").cast("int"), "is_various_artists": F.col("_various")})
    out = out.withColumns({"title_tokens": tokens(F.col("title_norm")), "artist_tokens": tokens(F.col("artist_norm")), "is_self_titled": (F.col("title_norm") != "") & (F.col("title_norm").eqNullSafe(F.col("artist_norm")) | F.col("title_norm").eqNullSafe(F.col("artist_norm_full")))})
    out = out.drop("_title", "_credit", "_bare", "_various")
    if not phonetic:
        return out.withColumns({"title_metaphone": F.lit(None).cast("string"), "artist_metaphone": F.lit(None).cast("string")})
    return with_metaphones(out)


def with_metaphones(normalized: DataFrame) -> DataFrame:
    """The two metaphone columns of a normalised frame, which is used three times here."""
    out = normalized.drop("title_metaphone", "artist_metaphone")
    first = {side: F.element_at(F.split(F.col(f"{side}_norm"), " "), 1) for side in ("title", "artist")}
    out = out.withColumns({"_tw": first["title"], "_aw": first["artist"]})
    words = out.select(F.explode(F.array("_tw", "_aw")).alias("_word")).filter("_word <> ''").distinct().withColumn("_code", metaphone_of("_word"))
    for side, word in (("title", "_tw"), ("artist", "_aw")):
        out = out.join(words.select(F.col("_word").alias(word), F.col("_code").alias(f"{side}_metaphone")), word, "left").withColumn(f"{side}_metaphone", F.coalesce(f"{side}_metaphone", F.lit("")))
    return out.drop("_tw", "_aw")
