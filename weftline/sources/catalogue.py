"""Two catalogues and their truth links, derived from `documents`: a stand-in for real dumps in queries and benchmarks.

Every document is a record. Its title is words 1 to 6 and its credit words 7 and 8, as far as it has them, with decorations
by its id, so that every rule of normalisation and blocking has records: credits of various artists, titles that are the
credit, bracketed editions, articles after a comma, numbers in brackets, marks of other scripts. Its year follows from its
length, its type is its language. Documents with an even id are side A, the others side B. True links join records whose words
9 to 20 and language agree: nothing that the matcher sees, so truth cannot leak into features. A title and a credit are short
by their nature; the rest of a long text is in no record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.normalize import normalize_frame, with_metaphones
from weftline.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, native_id, title, artist_credit, year, primary_type, truth_key)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    held = docs.withColumn("w", F.filter(words, lambda w: w != ""))
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    # the same decorations on either side: documents 2k and 2k + 1 share theirs
    n = F.floor(F.col("doc_id") / 2)
    title, credit = part(1, 6), part(7, 2)
    decorated_credit = F.when(n % 17 == 3, "Various Artists").when(n % 17 == 5, "V/A").when(n % 7 == 1, F.concat(credit, F.lit(", The"))).when(n % 7 == 2, F.concat(F.lit("The "), credit, F.lit(" (2)"))).when(n % 7 == 4, F.concat(F.lit("Đặng "), credit)).otherwise(credit)
    decorated_title = F.when((n % 13 == 4) & (n % 17 != 3) & (n % 17 != 5), credit).when(n % 11 == 2, F.concat(title, F.lit(" [Deluxe Edition]"))).when(n % 11 == 6, F.concat(F.lit("Ёлка й "), title)).when(n % 11 == 8, F.concat(F.lit("Ἀθήνα "), title)).otherwise(title)
    return held.select(
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("side"),
        F.col("doc_id").cast("string").alias("native_id"),
        decorated_title.alias("title"),
        decorated_credit.alias("artist_credit"),
        (1900 + (F.floor(F.col("n_chars") / 25) % 120)).cast("int").alias("year"),
        F.col("lang").alias("primary_type"),
        F.when(F.size("w") >= 20, F.concat_ws("|", F.coalesce("lang", F.lit("")), part(9, 12))).alias("truth_key"),
    )


def sides(spark: SparkSession, sf_dir: str, phonetic: bool = False) -> tuple[DataFrame, DataFrame]:
    """The normalised records of A and of B, without what truth is made from.

    The rules of normalisation are expressions of megabytes, and a query uses the records four times and more: they are made
    once and cut off, so that neither the driver's plans nor the work grow with the uses.
    """
    every = cut(normalize_frame(records(spark, sf_dir).drop("truth_key")))
    if phonetic:
        every = cut(with_metaphones(every))
    return tuple(every.filter(F.col("side") == s).drop("side") for s in ("a", "b"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_id, b_id): every true link. Of the records with one key each of A is linked with the first of B, and each of B with the
    first of A, so there are no more links than records however many copies there are. Keys are made from all texts, so once."""
    every = cut(records(spark, sf_dir).select("side", "native_id", "truth_key")).filter("truth_key is not null")
    of_a = F.col("side") == "a"
    firsts = every.groupBy("truth_key").agg(F.min(F.when(of_a, F.col("native_id"))).alias("first_a"), F.min(F.when(~of_a, F.col("native_id"))).alias("first_b")).filter("first_a is not null and first_b is not null")
    return every.join(firsts, "truth_key").select(F.when(of_a, F.col("native_id")).otherwise(F.col("first_a")).alias("a_id"), F.when(of_a, F.col("first_b")).otherwise(F.col("native_id")).alias("b_id")).distinct()


#: Adapters by name: functions (spark, path) -> normalised side frame.
ADAPTERS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {}


def register(name: str, side: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a source of one side; a name is given once, a side is a or b."""
    if side not in ("a", "b"):
        raise ValueError(f"side must be a or b, got {side!r}")
    if name in ADAPTERS:
        raise ValueError(f"{name} is registered already")
    if not callable(read):
        raise TypeError("an adapter is a function (spark, path) -> DataFrame")
    ADAPTERS[name] = (side, read)


def adapter(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name!r}; registered: {', '.join(sorted(ADAPTERS)) or 'none'}")
    return ADAPTERS[name][1]


register("documents_a", "a", lambda spark, path: sides(spark, path)[0])
register("documents_b", "b", lambda spark, path: sides(spark, path)[1])
