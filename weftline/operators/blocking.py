"""Candidate generation: a union of equi-joins on blocking keys, with a cap for each A record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.hashing import short_hash
from weftline.schemas import KEY_TYPES
from weftline.session import cut

CAP, LARGEST, PAIR_GATE = 200, 5, 30_000_000


class TooManyPairs(RuntimeError):
    """Blocking gave more pairs than the next stages are meant for."""


def key_frame(side: DataFrame) -> DataFrame:
    """(native_id, key_type, key). Years within two of each other share a key, since both sides emit three.

    Various-artists records and those without a credit emit title keys only, so no block holds all of them.
    """
    none = F.lit(None).cast("string")
    titled = F.col("title_norm") != ""
    credited = ~F.col("is_various_artists") & (F.col("artist_norm") != "")
    dated = credited & F.col("year_norm").isNotNull()
    made = [
        ("k_title3", F.when(titled, F.array_join(F.slice(F.split("title_norm", " "), 1, 3), " "))),
        ("k_title_sorted", F.when(titled, short_hash(F.array_join("title_tokens", " ")))),
        *[("k_artist_year", F.when(dated, F.concat_ws("|", "artist_norm", (F.col("year_norm") + d).cast("string")))) for d in (-1, 0, 1)],
        ("k_phonetic", F.when(credited & (F.coalesce("title_metaphone", F.lit("")) != "") & (F.coalesce("artist_metaphone", F.lit("")) != ""), F.concat_ws("|", "title_metaphone", "artist_metaphone")).otherwise(none)),
        ("k_self_titled", F.when(credited & F.col("is_self_titled"), F.col("artist_norm"))),
    ]
    rows = F.array(*[F.struct(F.lit(kind).alias("key_type"), key.alias("key")) for kind, key in made])
    return side.select("native_id", F.explode(F.filter(rows, lambda r: r["key"].isNotNull())).alias("k")).select("native_id", "k.key_type", "k.key")


def pair_keys(a_keys: DataFrame, b_keys: DataFrame) -> DataFrame:
    """(a_id, b_id, key_type): pairs that share a key of the type, once each. A large block's join is split at run time."""
    left = a_keys.select(F.col("native_id").alias("a_id"), "key_type", "key")
    right = b_keys.select(F.col("native_id").alias("b_id"), "key_type", "key")
    return left.join(right, ["key_type", "key"]).select("a_id", "b_id", "key_type").distinct()


def union_pairs(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, block_keys, n_block_keys)"""
    return pairs.groupBy("a_id", "b_id").agg(F.array_sort(F.collect_set("key_type")).alias("block_keys")).withColumn("n_block_keys", F.size("block_keys"))


def capped(union: DataFrame, cap: int = CAP, by: tuple[str, ...] = ("a_id",)) -> DataFrame:
    """The cap pairs of each A record with most keys, ties to the smaller B id as text; pruned before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("n_block_keys"), "b_id")
    return union.withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= cap).drop("_n")  # a pair may have several rows


#: Key types in the order of block_keys; a set of types is a number with a bit for each.
BITS = {kind: 1 << i for i, kind in enumerate(sorted(KEY_TYPES))}


def _first(rows: DataFrame, cap: int) -> DataFrame:
    """The rows of each (kinds, key) with the cap smallest ids, numbered; pruned before the shuffle."""
    return rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("kinds", "key").orderBy("native_id"))).filter(F.col("_n") <= cap)


def _with_columns(rows: DataFrame, side: DataFrame, columns: tuple[str, ...], s: str) -> DataFrame:
    """rows with the columns of their records, named with _a or _b, and the record's number among those of its id (_r_a or _r_b)."""
    if not columns:
        return rows
    numbered = side.select("native_id", *columns, F.row_number().over(Window.partitionBy("native_id").orderBy(*columns)).alias("_r"))
    return rows.join(numbered.select("native_id", *[F.col(c).alias(f"{c}_{s}") for c in (*columns, "_r")]), "native_id", "left")


def joint_keys(keys: DataFrame, large: DataFrame) -> DataFrame:
    """(native_id, kinds, size, key, plain): each key of a record, and each set of keys of different types that has a large one.

    kinds is the number of the set's types, size how many they are; plain is a single key that is not large. The key of a set is
    its keys with their lengths, so different sets have different keys.
    """
    held = keys.join(large.withColumn("_large", F.lit(True)), ["kinds", "key"], "left").groupBy("native_id").agg(F.array_sort(F.collect_set(F.struct("kinds", "key", F.coalesce("_large", F.lit(False)).alias("large")))).alias("ks"))
    made = F.struct(F.lit(0).alias("kinds"), F.lit(0).alias("size"), F.lit("").alias("key"), F.lit(False).alias("large"))
    longer = lambda s, k: F.struct(s["kinds"].bitwiseOR(k["kinds"]).alias("kinds"), (s["size"] + 1).alias("size"), F.concat(s["key"], F.length(k["key"]).cast("string"), F.lit(":"), k["key"]).alias("key"), (s["large"] | k["large"]).alias("large"))
    every = F.aggregate("ks", F.array(made), lambda out, k: F.concat(out, F.transform(F.filter(out, lambda s: s["kinds"].bitwiseAND(k["kinds"]) == 0), lambda s: longer(s, k))))
    # a record without a large key has none but its single keys
    some = F.when(F.exists("ks", lambda k: k["large"]), every).otherwise(F.transform("ks", lambda k: longer(made, k)))
    return held.select("native_id", F.explode(F.filter(some, lambda s: (s["size"] == 1) | ((s["size"] > 1) & s["large"]))).alias("s")).select("native_id", "s.kinds", "s.size", "s.key", (~F.col("s.large")).alias("plain"))


def _joint_sides(a: DataFrame, b: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The joint keys of A that can add a pair to the cap (see candidates()), and those of B."""
    kinds = F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair])
    keys_a, keys_b = (key_frame(side).select("native_id", kinds[F.col("key_type")].alias("kinds"), "key") for side in (a, b))
    large = _first(keys_b, cap).filter(F.col("_n") == cap).select("kinds", "key").distinct()
    held_a, held_b = joint_keys(keys_a, large), joint_keys(keys_b, large)
    full = _first(held_b, cap).filter((F.col("_n") == cap) & ~F.col("plain")).select("kinds", "key")
    most = held_a.filter(~F.col("plain")).join(full, ["kinds", "key"], "left_semi").groupBy("native_id").agg(F.max("size").alias("_most"))
    used = held_a.join(most, "native_id", "left").filter(F.col("plain") | F.col("_most").isNull() | (F.col("size") >= F.col("_most")))
    return used, held_b


def candidates(a: DataFrame, b: DataFrame, cap: int = CAP, looked_up: tuple[str, ...] = (), made: dict[str, Column] | None = None) -> DataFrame:
    """capped(union_pairs(pair_keys())) of the sides' keys, without making the pairs of large blocks.

    A pair that shares exactly the keys of a set S comes after every pair of the same A record that shares S too and has a smaller
    B id. So of the B records that hold S the first cap are enough, for each S by itself, and where these are cap no set of fewer
    keys can add a pair. Only sets with a large key, one that cap B records or more hold, need this; all pairs of the other
    keys are made. A kept pair is made from its own S, so its keys are whole; pairs that are made with too few of their keys are
    not among the cap with all of theirs.

    made: columns over the looked-up columns of both records, named with _a and _b. They are found where a pair is made, so the
    texts of records travel with their few keys and the pairs are dealt once, by a_id. As in a join with the records, a pair has a
    row for each two records of its ids, and none if an id is null.
    """
    made = made or {}
    used, held_b = _joint_sides(a, b, cap)
    left = _with_columns(used, a, looked_up, "a").withColumnRenamed("native_id", "a_id").drop("size", "plain", "_most")
    right = _first(_with_columns(held_b, b, looked_up, "b"), cap).withColumnRenamed("native_id", "b_id").drop("size", "plain", "_n")
    rows = ["_r_a", "_r_b"] if looked_up else []
    pairs = left.join(right, ["kinds", "key"]).select("a_id", "b_id", *rows, "kinds", *[c.alias(name) for name, c in made.items()])
    union = pairs.repartition("a_id").groupBy("a_id", "b_id", *rows).agg(F.bit_or("kinds").alias("_kinds"), *[F.first(name).alias(name) for name in made])
    best = capped(union.withColumn("n_block_keys", F.bit_count("_kinds").cast("int")), cap)
    if looked_up:
        best = best.filter("a_id is not null and b_id is not null")
    return best.select("a_id", "b_id", _types().alias("block_keys"), "n_block_keys", *made)


def id_groups(a: DataFrame, n: int) -> DataFrame:
    """(native_id, a_ids): the number of each id's group; ids next to each other by title and credit are in one of n groups.

    Groups are equally large, as ids break ties. The numbers are those of partitions, so they are cut off, to be the same in all uses.
    """
    firsts = a.filter("native_id is not null").groupBy("native_id").agg(F.min("title_norm").alias("_t"), F.min("artist_norm").alias("_c"))
    return cut(firsts.repartitionByRange(n, "_t", "_c", "native_id").select("native_id", F.spark_partition_id().alias("a_ids")))


def candidates_with_records(a: DataFrame, b: DataFrame, cap: int, looked_up: tuple[str, ...]) -> DataFrame:
    """candidates() joined with the looked-up columns of both records, named with _a and _b, without an exchange of pairs.

    The A records of a group (id_groups()) share most of their B records. So the B ids of a key go to a group once, not to each of
    its pairs, as do the texts of a B record; pairs are made, capped and given their texts where the group is. Joins would deal
    both sides by all of their keys, so what meets in a group is a union, gathered by an aggregation or a window.
    """
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(n, "a_ids")  # the number is given: what tasks read is far less than the pairs they make
    none = lambda t: F.lit(None).cast(t)
    used, held_b = _joint_sides(a, b, cap)
    groups = id_groups(a, 2 * n)  # several to a task, so that tasks are more alike
    left = used.join(groups, "native_id").select("a_ids", F.col("native_id").alias("a_id"), "kinds", "key")
    right = _first(held_b, cap).select(F.col("native_id").alias("b_id"), "kinds", "key")
    lists = right.join(left.select("a_ids", "kinds", "key").distinct(), ["kinds", "key"]).select("a_ids", "kinds", "key", F.struct("b_id").alias("_b"))

    keyed = deal(lists.withColumn("a_id", none("string")).unionByName(left.withColumn("_b", none("struct<b_id:string>"))))
    blocks = keyed.groupBy("a_ids", "kinds", "key").agg(F.collect_list("a_id").alias("_as"), F.collect_list("_b").alias("_bs"))
    pairs = blocks.select("a_ids", "kinds", "_bs", F.explode("_as").alias("a_id")).select("a_ids", "kinds", "a_id", F.explode("_bs").alias("_b")).select("a_ids", "a_id", "_b.b_id", "kinds")
    union = pairs.groupBy("a_ids", "a_id", "b_id").agg(F.bit_or("kinds").alias("_kinds"))
    best = capped(union.withColumn("n_block_keys", F.bit_count("_kinds").cast("int")), cap, ("a_ids", "a_id"))

    of_a, of_b = (side.select(F.col("native_id").alias(f"{s}_id"), F.struct(*[F.col(c).alias(f"{c}_{s}") for c in looked_up]).alias(f"_r_{s}")).groupBy(f"{s}_id").agg(F.collect_list(f"_r_{s}").alias(f"_r_{s}")) for s, side in (("a", a), ("b", b)))
    sought = lists.select("a_ids", "_b.b_id").repartition("b_id").distinct()
    for key, texts in (("a_id", deal(of_a.join(groups.withColumnRenamed("native_id", "a_id"), "a_id"))), ("b_id", deal(sought.join(of_b, "b_id")))):
        records = f"_r_{key[0]}"
        met = texts.unionByName(best, allowMissingColumns=True)
        best = met.withColumn(records, F.first(records, ignorenulls=True).over(Window.partitionBy("a_ids", key))).filter("_kinds is not null")
    # a pair has a row for each two records of its ids, and none if an id is null
    held = best.withColumn("_r_a", F.explode("_r_a")).withColumn("_r_b", F.explode("_r_b"))
    return held.select("a_id", "b_id", _types().alias("block_keys"), "n_block_keys", "_r_a.*", "_r_b.*")


def _types() -> Column:
    """The key types of _kinds, in their order."""
    return F.filter(F.array(*[F.when(F.col("_kinds").bitwiseAND(bit) != 0, F.lit(kind)) for kind, bit in BITS.items()]), lambda t: t.isNotNull())


def truth_pair_keys(truth: DataFrame, a_keys: DataFrame, b_keys: DataFrame) -> DataFrame:
    """pair_keys() of the truth pairs alone: (a_id, b_id, key_type)"""
    wanted = truth.select("a_id", "b_id").distinct()
    left = wanted.join(a_keys.withColumnRenamed("native_id", "a_id"), "a_id")
    return left.join(b_keys.withColumnRenamed("native_id", "b_id"), ["b_id", "key_type", "key"]).select("a_id", "b_id", "key_type").distinct()


def gate(union: DataFrame, most: int = PAIR_GATE) -> int:
    n = union.count()
    if n > most:
        raise TooManyPairs(f"{n} pairs, {most} allowed")
    return n


def counts_by_key(keys: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(key_type, keys_emitted[, pairs])"""
    out = keys.groupBy("key_type").agg(F.count(F.lit(1)).alias("keys_emitted"))
    if pairs is None:
        return out
    return out.join(pairs.groupBy("key_type").agg(F.count(F.lit(1)).alias("pairs")), "key_type", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def largest_blocks(keys: DataFrame, most: int = LARGEST) -> DataFrame:
    """(key_type, rank, block_size): the sizes of the largest blocks of each type."""
    sizes = keys.groupBy("key_type", "key").agg(F.count(F.lit(1)).alias("block_size"))
    order = Window.partitionBy("key_type").orderBy(F.desc("block_size"), "key")
    return sizes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("key_type", "rank", "block_size")


def overflow(union: DataFrame, cap: int = CAP) -> DataFrame:
    """One row: records with candidates, most candidates of one, pairs over the cap, records over it."""
    per = union.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("a_with_candidates"), F.coalesce(F.max("n"), F.lit(0)).alias("max_candidates"), F.coalesce(F.sum(F.greatest(F.col("n") - cap, F.lit(0))), F.lit(0)).alias("pairs_dropped"), F.count_if(F.col("n") > cap).alias("a_over_cap"))


def completeness(truth: DataFrame, pairs: DataFrame, union: DataFrame, kept: DataFrame) -> DataFrame:
    """(measure, found, truth_pairs): truth pairs found by each key type, by all, and after the cap.

    Truth is only counted here; it never enters the candidates.
    """
    wanted = truth.select("a_id", "b_id").distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("truth_pairs"))
    by_key = pairs.join(wanted, ["a_id", "b_id"], "left_semi").groupBy(F.col("key_type").alias("measure")).agg(F.count(F.lit(1)).alias("found"))
    parts = [frame.join(wanted, ["a_id", "b_id"], "left_semi").agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("measure"), "found") for name, frame in (("union", union), ("after_cap", kept))]
    return by_key.unionByName(parts[0]).unionByName(parts[1]).crossJoin(total)  # one row


def reduction_ratio(n_a: int, n_b: int, kept: int) -> float | None:
    return round(1 - kept / (n_a * n_b), 9) if n_a and n_b else None
