"""Catalogue dumps: header-less TSV tables, masters in XML, and artifacts in JSON and CSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of each header-less table, in their order, and those that are kept.
TSV_COLUMNS = {
    "release_group": "id gid name artist_credit type comment edits_pending last_updated".split(),
    "artist_credit": "id name artist_count ref_count created edits_pending gid".split(),
    "release_group_primary_type": "id name parent child_order description gid".split(),
    "l_release_group_url": "id link entity0 entity1 edits_pending last_updated link_order entity0_credit entity1_credit".split(),
    "url": "id gid url edits_pending last_updated".split(),
    "link": "id link_type begin_date_year begin_date_month begin_date_day end_date_year end_date_month end_date_day attribute_count created ended".split(),
    "link_type": "id parent child_order gid entity_type0 entity_type1 name description link_phrase reverse_link_phrase long_link_phrase last_updated is_deprecated has_dates entity0_cardinality entity1_cardinality".split(),
    "release": "id gid name artist_credit release_group status packaging language script barcode comment edits_pending quality last_updated".split(),
    "release_country": "release country date_year date_month date_day".split(),
    "release_unknown_country": "release date_year date_month date_day".split(),
}

MASTER = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("main_release", T.StringType()),
        T.StructField("artists", T.StructType([T.StructField("artist", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("join", T.StringType())])))])),
        T.StructField("genres", T.StructType([T.StructField("genre", T.ArrayType(T.StringType()))])),
        T.StructField("year", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)


def tsv(spark: SparkSession, path: str, name: str, keep: list[str] | None = None) -> DataFrame:
    """One table: tabs, no quotes or escapes, \\N for null, every column text; short lines are padded with nulls."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in TSV_COLUMNS[name]])
    read = spark.read.csv(f"{path}/{name}", sep="\t", quote="", escape="", nullValue="\\N", emptyValue="", schema=schema, mode="PERMISSIVE")
    return read.select(*(keep or TSV_COLUMNS[name]))


def release_groups(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, native_id, title, artist_credit, year, primary_type, n_links): earliest year over both event tables."""
    events = tables["release_country"].select("release", "date_year").unionByName(tables["release_unknown_country"].select("release", "date_year"))
    years = events.withColumn("y", F.expr("try_cast(date_year AS INT)")).filter("y > 0").join(tables["release"].select(F.col("id").alias("release"), "release_group"), "release").groupBy("release_group").agg(F.min("y").alias("year"))
    n_links = tables["l_release_group_url"].join(tables["url"].select(F.col("id").alias("entity1"), "url"), "entity1").filter(F.col("url").rlike(r"discogs\.com/master/[0-9]+")).groupBy("entity0").agg(F.count(F.lit(1)).alias("n_links"))
    groups = tables["release_group"].alias("g")
    return (
        groups.join(years, F.col("g.id") == F.col("release_group"), "left")
        .join(n_links, F.col("g.id") == F.col("entity0"), "left")
        .join(tables["artist_credit"].select(F.col("id").alias("_ac"), F.col("name").alias("_credit")), F.col("g.artist_credit") == F.col("_ac"), "left")
        .join(tables["release_group_primary_type"].select(F.col("id").alias("_t"), F.col("name").alias("_type")), F.col("g.type") == F.col("_t"), "left")
        .select(F.lit("a").alias("source"), F.col("g.gid").alias("native_id"), F.coalesce("g.name", F.lit("")).alias("title"), F.coalesce("_credit", F.lit("")).alias("artist_credit"), F.col("year"), F.col("_type").alias("primary_type"), F.coalesce("n_links", F.lit(0)).cast("int").alias("n_links"))
    )


def master_links(tables: dict[str, DataFrame]) -> DataFrame:
    """(a_id, b_id, link_type): links of release groups to masters, the id taken from the address."""
    urls = tables["url"].filter(F.col("url").rlike(r"discogs\.com/master/[0-9]+")).select(F.col("id").alias("entity1"), F.regexp_extract("url", r"discogs\.com/master/([0-9]+)", 1).alias("b_id"))
    kinds = tables["link"].select(F.col("id").alias("link"), "link_type").join(tables["link_type"].select(F.col("id").alias("link_type"), F.col("name").alias("_name")), "link_type", "left").select("link", F.col("_name").alias("link_type"))
    return tables["l_release_group_url"].select("link", "entity0", "entity1").join(urls, "entity1").join(tables["release_group"].select(F.col("id").alias("entity0"), F.col("gid").alias("a_id")), "entity0").join(kinds, "link", "left").select("a_id", "b_id", "link_type")


def credit_of(artists: Column) -> Column:
    """Names one after another, a name's join text between it and the next artist."""
    last = F.size(artists) - 1
    return F.array_join(F.transform(artists, lambda x, i: F.concat(F.coalesce(x["name"], F.lit("")), F.when(i < last, F.coalesce(x["join"], F.lit(""))).otherwise(""))), "")


def masters(spark: SparkSession, path: str) -> DataFrame:
    """(source, native_id, title, artist_credit, year, n_artists, n_genres, main_release) from XML, gzip or not."""
    read = spark.read.format("xml").option("rowTag", "master").option("ignoreSurroundingSpaces", "false").schema(MASTER).load(path)
    artists, genres = F.coalesce("artists.artist", F.array().cast("array<struct<name:string,join:string>>")), F.coalesce("genres.genre", F.array().cast("array<string>"))
    year = F.expr("try_cast(trim(year) AS INT)")
    return read.select(F.lit("b").alias("source"), F.col("_id").alias("native_id"), F.coalesce("title", F.lit("")).alias("title"), credit_of(artists).alias("artist_credit"), F.when(year > 0, year).alias("year"), F.size(artists).alias("n_artists"), F.size(genres).alias("n_genres"), F.expr("try_cast(trim(main_release) AS BIGINT)").alias("main_release"))


def flattened_items(claims: DataFrame) -> DataFrame:
    """(item, year, class, performers): the least year and class of each item, its performers sorted and joined."""
    return claims.groupBy("item").agg(F.min("year").alias("year"), F.min("class").alias("class"), F.array_join(F.array_sort(F.collect_set("performer")), "; ").alias("performers"))


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything, asked of the file system that holds it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def json_artifacts(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """JSON documents with the path they came from; no file gives an empty relation of the schema."""
    whole = T.StructType([*schema, T.StructField("filename", T.StringType())])
    if not exists(spark, pattern):
        return spark.createDataFrame([], whole)
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("filename", F.col("_metadata.file_path"))


def json_variants(spark: SparkSession, pattern: str) -> DataFrame:
    """(filename, doc): each file as one VARIANT, for documents whose rows differ."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "filename string, doc string").withColumn("doc", F.parse_json("doc"))
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("filename"), F.parse_json("value").alias("doc"))


def csv_text(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """CSV, gzip or not, with a header, every column text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, pattern):
        return spark.createDataFrame([], schema)
    return spark.read.csv(pattern, header=True, schema=schema)


REPLAY = T.StructType([T.StructField("v1", T.DoubleType()), T.StructField("v2", T.DoubleType()), T.StructField("n_candidates", T.IntegerType()), T.StructField("labelled", T.BooleanType()), T.StructField("top1_correct", T.BooleanType()), T.StructField("truth_reachable", T.BooleanType())])


def replay_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Frozen decision values; a cell of another type stops the read."""
    return spark.read.csv(path, header=True, schema=REPLAY, nullValue="", mode="FAILFAST", enforceSchema=False)


# What ids look like, and the addresses that may be made from them.
ID_PATTERNS = {"a": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "b": r"^[1-9][0-9]{0,11}$"}
ADDRESSES = {"a": "https://musicbrainz.org/release-group/", "b": "https://www.discogs.com/master/"}


def valid_id(column: Column, side: str) -> Column:
    """The id, or an error if it is null or not one of that side."""
    return F.when(column.rlike(ID_PATTERNS[side]), column).otherwise(F.raise_error(F.concat(F.lit(f"not an id of side {side}: "), F.coalesce(column, F.lit("null")))))


def address_of(column: Column, side: str) -> Column:
    """The address of a record; only well-formed ids become part of one."""
    return F.concat(F.lit(ADDRESSES[side]), valid_id(column, side))


def cached(frame: Callable[[], DataFrame], spark: SparkSession, path: str, id_col: str = "native_id") -> DataFrame:
    """frame() kept as Parquet at path, sorted by the id as a number inside each file, so look-ups by id skip most of it; read
    from there if it was kept before."""
    if not exists(spark, f"{path}/_SUCCESS"):
        number = F.expr(f"try_cast(`{id_col}` AS BIGINT)")
        frame().repartitionByRange(number, F.col(id_col)).sortWithinPartitions(number, F.col(id_col)).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def bad_exhibit_rows(rows: DataFrame, method: str) -> DataFrame:
    """(a_id, problem): rows of an exhibit that break its rules."""
    twice = rows.groupBy("a_id").count().filter("count > 1").select("a_id", F.lit("duplicate A").alias("problem"))
    cases = {"other method": F.col("method_version") != method, "not the test fold": F.col("fold") != "test", "malformed A id": ~F.col("a_id").rlike(r"^[0-9A-Za-z-]+$"), "malformed B id": ~F.col("b_id").rlike(r"^[0-9]+$")}
    flagged = rows.select("a_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(p)) for p, c in cases.items()]), lambda x: x.isNotNull())).alias("problem"))
    return flagged.unionByName(twice)
