"""Connected components of a link table, and groups of bounded size for comparing the rows of a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import HOT_KEYS, cut, fresh, look_up


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it is connected with.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest neighbour, then
    its smaller neighbours and itself to the smallest of these. The number of rounds grows with the logarithm of the
    longest path. Both are a minimum for each node and a look-up, so a node with very many links is pre-aggregated, and its
    rows are not shuffled for the look-up; nothing is gathered by node. Each round is written to the checkpoint folder.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(tidy(links.select("a", "b")))
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = cut(tidy(look_up(both.filter("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = look_up(large, least, ["a"], "n")
        edges = cut(tidy(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))))
        now = mark(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def bounded_groups(rows: DataFrame, cell: str, spread: str, block: int, few_singles: bool = False) -> DataFrame:
    """Rows with the groups they are to be compared in: cell, first, second (blocks of the cell) and side.

    Cells of one row go, unless there are few_singles: then they stay, and only the cells that are cut are looked up. A cell
    of up to block rows is one group. A larger one is cut into blocks by the hash of spread; each two blocks, and each block
    with itself, are a group, so no task holds more than about two blocks and each pair of rows meets once. side is 0 in the
    first block of a group and 1 in the second. The rows of the largest cells are looked up without a shuffle.
    """
    blocks, own, other = fresh(rows.columns, "_blocks", "_own", "_other")
    sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (block if few_singles else 1)).select(cell, F.ceil(F.col("n") / block).cast("int").alias(blocks), "n")
    if not few_singles:
        placed = look_up(rows, sizes, [cell], "n")
    else:
        sizes = cut(sizes)
        # counted, and so bounded
        placed = rows.join(F.broadcast(sizes.drop("n")), cell, "left") if sizes.count() <= HOT_KEYS else look_up(rows, sizes, [cell], "n", "left")
        placed = placed.withColumn(blocks, F.coalesce(blocks, F.lit(1)))
    met = placed.withColumn(own, F.pmod(F.xxhash64(spread), F.col(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return met.withColumns({"first": F.least(own, other), "second": F.greatest(own, other), "side": (F.col(own) > F.col(other)).cast("int")}).drop(own, other, blocks)
