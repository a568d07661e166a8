"""Pieces that the corpus operators share: table access, Arrow mapping, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut, shared_folder  # noqa: F401

ARROW_TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<binary>": pa.list_(pa.binary()),
}

#: Rows that are held as Python objects at once inside one Arrow batch.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True for the quarter of documents that no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as set it apart from the taken names and from one another."""
    held, found = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        found.append(name)
    return found


def append_columns(df: DataFrame, inputs: list[str], outputs: list[tuple[str, str]], make: Callable[[], Callable], keep: list[str] | None = None) -> DataFrame:
    """Add columns that a Python function computes batch by batch.

    make() runs once per task and gives a function from the lists of the input columns to the lists of the output columns.
    A column of df with the name of an output is replaced. keep: the columns of df to carry along (all by default).
    """
    names = [name for name, _ in outputs]
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    # inputs that are not carried along travel under names of their own
    source = df.select(*[F.col(f"`{c}`") for c in carried], *[F.col(f"`{c}`").alias(a) for c, a in zip(inputs, fresh(carried, *[f"_in_{i}" for i in range(len(inputs))]), strict=True)])
    schema = ddl([(c, df.schema[c].dataType.simpleString()) for c in carried] + outputs)
    kinds, n_carried, n_in = [ARROW_TYPES[kind] for _, kind in outputs], len(carried), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = work(*[part.column(n_carried + i).to_pylist() for i in range(n_in)])
                arrays = [part.column(i) for i in range(n_carried)] + [pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=carried + names)

    return source.mapInArrow(run, schema)


def sample_by_hash(df: DataFrame, key: str, group: str, per_group: int) -> DataFrame:
    """The per_group rows of each group whose hashed key is smallest: a bounded sample that does not depend on row order.

    group has few values (a language, a flag). Their rows are counted first; then only rows under the hash that about four
    times per_group rows stay below are ranked, so what is ranked does not grow with the table or the number of tasks.
    """
    from pyspark.sql import Window

    sizes = [(r[0], r[1]) for r in df.groupBy(group).count().collect() if r[0] is not None]
    if not sizes:
        return df.limit(0)
    hashed = F.xxhash64(F.col(key).cast("string"))
    share = F.create_map(*[F.lit(x) for name, n in sizes for x in (name, min(1.0, 4.0 * max(per_group, 16) / n))])
    near = df.filter(hashed.cast("double") / 2.0**64 + 0.5 <= share[F.col(group)])
    order, rank = Window.partitionBy(group).orderBy(hashed, F.col(key)), fresh(df.columns, "_rank")[0]
    return near.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= per_group).drop(rank)


#: Keys of most rows that a look-up sends to every executor; each other key holds at most a rank-th of the rows.
HOT_KEYS = 1000


def look_up(rows: DataFrame, found: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with found, which has one row for each value of keys and how many rows share it in the column size.

    A key that a large part of all rows share would be one task of a shuffled join, and the adaptive split of skewed joins
    does not act on a side that is an aggregation. So the HOT_KEYS keys of largest size, a bounded number, are sent to the
    executors and their rows stay where they are; the rows of every other key, of which none holds more than 1 / HOT_KEYS
    of the rows counted, are shuffled. how: inner or left. size is dropped.
    """
    flag = fresh([*rows.columns, *found.columns], "_hot")[0]
    # a total order: both uses of the aggregation must name the same keys
    hot = found.orderBy(F.desc(size), *keys).limit(HOT_KEYS).drop(size).withColumn(flag, F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left")
    far = marked.filter(F.col(flag).isNull()).select(*rows.columns).join(found.drop(size), keys, how)
    return marked.filter(flag).drop(flag).unionByName(far)
