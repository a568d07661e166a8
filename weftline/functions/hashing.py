"""Hashes that results depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2**32 to the powers 7..0, modulo 100: a 256-bit number modulo 100 from its eight 32-bit words
WORD_WEIGHTS = tuple(pow(2**32, 7 - i, 100) for i in range(8))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def membership_hash(source: Column, native_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, native_id), 256)


def pair_hash(a_id: Column, b_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", a_id, b_id), 256)


def bucket100(native_id: Column) -> Column:
    """The SHA-256 of an id as a number, modulo 100."""
    digest = F.sha2(native_id, 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") % 100 * weight for i, weight in enumerate(WORD_WEIGHTS)]
    return (sum(parts[1:], parts[0]) % 100).cast("int")


def fold_of(native_id: Column) -> Column:
    bucket = bucket100(native_id)
    return F.when(bucket < 60, "fit").when(bucket < 80, "calibrate").otherwise("test")


def content_hash(df: DataFrame) -> str:
    """A hash of a frame's rows that does not depend on their order: two sums over row hashes, taken in one aggregation."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.select(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"))
    got = row.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.expr("bit_xor(g)")).first()
    return df.sparkSession.range(1).select(F.sha2(F.lit("|".join(map(str, got))), 256)).first()[0]


def index_hash(pairs: DataFrame, a: str = "a_id", b: str = "b_id") -> str:
    """The SHA-256 of the sorted lines a|b: names a set of pairs whatever their order.

    The lines are sorted on the executors and pass the driver one partition at a time.
    """
    return _lines_hash(pairs.select(F.concat_ws("|", F.col(a), F.col(b)).alias("line")))


def id_order_hash(ids: DataFrame, column: str = "a_id") -> str:
    """The SHA-256 of the ids in ascending order, a line each."""
    return _lines_hash(ids.select(F.col(column).alias("line")))


def _lines_hash(lines: DataFrame) -> str:
    import hashlib

    digest, first = hashlib.sha256(), True
    for (line,) in lines.orderBy("line").toLocalIterator():
        digest.update(line.encode() if first else b"\n" + line.encode())
        first = False
    return digest.hexdigest()


def sorted_digest(df: DataFrame) -> str:
    """A hash of a frame's content: rows as text (lists joined by 0x1F, null as 0x00), sorted by all columns, hashed one after
    another. Sorting makes it independent of row order, and unlike content_hash() it is that of the rows themselves."""
    cells = []
    for c in sorted(df.columns):
        kind = df.schema[c].dataType.typeName()
        text = F.array_join(F.col(f"`{c}`").cast("array<string>"), "\x1f", "\x00") if kind == "array" else F.to_json(F.col(f"`{c}`")) if kind in ("struct", "map") else F.col(f"`{c}`").cast("string")
        cells.append(F.coalesce(text, F.lit("\x00")))
    return _lines_hash(df.select(F.sha2(F.array_join(F.array(*cells), "\x1e"), 256).alias("line")))


def threshold_fraction(threshold: str) -> float:
    """A 64-digit hexadecimal threshold as a share of all hashes."""
    return int(threshold, 16) / 2**256
