"""Writers: columnar tables, exhibits, canonical JSON, byte-stable bundles, exports with a manifest."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.functions.hashing import content_hash


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> dict:
    """Parquet with zstd, and what was written: rows and a hash of the content that does not depend on row order."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return {"path": path, "rows": back.count(), "content": content_hash(back)}


def write_exhibit(df: DataFrame, path: str, volatile: tuple[str, ...] = ("decided_at_utc",)) -> dict:
    """Gzip CSV with a header, and what was written: rows and a hash of the content, without the volatile columns, that does not
    depend on row order."""
    df.write.mode("overwrite").option("compression", "gzip").option("header", True).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in df.columns])
    back = df.sparkSession.read.csv(path, header=True, schema=schema)
    return {"path": path, "rows": back.count(), "content": content_hash(back.drop(*volatile))}


def write_scored(df: DataFrame, path: str, run_id: str, method: str) -> dict:
    """Unrounded scored pairs by fold, and beside them which run and method they are of and a hash of their content."""
    written = write_table(df, path, ("fold",))
    about = {"run_id": run_id, "method_version": method, "rows": written["rows"], "content": written["content"]}
    write_text(df.sparkSession, json.dumps(about, sort_keys=True), f"{path}.about.json")
    return about


def read_scored(spark: SparkSession, path: str, run_id: str, method: str) -> DataFrame | None:
    """The scored pairs of that run and method, or None if there are none, or others, or their content is not what was written."""
    from weftline.sources.dumps import exists

    if not exists(spark, f"{path}.about.json") or not exists(spark, path):
        return None
    about = json.loads(read_text(spark, f"{path}.about.json"))
    if (about["run_id"], about["method_version"]) != (run_id, method):
        return None
    back = spark.read.parquet(path)
    return back if content_hash(back) == about["content"] else None


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file, written through the file system that the path names, wherever the tables are."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def canonical(obj) -> str:
    """Sorted keys, one space of indent, ASCII, finite numbers only, a newline at the end."""

    def finite(x):
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError(f"not a finite number: {x}")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list | tuple) else ():
            finite(y)

    finite(obj)
    return json.dumps(obj, sort_keys=True, indent=1, ensure_ascii=True, allow_nan=False) + "\n"


def sha256_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sha256_canonical(obj) -> str:
    return hashlib.sha256(canonical(obj).encode()).hexdigest()


def invalid(obj, schema: dict, at: str = "$") -> list[str]:
    """What breaks a schema of the keywords type, enum, required, properties, additionalProperties, items, minimum, maximum."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted or []
    fits = [k for k in wanted if isinstance(obj, kinds[k]) and not (isinstance(obj, bool) and k in ("integer", "number"))]
    if wanted and not fits:
        return [f"{at}: {'/'.join(wanted)} expected"]
    found = []
    if "enum" in schema and obj not in schema["enum"]:
        found.append(f"{at}: not one of {schema['enum']}")
    if isinstance(obj, int | float) and not isinstance(obj, bool):
        if obj < schema.get("minimum", -math.inf) or obj > schema.get("maximum", math.inf):
            found.append(f"{at}: out of range")
    if isinstance(obj, dict):
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in obj]
        known = schema.get("properties", {})
        for k, v in obj.items():
            if k in known:
                found += invalid(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not allowed")
    if isinstance(obj, list) and "items" in schema:
        for i, v in enumerate(obj):
            found += invalid(v, schema["items"], f"{at}[{i}]")
    return found


def write_json(obj, path: str, schema: dict | None = None, spark: SparkSession | None = None) -> str:
    """Validate, write, and give the hash of what was written. With a session the file goes where the path says, a store of
    the cluster for instance; without one to a folder of the driver."""
    if schema and (problems := invalid(obj, schema)):
        raise ValueError("; ".join(problems[:10]))
    if spark is not None:
        write_text(spark, canonical(obj), path)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(canonical(obj), encoding="ascii")
    return hashlib.sha256(canonical(obj).encode()).hexdigest()


def bundle_bytes(rows: DataFrame, columns: tuple[str, ...], order_by: str) -> bytes:
    """A gzip CSV that is the same to the byte for the same rows: shortest floats, empty nulls, no time stamp.

    The rows come to the driver one partition at a time; a bundle is a published file of one row for each test record.
    """
    cell = lambda x: "" if x is None else ("true" if x else "false") if isinstance(x, bool) else repr(x) if isinstance(x, float) else str(x)
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as z:
        z.write((",".join(columns) + "\n").encode())
        for row in rows.orderBy(order_by).select(*columns).toLocalIterator():
            z.write((",".join(map(cell, row)) + "\n").encode())
    return out.getvalue()


def export(models: dict[str, DataFrame], path: str, hidden: frozenset[str] = frozenset()) -> dict:
    """Every model as CSV and JSON under path, and a manifest of their row counts."""
    manifest = {}
    for name, df in models.items():
        if name in hidden:
            continue
        one = df.coalesce(1)  # the marts are small, and each is one file
        one.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
        one.write.mode("overwrite").json(f"{path}/{name}.json")
        manifest[name] = df.count()
    return manifest


def forbidden_keys(obj, keys: frozenset[str], at: str = "$") -> list[str]:
    """Where a nested object holds a key that must not be published."""
    found = []
    if isinstance(obj, dict):
        for k, v in obj.items():
            found += ([f"{at}.{k}"] if k in keys else []) + forbidden_keys(v, keys, f"{at}.{k}")
    elif isinstance(obj, list):
        for i, v in enumerate(obj):
            found += forbidden_keys(v, keys, f"{at}[{i}]")
    return found


def resolve(obj, path: str):
    """The value at a dotted path with indices and quoted keys: a.b[2]["x.y"]"""
    import re

    for dotted, index, quoted in re.findall(r"([^.\[\]]+)|\[(\d+)\]|\[\"([^\"]*)\"\]", path):
        obj = obj[int(index)] if index else obj[quoted or dotted]
    return obj
