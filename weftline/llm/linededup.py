"""Exact deduplication of lines across documents.

Lines are exploded, normalised and hashed; documents are counted for each hash; lines whose hash is in enough documents
are dropped everywhere but in the document with the smallest id; the others are put together again by position.

A line's key is the line without the ASCII white space at both ends, with A-Z lower-cased. Keys are compared by a 128-bit
hash. Exploded lines are hashes and positions, written once to the shared folder; texts cross the wire once, to meet the
positions that they lose, and no step holds more than one document's lines. Documents of a hash are counted from distinct
pairs, and the hashes of most documents are looked up without a shuffle, so a line that very many documents share is
nobody's large task.

Defined results:
- text null or empty: one empty line, kept
- a document whose lines are all dropped: an empty text
- rows with a null id take no part: they are returned with all lines
- rows that share an id are one document; they lose the same lines
- a text of any length is one row; its lines are held by one task
- an empty table: no rows
- columns of the input named like an output column are replaced; all others are carried along, whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SLICE, append_columns, cut, fresh, look_up

MIN_CODE_POINTS, MIN_DOCUMENTS = 10, 2
SPACE = b" \t\n\v\f\r"


def line_keys(text: str | None, min_code_points: int) -> list[bytes | None]:
    """The hashed key of each line, None for lines too short to count."""
    import xxhash

    found: list[bytes | None] = []
    for line in (text or "").encode("utf-8").split(b"\n"):
        key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
        long = len(key) >= min_code_points and (len(key) >= 4 * min_code_points or len(key.decode("utf-8")) >= min_code_points)
        found.append(xxhash.xxh3_128_digest(key) if long else None)
    return found


def exploded_lines(docs: DataFrame, min_code_points: int) -> DataFrame:
    """(key, doc, print, pos) of each line that counts, of docs (doc, print, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, keys, ids, prints, places = batch.slice(at, SLICE), [], [], [], []
                for doc, print_, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    own = [(k, i) for i, k in enumerate(line_keys(text, min_code_points)) if k]
                    keys += [k for k, _ in own]
                    places += [i for _, i in own]
                    ids += [doc] * len(own)
                    prints += [print_] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(places, pa.int32())], names=["key", "doc", "print", "pos"])

    return docs.mapInArrow(run, "key binary, doc long, print long, pos int")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS, keep: list[str] | None = None, digest_only: bool = False) -> DataFrame:
    """Add n_lines, n_dropped and kept_text (with digest_only kept_sha256 instead)."""
    carried = docs.columns if keep is None else keep
    text, doc, print_, gone = fresh(carried, "_text", "_doc", "_print", "_lost")
    own_text, own_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], own_text.alias(text), own_id.alias(doc), F.xxhash64(own_text).alias(print_))
    # rows that share an id are told apart by their texts
    lines = cut(exploded_lines(rows.filter(F.col(doc).isNotNull()).select(doc, print_, text), min_code_points))
    documents = lines.groupBy("key", "doc").agg(F.count(F.lit(1)).alias("rows"))
    shared = documents.groupBy("key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("documents"), F.sum("rows").alias("rows")).filter(F.col("documents") >= min_documents).drop("documents")
    lost = look_up(lines, shared, ["key"], "rows").filter("doc > first")
    lost = lost.groupBy(F.col("doc").alias(doc), F.col("print").alias(print_)).agg(F.collect_set("pos").alias(gone))
    # rows that lose nothing and have a null id, which would all meet in one task, stay out of the join
    joined = rows.filter(F.col(doc).isNotNull()).join(lost, [doc, print_], "left").select(*[F.col(f"`{c}`") for c in carried], text, gone)
    without = rows.filter(F.col(doc).isNull()).select(*[F.col(f"`{c}`") for c in carried], text, F.lit(None).cast("array<int>").alias(gone))

    def make():
        def work(texts, lost):
            n, dropped, kept = [], [], []
            for text, places in zip(texts, lost, strict=True):
                lines = (text or "").split("\n")
                away = set(places or ())
                out = "\n".join([line for i, line in enumerate(lines) if i not in away]) if away else text or ""
                n.append(len(lines))
                dropped.append(len(away))
                kept.append(hashlib.sha256(out.encode()).hexdigest() if digest_only else out)
            return n, dropped, kept

        return work

    return append_columns(joined.unionByName(without), [text, gone], [("n_lines", "long"), ("n_dropped", "long"), ("kept_sha256" if digest_only else "kept_text", "string")], make, carried)
