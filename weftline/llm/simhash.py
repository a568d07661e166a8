"""Near-duplicate documents by SimHash.

Words are runs of other than ASCII white space, A-Z lower-cased; shingles of three words are hashed with XXH64 (seed 42);
a bit of the 64-bit fingerprint is set if it is set in over half of the hashes. Fingerprints that differ in at most
three bits are linked.

Links are found by an embedding: a fingerprint's bit counts in 32 segments of two bits. The Manhattan distance of two
such vectors is a lower bound of the bits they differ in. The segments are dealt into six groups; of a distance of up to
three at least three groups keep a distance of zero, so the range join becomes equality on the grid cells of three of the
six groups, in all twenty choices: twenty rows of 16 bytes for each different fingerprint. In a cell the bound is tested
first (bit counts in unary, so it is one popcount), then the fingerprints themselves. A cell's rows are compared in groups
of bounded size, and of the links found a spanning forest is passed on, never all pairs.

Equal fingerprints are one vertex from the start, whatever their number, and a fingerprint that very many documents share
is given its component without a shuffle of their rows.

Defined results:
- fewer than three words: the whole sequence is the only shingle; none, as in null or empty text: fingerprint zero
- rows with a null id: the fingerprint, component null; they link nothing
- rows that share an id: each row by its own text; equal rows give equal results
- a text of any length is one row; its hashes are counted a part at a time
- an empty table: no rows
- near_duplicates() returns its own columns only; one_of_each() all columns of the input, whatever their names
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import append_columns, cut, fresh, look_up
from weftline.llm.components import bounded_groups, connected_components

WORDS_OF_SHINGLE, SEED, MOST_BITS = 3, 42, 3
GROUPS = 6
#: Rows of a cell that are compared in one go.
BLOCK = 4096
#: Hashes whose bits are counted at once.
COUNTED = 65536


def fingerprint(text: str | None, words_of_shingle: int = WORDS_OF_SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= words_of_shingle:
        hashes = [hashed(b" ".join(words), SEED)]
    else:
        shingles = zip(*[words[i:] for i in range(words_of_shingle)], strict=False)
        hashes = [hashed(s, SEED) for s in map(b" ".join, shingles)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = np.array(hashes[at : at + COUNTED], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", words_of_shingle: int = WORDS_OF_SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint as a long."""
    return append_columns(docs, [text_col], [(name, "long")], lambda: lambda texts: ([fingerprint(t, words_of_shingle) for t in texts],), keep)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def unary(fp: np.ndarray) -> np.ndarray:
    """Each two-bit segment's bit count in unary: the Manhattan distance of count vectors is the popcount of the xor."""
    low = np.uint64(0x5555555555555555)
    first, second = (fp >> np.uint64(1)) & low, fp & low
    return ((first & second) << np.uint64(1)) | (first | second)


def grid_cells(fps: DataFrame, groups: int = GROUPS, most_bits: int = MOST_BITS) -> DataFrame:
    """(cell, fp): each fingerprint in the cell of every choice of groups - most_bits groups of segments.

    A cell is the hash of the choice and of the counts, in unary, of the segments chosen; cells that a hash puts together
    cost time only, as every link is verified.
    """
    low = 0x5555555555555555
    masks = [sum(3 << 2 * int(s) for s in part) for part in np.array_split(np.arange(32), groups)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    first, second = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(low)), F.col("fp").bitwiseAND(F.lit(low))
    counts = F.shiftleft(first.bitwiseAND(second), 1).bitwiseOR(first.bitwiseOR(second))
    cells = [F.xxhash64(F.lit(n), F.col("counts").bitwiseAND(signed(sum(masks[g] for g in choice)))) for n, choice in enumerate(itertools.combinations(range(groups), groups - most_bits))]
    return fps.select("fp", counts.alias("counts")).select(F.explode(F.array(*cells)).alias("cell"), "fp")


def forest(fp: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each is compared with those not reached before it."""
    edges, rest, rest_unary = [], fp, unary(fp)
    while len(rest):
        waiting, rest, rest_unary = [rest[0]], rest[1:], rest_unary[1:]
        while waiting and len(rest):
            x = waiting.pop()
            near = np.bitwise_count(rest_unary ^ unary(np.array([x]))[0]) <= most_bits
            if near.any():
                near[near] = bits_apart(rest[near], x) <= most_bits
                if near.any():
                    found = rest[near]
                    edges += [(int(np.int64(x.view(np.int64))), int(y)) for y in found.view(np.int64)]
                    waiting += list(found)
                    rest, rest_unary = rest[~near], rest_unary[~near]
    return edges


def near_links(fps: DataFrame, most_bits: int = MOST_BITS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect all that are at most most_bits apart."""
    met = bounded_groups(grid_cells(fps, groups, most_bits), "cell", "fp", block)
    tasks = met.select("cell", "first", "second", "fp").repartition("cell", "first", "second").sortWithinPartitions("cell", "first", "second")

    def links(own: list[int]) -> list[tuple[int, int]]:
        if len(own) == 2:
            a, b = own
            return [(a, b)] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= most_bits else []
        return forest(np.array(own, dtype=np.int64).view(np.uint64), most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, found = None, [], []
        for batch in batches:
            for *key, fp in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != at:
                    found += links(own) if len(own) > 1 else []
                    at, own = key, []
                own.append(fp)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
                found = []
        found += links(own) if len(own) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def hex_fingerprint(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    return judged(docs, text_col, id_col, **options).drop("print")


def judged(docs: DataFrame, text_col: str, id_col: str, words_of_shingle: int = WORDS_OF_SHINGLE, most_bits: int = MOST_BITS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, print, component_id) for each row; print tells texts apart."""
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("_text"))
    rows = cut(with_fingerprint(source, "_text", words_of_shingle=words_of_shingle, keep=["doc_id", "print"]))
    known = rows.filter("doc_id is not null")
    found = look_up(known, labels_of(known, most_bits, groups, block), ["fp"], "n").select("doc_id", "fp", "print", "component_id")
    return found.unionByName(rows.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def labels_of(known: DataFrame, most_bits: int, groups: int, block: int) -> DataFrame:
    """(fp, component_id, n) for each fingerprint of known (doc_id, fp); n is the number of its rows."""
    fps = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(near_links(fps, most_bits, groups, block))
    linked = cut(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", "n", F.coalesce("root", "fp").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return cut(look_up(linked, smallest, ["root"], "members").select("fp", "component_id", "n"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay when of each component only the document with the smallest id does.

    Rows with a null id stay. Of rows with the same id and fingerprint one text stays, that of the smallest hash, and of rows
    with that text the one that sorts first. Texts are known again by a hash that the JVM makes, so they are fingerprinted
    once, and cross the wire once.
    """
    kept = judged(docs, text_col, id_col, **options).filter("doc_id = component_id").groupBy("doc_id", "fp").agg(F.min("print").alias("print"))
    id_long, print_, rank = fresh(docs.columns, "_id", "_print", "_rank")
    own_id = F.col(f"`{id_col}`").cast("long")
    known = docs.filter(own_id.isNotNull()).withColumns({id_long: own_id, print_: F.xxhash64(F.col(f"`{text_col}`"))})
    known = known.join(kept.select("doc_id", "print").distinct().toDF(id_long, print_), [id_long, print_])
    order = Window.partitionBy(id_long, print_).orderBy(*[F.col(f"`{c}`") for c in docs.columns if orderable(docs.schema[c].dataType)])
    first = known.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return first.unionByName(docs.filter(own_id.isNull()))


def orderable(kind: T.DataType) -> bool:
    """Whether Spark can sort by a column of this type: maps and variants have no order, wherever they are nested."""
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    return not isinstance(kind, T.MapType | T.VariantType)
