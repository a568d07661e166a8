"""Exact top-k inner products over quantised vectors with a bit-sliced index.

Vectors are quantised to whole numbers and kept in blocks of rows. A block holds, for each component, one bitmap over its
rows for every bit of the (shifted, so non-negative) values. A query's scores are added up for all rows of a block at once:
each non-zero signed digit of a query component adds that component's slices at the digit's weight (complemented for a
negative digit; the constants this leaves are the same for every row), and bitmaps of one weight are reduced three to two
by full adders until each weight has one. The rows of highest score are then chosen from the most significant slice
downward; rows that are still equal after the last slice are resolved by the smaller id. A block hands on k rows for each
query at most, and the best k of all blocks remain.

Queries are dealt into batches; a task gets a block and after it a bounded share of the batches, so nothing is broadcast and
the work of a task is bounded by the sizes of a block and of a share. A block crosses the wire once for each share of the
batches and a batch once for each block, so a row that is sent is worth BLOCK_ROWS or SHARE_QUERIES scores: what is shuffled
stays that much smaller than the scores to be found, and is linear in the rows up to SHARE_QUERIES queries.

Defined results:
- vectors null, empty, or with null or non-finite components take no part, nor do rows with a null id
- a quantised component, or a score among the k best, that does not fit a long: OverflowError; other scores may be of any size
- vectors of different length: the shorter one counts as padded with zeros
- rows that share an id are different rows: each is a candidate of the others and, as a query, gets its own k rows
- columns of the input beside the id and the vector, whatever their names, are not looked at
- fewer than k candidates: all of them; a table without queries or without rows: no rows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import append_columns, cut

SCALE, TOP = 1024, 10
#: Rows of a block at most, and of one that is made smaller so that all cores have a block; queries of a batch and of a task.
BLOCK_ROWS, SMALL_BLOCK, BATCH_QUERIES, SHARE_QUERIES = 16384, 2048, 64, 4096


def quantise(vector, scale: int = SCALE) -> bytes | None:
    """floor(scale * x) of each component as little-endian 64-bit integers, or None if the vector takes no part."""
    if not vector or any(x is None for x in vector):
        return None
    given = np.array(vector, dtype=np.float64)
    if not np.isfinite(given).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(scale * given)
    if x.min() < -(2.0**63) or x.max() >= 2.0**63:
        raise OverflowError("a quantised component does not fit a long")
    return x.astype("<i8").tobytes()


def signed_digits(x: int) -> list[tuple[int, int]]:
    """(weight, +1 or -1) of the non-adjacent form: no other signed binary form has fewer digits."""
    found, weight = [], 0
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            found.append((weight, digit))
            x -= digit
        x >>= 1
        weight += 1
    return found


class SlicedBlock:
    """Bitmaps of one block's values. Rows stand in the order of their ids, those of one id in that of their numbers."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, numbers: np.ndarray | None = None):
        """values: (rows, components) whole numbers; numbers tell rows apart (the ids by default)"""
        numbers = ids if numbers is None else numbers
        order = np.lexsort((numbers, ids))
        self.ids, values, self.numbers = ids[order], values[order], numbers[order]
        self.by_number = np.argsort(self.numbers)
        self.rows = len(ids)
        self.words = -(-self.rows // 64)
        self.low = values.min(axis=0)
        shifted = values.astype(np.uint64) - self.low.astype(np.uint64)  # of any two longs, modulo 2**64
        self.bits = [int(v).bit_length() for v in shifted.max(axis=0)]
        self.slices = []
        for j, bits in enumerate(self.bits):
            own = np.zeros((bits, self.words), np.uint64)
            for s in range(bits):
                own[s] = self.bitmap((shifted[:, j] >> np.uint64(s) & np.uint64(1)).astype(bool))
            self.slices.append(own)
        self.all = self.bitmap(np.ones(self.rows, bool))

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, bool)
        padded[: self.rows] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def flags(self, bitmap: np.ndarray) -> np.ndarray:
        return np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows].astype(bool)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of a non-negative sum, least significant first; what to add to it for the inner product)"""
        by_weight: dict[int, list[np.ndarray]] = {}
        constant = 0
        for j, x in enumerate(query.tolist()[: len(self.bits)]):
            constant += x * int(self.low[j])
            if not self.bits[j]:
                continue
            flipped = None
            for weight, digit in signed_digits(x):
                own = self.slices[j]
                if digit < 0:
                    flipped = ~own if flipped is None else flipped
                    own = flipped
                    constant -= ((1 << self.bits[j]) - 1) << weight
                for s in range(self.bits[j]):
                    by_weight.setdefault(weight + s, []).append(own[s])
        result, weight, carried = [], 0, []
        while by_weight or carried:
            stack = by_weight.pop(weight, []) + carried
            held, carried = (np.stack(stack) if stack else np.zeros((1, self.words), np.uint64)), []
            while len(held) > 1:
                third = len(held) // 3
                if third:
                    a, b, c = held[:third], held[third : 2 * third], held[2 * third : 3 * third]
                    either = a ^ b
                    carried += list((a & b) | (either & c))
                    held = np.concatenate([either ^ c, held[3 * third :]])
                else:
                    carried.append(held[0] & held[1])
                    held = (held[0] ^ held[1])[None]
            result.append(held[0])
            weight += 1
        return result, constant

    def top(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int, int]]:
        """The k rows of highest score but the one numbered own as (id, number, score), ties to the smaller id."""
        slices, constant = self.scores(query)
        sure, open_ = np.zeros(self.words, np.uint64), self.all
        if own is not None:
            at = int(np.searchsorted(self.numbers, own, sorter=self.by_number))
            at = int(self.by_number[at]) if at < self.rows else at
            if at < self.rows and self.numbers[at] == own:
                open_ = open_.copy()
                open_[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        n_sure = 0
        for own in reversed(slices):
            ones = open_ & own
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                open_ = ones
            elif n_sure + n == k:
                sure, n_sure, open_ = sure | ones, k, np.zeros_like(open_)
                break
            else:
                sure, n_sure, open_ = sure | ones, n_sure + n, open_ & ~own
        at = np.concatenate([np.nonzero(self.flags(sure))[0], np.nonzero(self.flags(open_))[0][: k - n_sure]])
        found = []
        for i in at.tolist():
            word, bit = i // 64, np.uint64(i % 64)
            found.append((int(self.ids[i]), int(self.numbers[i]), constant + sum(int(s[word] >> bit & np.uint64(1)) << w for w, s in enumerate(slices))))
        return found


def as_long(score: int) -> int | None:
    """The score, or None if it is too low for a long: it may not be among the best of all blocks. One too high always is."""
    if score >= 2**63:
        raise OverflowError("a score does not fit a long")
    return score if score >= -(2**63) else None


def padded(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), max(len(r) for r in rows) // 8), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, "<i8")
    return out


def quantised(vectors: DataFrame, vec_col: str, id_col: str, scale: int) -> DataFrame:
    """(vec_id, q), a row for each row that takes part."""
    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("_vec")).filter("vec_id is not null")
    return append_columns(source, ["_vec"], [("q", "binary")], lambda: lambda found: ([quantise(v, scale) for v in found],), ["vec_id"]).filter("q is not null")


def gathered(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """(name, ids, numbers, qs): rows dealt into parts of about equal size by the hash of their number."""
    rows = rows.groupBy(F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int").alias(name)).agg(F.collect_list(F.struct("vec_id", "number", "q")).alias("r"))
    return rows.select(name, F.col("r.vec_id").alias("ids"), F.col("r.number").alias("numbers"), F.col("r.q").alias("qs"))


def search(vectors: DataFrame, is_query: Column, k: int = TOP, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE, block_rows: int = BLOCK_ROWS, batch_queries: int = BATCH_QUERIES, share_queries: int = SHARE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query (a condition on vec_id) holds for, the k best other rows."""
    # the numbers follow from the places of the rows in the files that are written here
    rows = cut(quantised(vectors, vec_col, id_col, scale)).withColumn("number", F.monotonically_increasing_id())
    queries = rows.filter(is_query)
    n, n_queries = rows.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, batches = max(1, -(-n // block_rows), min(cores, n // min(SMALL_BLOCK, block_rows))), max(1, -(-n_queries // batch_queries))
    shares = -(-n_queries // share_queries) or 1
    # a block comes first and its query batches after it: the block crosses the wire once for each share of the batches
    own = gathered(rows, blocks, "block").select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "ids", "numbers", "qs")
    batched = gathered(queries, batches, "batch").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod("batch", F.lit(shares)).alias("share"), F.lit(1).alias("kind"), "ids", "numbers", "qs")
    # more partitions than tasks, so that few of these share one
    met = own.unionByName(batched).repartition(min(4 * blocks * shares, 100_000), "block", "share").sortWithinPartitions("block", "share", "kind")
    names = ["query_id", "query", "vec_id", "number", "score"]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in given:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    block = SlicedBlock(np.array(row["ids"], np.int64), padded(row["qs"]), np.array(row["numbers"], np.int64))
                    continue
                found = [(query, own, other, number, as_long(score)) for query, own, q in zip(row["ids"], row["numbers"], row["qs"], strict=True) for other, number, score in block.top(np.frombuffer(q, "<i8"), k, own)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    best = met.mapInArrow(run, ", ".join(f"{name} long" for name in names))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    kept = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # null, too low for a long, comes last
    return kept.select("query_id", "rank", "vec_id", F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long")).alias("score"))
