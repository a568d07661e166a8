"""Packing token sequences into as few fixed-length sequences as can be found.

Bin completion: around the largest piece left, the undominated fillings of the room beside it are enumerated; a branch is
cut when the waste so far shows that it cannot beat the best solution known, and a best-fit solution is the first such.
A quick search tries a few fillings of each sequence; only if it ends above the lower bound are all of them tried.

The search is exact on the counts of lengths until FILLING_NODES, PLAN_NODES or PLAN_BRANCHES is used up; then the best
packing found so far stands. Every row says which it is: lower_bound is a number of sequences that no packing goes below,
proven whether the packing is known to be the shortest, by meeting that bound or by a search that came to its end.

The search needs the number of pieces of each length only, at most one count for each length up to the capacity, however
many documents there are. Its result, a list of runs (length, first rank, first sequence, offset, number), is bounded by
the capacity too. Pieces get their rank among those of their length from counts by (length, salt), so that a length
which a third of all pieces have is dealt out over many tasks; the salt is the hash of a row's number, so rows without an
id, of one id or equal in every column are dealt out as well.

Defined results:
- text null or empty: one piece, the end token alone
- tokens over the capacity: cut into pieces of the capacity; the last may be shorter
- an empty table: no pieces
- rows with null or repeated ids: each row is a document of its own, its pieces carry the id as it is
- rows equal in every column: their pieces take different places
- a text of any length is one row, encoded by one task and cut
- columns of the input beside the id and the text, whatever their names, are not looked at
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bpe import load
from weftline.llm.common import SLICE, cut

CAPACITY, END_ID = 4096, 1
#: Fillings looked at for one sequence, and sequences planned in all before the best solution so far stands.
FILLING_NODES, PLAN_NODES = 4000, 10_000
#: Branches of fillings that the search beyond the quick plan looks at in all.
PLAN_BRANCHES = 2_000_000
#: Pieces of one length that a task ranks, about.
RANKED_TOGETHER = 200_000


def token_pieces(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32) for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(path), struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(at, SLICE), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packed = bpe.packed(text) + end
                    for piece, start in enumerate(range(0, len(packed) // 4, capacity)):
                        own = packed[4 * start : 4 * (start + capacity)]
                        rows.append((doc, piece, start, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def quick_fillings(room: int, lengths: list[int], left: dict[int, int], nodes: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """A few of the fillings() of room, found with few branches: of more than three of a length only some numbers are tried.

    A perfect filling ends the search. The most that fit are tried first, so the first leaf is the best-fit filling.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    least = next((x for x in lengths if left[x]), None)
    best, steps = room + 1, 0
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(room, len(lengths), ())]
    while stack and steps < nodes and best:
        steps += 1
        free, below, chosen = stack.pop()
        at = bisect.bisect_right(lengths, free, 0, below) - 1
        while at >= 0 and not left[lengths[at]]:
            at -= 1
        if at < 0:
            used = dict(chosen)
            dominated = least is not None and free >= least and any(left[x] > used.get(x, 0) for x in lengths[: bisect.bisect_right(lengths, free)])
            if not dominated and free < best:
                best = free
                found.append((free, chosen))
            continue
        length = lengths[at]
        most = min(left[length], free // length)
        # the branch without this length comes last; the one with the most of it first
        stack.append((free, at, chosen))
        for n in range(1, most + 1) if most <= 3 else (1, most - 1, most):
            stack.append((free - n * length, at, (*chosen, (length, n))))
    return sorted(found, key=lambda x: x[0])[:3] or [(room, ())]


def quick_plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = PLAN_NODES) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """A first plan(), from a few fillings of each sequence, each used as often as it can be."""
    total = sum(length * n for length, n in counts.items())
    floor = least_sequences(counts, capacity)
    best: list | None = None
    best_bins, steps = sum(counts.values()) + 1, 0
    start = {length: n for length, n in counts.items() if n}
    # (pieces left, tokens left, sequences used, fillings used); alternatives are looked at deepest first
    stack = [(start, total, 0, ())]
    while stack and best_bins > floor:
        left, tokens, bins, used = stack.pop()
        if bins + -(-tokens // capacity) >= best_bins:
            continue  # the waste so far is as much as the best solution's
        left = dict(left)
        lengths = sorted(left)
        own = []
        while lengths:
            largest = lengths[-1]
            left[largest] -= 1
            ways = quick_fillings(capacity - largest, lengths, left, FILLING_NODES)
            left[largest] += 1
            steps += 1
            options = []
            for _, chosen in ways:
                pattern = dict(chosen)
                pattern[largest] = pattern.get(largest, 0) + 1
                options.append((tuple(sorted(pattern.items(), reverse=True)), min(left[x] // k for x, k in pattern.items())))
            if steps < nodes:
                for pattern, times in options[:0:-1]:
                    after = {x: n - times * dict(pattern).get(x, 0) for x, n in left.items()}
                    spent = times * sum(x * k for x, k in pattern)
                    if bins + times + -(-(tokens - spent) // capacity) < best_bins and len(stack) < 64:
                        stack.append(({x: n for x, n in after.items() if n}, tokens - spent, bins + times, (*used, *own, (pattern, times))))
            pattern, times = options[0]
            own.append((pattern, times))
            bins += times
            for x, k in pattern:
                left[x] -= times * k
                tokens -= times * k * x
                if not left[x]:
                    del left[x]
                    lengths.pop(bisect.bisect_left(lengths, x))
            if bins + -(-tokens // capacity) >= best_bins:
                break
        else:
            best, best_bins = [*used, *own], bins
        if steps >= nodes:
            break
    return best or []


def fillings(room: int, lengths: list[int], left: dict[int, int], nodes: int, perfect_ends: bool = True) -> tuple[list[tuple[int, tuple[tuple[int, int], ...]]], int, bool]:
    """Undominated ways to fill room with pieces that are left, least waste first, as (waste, ((length, number), ...)), the
    branches looked at, and whether these were all.

    lengths: ascending. A filling is dominated if another piece still fits into its waste. Every number of each length is
    tried, the most that fit first, so the first leaf is the best-fit filling; the search stops after nodes branches.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def below(free: int, at: int) -> int:
        at = bisect.bisect_right(lengths, free, 0, at) - 1
        while at >= 0 and not left[lengths[at]]:
            at -= 1
        return at

    # (room, place of the length, its number or -1 for the most, the least length of which one more would fit, what is chosen)
    stack: list[tuple[int, int, int, int, tuple[tuple[int, int], ...]]] = [(room, below(room, len(lengths)), -1, room + 1, ())]
    steps = 0
    while stack and steps < nodes:
        steps += 1
        free, at, n, bound, chosen = stack.pop()
        if at < 0:
            if free < bound:
                found.append((free, chosen))
                if perfect_ends and not free:
                    break
            continue
        length = lengths[at]
        most = min(left[length], free // length)
        n = most if n < 0 else n
        if n and below(length - 1, at) >= 0:  # fewer of the smallest piece are dominated
            stack.append((free, at, n - 1, bound, chosen))
        after = free - n * length
        stack.append((after, below(after, at), -1, length if n < most else bound, (*chosen, (length, n)) if n else chosen))
    return sorted(found, key=lambda x: x[0]) or [(room, ())], steps, not stack


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A number of sequences that no packing goes below.

    For a small length s, pieces over capacity - s fill a sequence alone, and of the others those over half the capacity
    cannot share one; pieces from s up to half go into the room beside these before they need sequences of their own.
    """
    number = np.zeros(capacity + 2, np.int64)
    for x, n in counts.items():
        number[x] = n
    size = number * np.arange(capacity + 2)
    # pieces, and tokens, of all lengths below
    n_below, t_below = np.concatenate([[0], number.cumsum()]), np.concatenate([[0], size.cumsum()])
    half = capacity // 2  # lengths up to it are not over half the capacity
    s = np.array([0] + [x for x in counts if x <= half and counts[x]])
    top = capacity - s
    halves, their_tokens = n_below[np.maximum(top, half) + 1] - n_below[half + 1], t_below[np.maximum(top, half) + 1] - t_below[half + 1]
    alone = n_below[-1] - n_below[np.maximum(top, half) + 1]
    small = t_below[half + 1] - t_below[s]
    over = small - (capacity * halves - their_tokens)
    return int((alone + halves + np.maximum(0, -(-over // capacity))).max())


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = PLAN_NODES, branches: int = PLAN_BRANCHES) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The fillings of search() alone."""
    return search(counts, capacity, nodes, branches)[0]


def search(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = PLAN_NODES, branches: int = PLAN_BRANCHES) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int, bool]:
    """(fillings of sequences and how often each is used, the lower bound, whether nothing shorter is possible), from the
    number of pieces of each length.

    The quick plan stands if it is as short as can be; else all fillings and numbers of uses are searched for a shorter one.
    """
    total = sum(length * n for length, n in counts.items())
    floor, whole = least_sequences(counts, capacity), True
    start = {length: n for length, n in counts.items() if n}
    best = quick_plan(counts, capacity, nodes)
    best_bins, steps = sum(times for _, times in best), 0

    def remaining(used) -> dict[int, int]:
        left = dict(start)
        while used:
            used, (pattern, times) = used
            for x, k in pattern:
                left[x] -= times * k
        return {x: n for x, n in left.items() if n}

    def ways(left: dict[int, int], lengths: list[int], every: bool):
        """(filling with the largest piece left, the most it can be used) for the filling of least waste, or for every one."""
        nonlocal branches, whole
        largest = lengths[-1]
        left[largest] -= 1
        found, looked_at, all_of_them = fillings(capacity - largest, lengths, left, FILLING_NODES, not every)
        branches -= looked_at
        whole = whole and (all_of_them or not every)
        left[largest] += 1
        for _, chosen in found if every else found[:1]:
            pattern = dict(chosen)
            pattern[largest] = pattern.get(largest, 0) + 1
            yield tuple(sorted(pattern.items(), reverse=True)), min(left[x] // k for x, k in pattern.items())

    def others(used, first):
        """What can be done instead of first: other fillings, then any of them fewer times."""
        left = remaining(used)
        every = list(ways(left, sorted(left), True))
        yield from (way for way in every if way != first)
        yield from ((pattern, times) for pattern, most in every for times in range(most - 1, 0, -1))

    # [tokens left, sequences used, chain of the fillings used, the way taken there, an iterator over the others]; deepest first
    stack: list[list] = []
    tokens, bins, used = total, 0, None
    while best_bins > floor:
        left = remaining(used)
        lengths = sorted(left)
        while lengths and bins + -(-tokens // capacity) < best_bins and steps < nodes and branches > 0:
            steps += 1
            way = next(ways(left, lengths, False))
            stack.append([tokens, bins, used, way, None])
            pattern, times = way
            used, bins = (used, way), bins + times
            for x, k in pattern:
                left[x] -= times * k
                tokens -= times * k * x
                if not left[x]:
                    del left[x]
                    lengths.pop(bisect.bisect_left(lengths, x))
        if not lengths and bins < best_bins:
            best, best_bins, chain = [], bins, used
            while chain:
                chain, way = chain
                best.append(way)
            best.reverse()
        way = None
        while stack and way is None and best_bins > floor and steps < nodes and branches > 0:
            tokens, bins, used, first, rest = top = stack[-1]
            if bins + -(-tokens // capacity) < best_bins:  # else the waste so far is as much as the best solution's
                if rest is None:
                    steps += 1
                    rest = top[4] = others(used, first)
                way = next(rest, None)
            if way is None:
                stack.pop()
        if way is None:
            break
        pattern, times = way
        used, bins, tokens = (used, way), bins + times, tokens - times * sum(x * k for x, k in pattern)
    # the search came to its end if nothing is left to try and no limit cut it short
    return best, floor, best_bins <= floor or whole and not stack and steps < nodes and branches > 0


def runs(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, number in a sequence), sorted: pieces of a length by their rank."""
    rows, rank, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, number in pattern:
            first = rank.get(length, 0)
            rows.append((length, first, sequence, offset, number))
            rank[length] = first + times * number
            offset += number * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Add rank: the position of each piece among those of its length."""
    salts = int(min(4096, max(64, total // RANKED_TOGETHER)))
    # numbered by their places in the files of the checkpoint
    salted = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    order = Window.partitionBy("length", "_salt").orderBy("_row")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return salted.withColumn("_own", F.row_number().over(order) - 1).join(counts, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_own"))


def pack(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset, lower_bound, proven) for each piece."""
    pieces = cut(token_pieces(docs, path, text_col, id_col, capacity, end_id))
    # one row for each length, capacity rows at most
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    patterns, floor, proven = search(counts, capacity)
    table = runs(patterns)
    keys = table[:, 0] << 40 | table[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((keys, table))  # bounded by capacity, not by rows
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence, place_in = np.divmod(rank - table[at, 1], table[at, 4])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(table[at, 2] + sequence), pa.array(table[at, 3] + place_in * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(place, fields).withColumns({"lower_bound": F.lit(floor).cast("long"), "proven": F.lit(proven)})
