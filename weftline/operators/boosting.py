"""Boosted trees of the logistic loss, grown on counts of binned rows.

The trees are those of MLlib's GBTClassifier: the same bins, splits by variance, leaves of the mean residual, a first tree on the
labels themselves. Rows whose features fall into the same bins and that share a label are the same to every tree, so they are
counted once and the counts are trained on; no row is left out. The bins are found on all rows, where MLlib draws 10,000.

Counts of BLOCK_ROWS rows or fewer are one block, on which one task grows all trees. More are split into blocks, and each level of
a tree is a job that sums each block where it is; a worker keeps what it knows of its blocks, or makes it again from the trees.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

BINS = 32
#: Counted rows of a block.
BLOCK_ROWS = 500_000
#: Rows that are scored at once, and the least gain of a split: less is rounding.
SCORED_ROWS, LEAST_GAIN = 2_000, 1e-12


def edges_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The thresholds between bins of one feature, from its different values, ascending, and their weights."""
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    found, stride = [], weights.sum() / BINS
    target, reached = stride, np.cumsum(weights)
    for i in range(1, len(values)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            found.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(found)


def counts_of_labels() -> list[Column]:
    return [F.count_if(F.col("label") == x).alias(f"n{x}") for x in (0, 1)]


def all_edges(rows: DataFrame, features: list[Column], weights: tuple[float, float]) -> list[np.ndarray]:
    """edges_of() each feature over all rows. A task holds the different values of one feature."""

    def found(table: pa.Table) -> pa.Table:
        values, weight = table["value"].to_numpy(), table["n0"].to_numpy() * weights[0] + table["n1"].to_numpy() * weights[1]
        order = np.argsort(values)
        return pa.table({"feature": pa.array([table["feature"][0].as_py()], pa.int32()), "edges": pa.array([edges_of(values[order], weight[order]).tolist()], pa.list_(pa.float64()))})

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), f.cast("double").alias("value")) for i, f in enumerate(features)]))
    values = rows.select(each.alias("v"), "label").groupBy("v.feature", "v.value").agg(*counts_of_labels())
    got = {r["feature"]: np.array(r["edges"], float) for r in values.groupBy("feature").applyInArrow(found, "feature int, edges array<double>").collect()}
    return [got[i] for i in range(len(features))]


def binned(columns: Iterable[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features): a value at an edge is below it."""
    return np.stack([np.searchsorted(e, c, side="left").astype(np.uint8) for c, e in zip(columns, edges, strict=True)], axis=1)


@dataclass
class Tree:
    """The nodes' features and bins, in the order of levels, and the leaves' values. A node that is not split sends all to its left."""

    feature: np.ndarray
    cutoff: np.ndarray
    value: np.ndarray

    @classmethod
    def unsplit(cls, depth: int) -> Tree:
        return cls(np.zeros(2**depth - 1, np.int16), np.full(2**depth - 1, 255, np.uint8), np.zeros(2**depth))


class Block:
    """Counted rows, and how far the trees are known on them."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, weights: tuple[float, float]):
        order = np.lexsort(bins.T)  # sums are added up in the same order, whatever the order of the rows
        self.columns, n = np.ascontiguousarray(bins[order].T), n[order]
        self.rows, self.n = np.arange(len(n)), n.sum(axis=1).astype(float)
        self.own = n * np.array(weights)
        self.weight = self.own.sum(axis=1)
        self.margin, self.done, self.level, self.all = np.zeros(len(n)), -1, None, None

    def step(self, tree: Tree) -> None:
        self.node = 2 * self.node + 1 + (self.columns[tree.feature[self.node], self.rows] > tree.cutoff[self.node])
        self.level += 1

    def sums(self, made: list[Tree], tree: Tree, level: int, nodes: list[int]) -> np.ndarray:
        """(3, nodes, features, bins): rows, weights and weighted residuals of the growing tree's nodes."""
        if self.done != len(made):
            for past in made[max(self.done, 0) :]:
                if self.level is None:
                    self.node, self.level = np.zeros(len(self.rows), np.int64), 0
                while 2**self.level <= len(past.feature):
                    self.step(past)
                self.margin += past.value[self.node - len(past.feature)]
                self.level = None
            self.done, self.node, self.level = len(made), np.zeros(len(self.rows), np.int64), 0
            # of label 0 and of label 1; the first tree is on the labels
            residual = np.array([[-1.0, 1.0]]) if not made else np.stack([-4 / (1 + np.exp(-2 * self.margin)), 4 / (1 + np.exp(2 * self.margin))], axis=1)
            self.residual = (self.own * residual).sum(axis=1)
        while self.level < level:
            self.step(tree)
        if not level and self.all is None:
            self.all = [self.summed(np.zeros(len(self.rows), np.int64), slice(None), x, 1) for x in (self.n, self.weight)]
        if not level:
            return np.stack([*self.all, self.summed(self.node, slice(None), self.residual, 1)])
        slot = np.full(2 ** (level + 1) - 1, -1)
        slot[nodes] = np.arange(len(nodes))
        own = slot[self.node]
        used = np.nonzero(own >= 0)[0]
        return np.stack([self.summed(own[used], used, x[used], len(nodes)) for x in (self.n, self.weight, self.residual)])

    def summed(self, own: np.ndarray, used: np.ndarray | slice, x: np.ndarray, nodes: int) -> np.ndarray:
        first = own * BINS
        return np.stack([np.bincount(first + column[used], x, nodes * BINS).reshape(-1, BINS) for column in self.columns], axis=1)


def grow(sums: Callable[[list[Tree], Tree, int, list[int]], np.ndarray], trees: int, depth: int, rate: float, least_leaf: int) -> list[Tree]:
    """sums: Block.sums() over all blocks. Of two new nodes the one of fewer rows is summed, the other is what remains of their parent."""
    made: list[Tree] = []
    for _ in range(trees):
        tree, nodes, values, asked = Tree.unsplit(depth), [0], {}, [0]
        for level in range(depth):
            if not nodes:
                break
            got = dict(zip(asked, np.moveaxis(sums(made, tree, level, asked), 1, 0), strict=True))
            for node in nodes:
                if node not in got:
                    got[node] = above[(node - 1) // 2] - got[node + 1 if node % 2 else node - 1]
            at, above = np.stack([got[node] for node in nodes], axis=1), got
            n, w, s = at[:, :, 0].sum(axis=2)
            left = at.cumsum(axis=3)
            right = np.stack([n, w, s])[:, :, None, None] - left
            fits = (left[0] >= max(1, least_leaf)) & (right[0] >= max(1, least_leaf))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - (s**2 / w)[:, None, None]) / w[:, None, None]
            gain = np.where(fits, gain, -1.0).reshape(len(nodes), -1)
            best, split, asked = gain.argmax(axis=1), [], []
            for i, node in enumerate(nodes):
                values[node] = s[i] / w[i]
                if gain[i, best[i]] > LEAST_GAIN:
                    f, cutoff = divmod(int(best[i]), BINS)
                    tree.feature[node], tree.cutoff[node] = f, cutoff
                    for child, side in ((2 * node + 1, left), (2 * node + 2, right)):
                        values[child] = side[2, i, f, cutoff] / side[1, i, f, cutoff]
                        split.append(child)
                    asked.append(2 * node + 1 if left[0, i, f, cutoff] <= right[0, i, f, cutoff] else 2 * node + 2)
            nodes = split
        for node, value in sorted(values.items()):  # a leaf's value stands below it at the left; children come after their parents
            while node < len(tree.feature):
                node = 2 * node + 1
            tree.value[node - len(tree.feature)] = value * (rate if made else 1.0)
        made.append(tree)
    return made


#: Of one training: its name, and a worker's blocks by their number.
_held: tuple[str, dict[int, Block]] = ("", {})


def _block_of(run: str, i: int, parts: Iterator, weights: tuple[float, float]) -> Block | None:
    global _held
    if _held[0] != run:
        _held = (run, {})
    rows = list(parts)  # all is read even where the block is known, as Spark ends a worker that leaves rows
    if i not in _held[1] and rows:
        bins, n = rows[0]
        n = np.frombuffer(n, np.int64).reshape(-1, 2)
        _held[1][i] = Block(np.frombuffer(bins, np.uint8).reshape(len(n), -1), n, weights)
    return _held[1].get(i)


@dataclass
class Trees:
    edges: list[np.ndarray]
    made: list[Tree]

    def margin(self, bins: np.ndarray) -> np.ndarray:
        inner, n = len(self.made[0].feature), len(self.made)
        feature, cutoff = (np.concatenate([getattr(t, x) for t in self.made]) for x in ("feature", "cutoff"))
        value, first, out = np.concatenate([t.value for t in self.made]), np.arange(n) * inner, np.empty(len(bins))
        for start in range(0, len(bins), SCORED_ROWS):
            part = bins[start : start + SCORED_ROWS]
            row, flat, node = (np.arange(len(part)) * part.shape[1])[:, None], part.ravel(), np.zeros((len(part), n), np.int64)
            for _ in range(int(math.log2(inner + 1))):
                at = node + first
                node = 2 * node + 1 + (flat[row + feature[at]] > cutoff[at])
            out[start : start + SCORED_ROWS] = value[node - inner + np.arange(n) * (inner + 1)].sum(axis=1)
        return out

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of label 1. Rows in the same bins are scored once."""
        if not len(columns[0]):
            return np.empty(0)
        bins = binned(columns, self.edges)
        places, n = np.zeros(len(bins), np.int64), 1
        for f in range(bins.shape[1]):
            places, names = pd.factorize(places * BINS + bins[:, f])
            n = len(names)
        firsts = np.empty(n, np.int64)
        firsts[places[::-1]] = np.arange(len(bins))[::-1]
        return (1 / (1 + np.exp(-2 * self.margin(bins[firsts]))))[places]

    def score(self, features: list[Column]) -> Column:
        def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                yield pd.Series(self.probabilities([c.to_numpy(float) for c in columns]))

        return F.pandas_udf(scored, "double")(*[f.cast("double") for f in features])


def fit(rows: DataFrame, features: list[Column], weights: tuple[float, float], trees: int, depth: int, rate: float, least_leaf: int) -> Trees:
    """Trees for the rows' label, 0 or 1. weights: of a row with label 0 and with label 1. rows are read twice."""
    edges = all_edges(rows, features, weights)

    def in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *columns, hit = batch.columns
                bins = binned([c.to_numpy(zero_copy_only=False) for c in columns], edges)
                yield pa.record_batch([pa.array(bins.view(f"V{bins.shape[1]}").ravel().tolist(), pa.binary()), hit], names=["bins", "label"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches([pa.record_batch(b.columns, names=["bins", "n0", "n1"]) for b in batches], pa.schema([("bins", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())]))
        bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(table.num_rows, -1) if table.num_rows else np.empty((0, len(edges)), np.uint8)
        return bins, np.stack([table["n0"].to_numpy(), table["n1"].to_numpy()], axis=1)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = grow(Block(*gathered(batches), weights).sums, trees, depth, rate, least_leaf)
        yield pa.record_batch([pa.array([pickle.dumps(made)], pa.binary())], names=["trees"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, n = gathered(batches)
        if len(n):
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (bins, n)], names=["bins", "n"])

    in_columns = rows.select(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col("label").cast("int").alias("label"))
    counted = cut(in_columns.mapInArrow(in_bins, "bins binary, label int").groupBy("bins").agg(*counts_of_labels()))
    blocks = math.ceil(counted.count() / BLOCK_ROWS)
    if blocks <= 1:
        return Trees(edges, pickle.loads(counted.coalesce(1).mapInArrow(grown, "trees binary").first()["trees"]))
    run = uuid.uuid4().hex
    blocks = max(blocks, counted.sparkSession.sparkContext.defaultParallelism)
    held = counted.repartition(blocks, "bins").mapInArrow(packed, "bins binary, n binary").rdd.map(lambda r: (bytes(r["bins"]), bytes(r["n"]))).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(made: list[Tree], tree: Tree, level: int, nodes: list[int]) -> np.ndarray:
        def of(i: int, parts: Iterator) -> list[np.ndarray]:
            block = _block_of(run, i, parts, weights)
            return [] if block is None else [block.sums(made, tree, level, nodes)]

        return sum(held.mapPartitionsWithIndex(of).collect())

    try:
        return Trees(edges, grow(sums, trees, depth, rate, least_leaf))
    finally:
        held.unpersist()
