"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of lexicon words and lexicon word starts, how many of them stand near a word of
address, the shares of capitals and of punctuation, and rates of obfuscated spelling (marks or digits inside words,
stretched letters, letters set apart) with the lexicon words that undoing it brings to light.

The lexicon holds words and word starts that are far more frequent in texts labelled toxic. It, the trees and the
calibration are learned from one bounded sample of labelled rows (SAMPLE_ROWS by hashed id), exact copies once.

Defined results:
- text null or empty: all densities zero, the score of a text without any sign
- no labelled rows, or only one label among them: every score is that label's share (0 without any)
- several labels for one id: toxic if one of them says so; several texts for one id: one of them is learned from
- repeated rows and null ids: each row is scored on its text alone
- a text of any length is one row; its words are held by one task
- columns of the input named like an output column are replaced; all others are carried along, whatever their names
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SLICE, append_columns, cut

SAMPLE_ROWS = 20_000
#: Letters of a word start, the fewest texts with a lexicon entry, and how much more frequent in toxic texts it is.
START_LETTERS, LEAST_TEXTS, LIFT = 5, 10, 12.0
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 20.0
NEAR_WORDS = 6
PREDICTED_FROM = 0.3

# Words of address in the four languages at hand.
ADDRESS = frozenset("you your yours you're ur u du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
# Characters that stand for letters in disguised spelling.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": "", "_": "", "-": "", ".": ""})

WORD = re.compile(r"[^\W\d_]+")
# a run of letters is tried from its first letter only: what does not match from there does not match from a later one
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$!|+*_\-.]+[^\W\d_]+)+|[0-9@$|]+[^\W\d_]+(?:[0-9@$!|+*]+[^\W\d_]+)*")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
APART = re.compile(r"\b[^\W\d_](?:[ .\-_*][^\W\d_]\b){3,}")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
MARKS, SHOUTS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"!?"
NAMES = ("hits", "hit_density", "start_hits", "start_density", "near_address", "address_density", "capitals", "marks", "shouts", "disguised_rate", "disguised_hits", "stretched_rate", "length")


def undone(token: str) -> str:
    return re.sub(r"([^\W\d_])\1{2,}", r"\1", token.lower().translate(DISGUISE))


@dataclass(frozen=True)
class Lexicon:
    words: frozenset = frozenset()
    starts: frozenset = frozenset()


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n, data = max(1, len(words)), text.encode("utf-8", "replace")
    size = max(1, len(data))
    present = lexicon.words.intersection(words)
    hits = sum(map(words.count, present)) if len(present) < 4 else sum(w in present for w in words)
    starts = [w[:START_LETTERS] for w in words if len(w) > START_LETTERS] if lexicon.starts else []
    started = lexicon.starts.intersection(starts)
    start_hits = sum(map(starts.count, started)) if len(started) < 4 else sum(w in started for w in starts)
    address = near = 0
    if not ADDRESS.isdisjoint(words):
        at = [i for i, w in enumerate(words) if w in ADDRESS]
        address = len(at)
        if present or started:
            places = np.array([i for i, w in enumerate(words) if w in present or len(w) > START_LETTERS and w[:START_LETTERS] in started])
            left = np.searchsorted(at, places - NEAR_WORDS)
            near = int((np.searchsorted(at, places + NEAR_WORDS, side="right") > left).sum())
    upper = size - len(data.translate(None, UPPER))
    letters = max(1, upper + size - len(data.translate(None, LOWER)))
    disguised = [undone(t) for t in DISGUISED.findall(text)] + [undone(re.sub(r"\W", "", t)) for t in APART.findall(text)]
    stretched = len(STRETCHED.findall(text))
    found = sum(t in lexicon.words or t[:START_LETTERS] in lexicon.starts for t in disguised)
    if stretched:
        found += sum(undone(t) in lexicon.words for t in words if STRETCHED.search(t))
    return [hits, 1000 * hits / n, start_hits, 1000 * start_hits / n, near, 1000 * address / n, upper / letters, (size - len(data.translate(None, MARKS))) / size, (size - len(data.translate(None, SHOUTS))) / size, 1000 * len(disguised) / n, found, 1000 * stretched / n, math.log1p(len(words))]


@dataclass
class Boosted:
    """Trees of fixed depth: at each level of each tree a node's feature and threshold; leaf values by path."""

    start: float = 0.0
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    leaf: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss over binned features."""
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Boosted(math.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]  # zero against more than zero is a split of its own
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width, margin = max(len(e) for e in edges) + 1, np.full(len(x), model.start)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            own = node - first
            best = np.full(nodes, 1e-9)
            g_all, h_all = np.bincount(own, g, nodes), np.bincount(own, h, nodes)
            for f in range(x.shape[1]):
                at = own * width + binned[:, f]
                gl, hl = (np.bincount(at, v, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, : len(edges[f])] for v in (g, h))
                gr, hr = g_all[:, None] - gl, h_all[:, None] - hl
                gain = np.where((hl > LEAST_LEAF / 100) & (hr > LEAST_LEAF / 100), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g_all**2 / (h_all + 1))[:, None], -1.0)
                if gain.shape[1]:
                    cutoff = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), cutoff]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + nodes][better] = f
                    threshold[first : first + nodes][better] = edges[f][cutoff[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaves = node - inner
        leaf = RATE * np.bincount(leaves, g, 2**DEPTH) / (np.bincount(leaves, h, 2**DEPTH) + 1)
        margin += leaf[leaves]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.leaf.append(leaf)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, values): the non-decreasing step values closest to y, by pooling adjacent violators."""
    levels, at = np.unique(score, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []  # first score, last score, weight, sum
    for s, w, t in zip(levels, weight, total, strict=True):
        blocks.append([s, s, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, w2, t2 = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + w2, blocks[-1][3] + t2
    knots = [(s, b[3] / b[2]) for b in blocks for s in dict.fromkeys((b[0], b[1]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(texts), self.trees.start)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts], dtype=np.float64).reshape(-1, len(NAMES)))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def units(rows: DataFrame) -> DataFrame:
    """(unit, toxic): the different words, and word starts with a mark after them, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, found, labels = batch.slice(at, SLICE), [], []
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = set(WORD.findall((text or "").lower()))
                    words |= {w[:START_LETTERS] + "*" for w in words if len(w) > START_LETTERS}
                    found += words
                    labels += [toxic] * len(words)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], names=["unit", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "unit string, toxic int")


def train(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """usable: which rows of labels, by id_col, may be learned from."""
    known = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    # sample_rows rows at most, so it may be sent to every executor and the texts need not be shuffled
    chosen = F.broadcast(known.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample_rows).withColumnRenamed(id_col, "_id"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("text")).join(chosen, F.col("_doc") == F.col("_id")).select("_id", "text", "toxic")
    # of an id that many rows have, the text that sorts first by its hash: sample_rows texts at most
    rows = rows.withColumn("_print", F.xxhash64("text")).groupBy("_id").agg(F.min_by(F.struct("text", "_print"), F.struct("_print", "text")).alias("t"), F.max("toxic").alias("toxic")).select("_id", "t.text", "t._print", "toxic")
    rows = cut(rows.groupBy("_print", "text").agg(F.max("toxic").alias("toxic"), F.min("_id").alias("_id")).select("_id", "text", "toxic"))
    sizes = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = sum(n for label, n in sizes.items() if label), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(Lexicon(), Boosted(1.0 if n_toxic else 0.0), (np.zeros(0), np.zeros(0)))
    counts = units(rows).groupBy("unit").agg(F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lift = (F.col("a") + 0.5) / (n_toxic + 1) / ((F.col("b") + 0.5) / (n_clean + 1))
    least = max(min(LEAST_TEXTS, 3), min(LEAST_TEXTS, n_toxic // 50))
    # as many as the sample gives: an entry is in least of its n_toxic texts
    chosen_units = [r[0] for r in counts.filter((F.col("a") >= least) & (lift >= LIFT)).select("unit").collect()]
    lexicon = Lexicon(frozenset(u for u in chosen_units if u[-1] != "*"), frozenset(u[:-1] for u in chosen_units if u[-1] == "*"))

    def make():
        return lambda texts: ([np.array(features(t, lexicon)).tobytes() for t in texts],)

    table = append_columns(rows, ["text"], [("features", "binary")], make, ["_id", "toxic"]).orderBy("_id").collect()
    x, y = np.stack([np.frombuffer(r["features"]) for r in table]), np.array([float(r["toxic"]) for r in table])
    fold = np.arange(len(y)) % 3 == 0  # a third calibrates what the others have built
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(y), bool)
    trees = boost(x[~fold], y[~fold])
    judged = fold if fold.any() else ~fold
    return ToxicityModel(lexicon, trees, isotonic(trees.margin(x[judged]), y[judged]))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", predicted_from: float = PREDICTED_FROM, keep: list[str] | None = None) -> DataFrame:
    """Add score and predicted."""

    def make():
        def work(texts):
            found = model.score(texts)
            return found, (found >= predicted_from).astype(np.int32)

        return work

    return append_columns(docs, [text_col], [("score", "double"), ("predicted", "int")], make, keep)
