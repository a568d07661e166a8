"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random (seeded); its code is the signs of the rotated coordinates, and with it is stored the
correction factor, the inner product of the vector and its code. The inner product of another vector with the code,
divided by the factor, estimates the vectors' inner product without bias, and its spread is known from the factor. A pair
whose confidence bound stays below the threshold is passed over; every other pair is recomputed exactly, in double
precision, so no pair below the threshold is ever linked.

Pairs to estimate come from the codes too: disjoint runs of code bits are the keys of hash tables. The number of bits
follows the number of vectors, and the number of tables follows from the bits, so that a pair right at the threshold
shares a cell in one table at least with probability RECALL; closer pairs do so more often. A cell's vectors are compared
in groups of bounded size. A pair counts in the first table where both share a cell, so links are counted once, and only
counts and a spanning forest of the links are passed on, never all pairs.

What is dealt out to the tables is a row's code, its factors and the rotated vector in one byte a coordinate (the estimate
allows for the rounding); vectors themselves are fetched only for rows of pairs that are to be recomputed.

Vectors equal in every component are one vertex from the start, with their number.

Defined results:
- vectors null, empty, zero, or with null or non-finite components: no links, a component of their own, kept
- vectors of different length never link
- rows with a null id take no part: no links, component null, kept null
- rows that share an id: each by its own vector; they count as other vectors of each other if these link
- an empty table: no rows
- columns of the input beside the id and the vector, whatever their names, are not looked at
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import append_columns, cut, look_up
from weftline.llm.components import bounded_groups, connected_components

THRESHOLD = 0.95
#: Share of pairs right at the threshold that meet in a table.
RECALL = 0.97
#: Standard deviations of the estimate that the confidence bound allows for.
DEVIATIONS = 4.0
#: Rows of a group; rows that a cell has on average if the vectors are spread evenly.
BLOCK, CELL_ROWS = 1024, 128
#: Rotations at least, so that the estimate is an average over several.
LEAST_ROTATIONS = 2
SEED = 20260926
#: Exact cosines this close to the threshold are summed again without rounding error.
CLOSE = 1e-12


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a table, tables) for n vectors."""
    bits = max(6, math.ceil(math.log2(max(2, n) / CELL_ROWS)))  # more with every doubling of the table, without end
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


class Rotations:
    """Seeded random rotations of vectors of one length, and the codes of such vectors."""

    def __init__(self, dim: int, bits: int, tables: int):
        self.dim, self.bits, self.tables = dim, bits, tables
        self.number = max(LEAST_ROTATIONS, -(-bits * tables // dim))
        rng = np.random.default_rng([SEED, dim])
        self.matrix = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(self.number)])

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        """(rows, rotations, dim)"""
        return (unit @ self.matrix.T).reshape(len(unit), self.number, self.dim)

    def cells(self, signs: np.ndarray) -> np.ndarray:
        """(rows, tables): the number that each table's run of bits makes."""
        flat = signs.reshape(len(signs), -1)[:, : self.bits * self.tables].reshape(len(signs), self.tables, self.bits)
        return flat.astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def rotations_of(known: dict[int, Rotations], dim: int, bits: int, tables: int) -> Rotations:
    if dim not in known:
        known[dim] = Rotations(dim, bits, tables)
    return known[dim]


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None if it takes no part."""
    if not vector or any(x is None for x in vector):
        return None
    x = np.array(vector, dtype=np.float64)
    with np.errstate(over="ignore"):
        return x + 0.0 if np.isfinite(x).all() and 0 < float(np.abs(x).max()) else None


def unit_vector(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()  # neither squares of huge nor of tiny components leave the range
    return x / np.linalg.norm(x)


def keyed(vectors: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(vec_id, key, vec); key is null for vectors that take no part."""
    import hashlib

    def make():
        def work(found, ids):
            keys, data = [], []
            for vector, own in zip(found, ids, strict=True):
                x = usable(vector) if own is not None else None
                data.append(None if x is None else x.tobytes())
                keys.append(None if x is None else hashlib.blake2b(data[-1], digest_size=16).digest())
            return keys, data

        return work

    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("_vec"))
    return append_columns(source, ["_vec", "vec_id"], [("key", "binary"), ("vec", "binary")], make, ["vec_id"])


def classes_of(rows: DataFrame) -> DataFrame:
    """One row (key, n, first_id, vec) for each different vector that takes part; vec is its doubles in bytes."""
    return rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.min("vec").alias("vec"))


def coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Add code, sketch and cells: the sign bits of all rotations; the factors and the first rotation in bytes; a number for each table."""

    def make():
        import xxhash

        rotations: dict[int, Rotations] = {}

        def work(vectors):
            made: list = [None] * len(vectors)
            for dim in sorted({len(v) // 8 for v in vectors}):
                own = [i for i, v in enumerate(vectors) if len(v) == 8 * dim]
                rot = rotations_of(rotations, dim, bits, tables)
                turned = rot.rotated(np.stack([unit_vector(np.frombuffer(vectors[i])) for i in own]))
                signs = turned > 0
                factors = np.abs(turned).sum(axis=2) / math.sqrt(dim)
                packed, cells = np.packbits(signs.reshape(len(own), -1), axis=1), rot.cells(signs)
                step = np.abs(turned[:, 0]).max(axis=1) / 127
                bytes_ = np.rint(turned[:, 0] / step[:, None]).astype(np.int8)
                for k, i in enumerate(own):
                    sketch = dim.to_bytes(4, "little") + np.concatenate([[step[k]], factors[k]]).astype("<f4").tobytes() + bytes_[k].tobytes()
                    made[i] = packed[k].tobytes(), sketch, [xxhash.xxh64_intdigest(f"{dim},{t},{x}") - 2**63 for t, x in enumerate(cells[k].tolist())]
            return [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]

        return work

    return append_columns(classes, ["vec"], [("code", "binary"), ("sketch", "binary"), ("cells", "array<long>")], make)


class Sketches:
    """What is known of the rows of one group before their vectors are fetched."""

    def __init__(self, codes: list[bytes], sketches: list[bytes], bits: int, tables: int, rotations: dict):
        dim = int(np.frombuffer(sketches[0], "<i4", 1)[0])
        self.rot = rotations_of(rotations, dim, bits, tables)
        n = self.rot.number
        floats = np.stack([np.frombuffer(s, "<f4", 1 + n, 4) for s in sketches]).astype(np.float32)
        self.step, self.factors = floats[:, 0], floats[:, 1:]
        coordinates = np.stack([np.frombuffer(s, np.int8, dim, 8 + 4 * n) for s in sketches]).astype(np.float32) * self.step[:, None]
        self.signs = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in codes]), axis=1)[:, : n * dim].reshape(len(codes), n, dim)
        self.cells = self.rot.cells(self.signs)
        # the first rotation undone gives the vector, to a byte a coordinate, in any rotation
        turn = self.rot.matrix.astype(np.float32)
        self.turned = (coordinates @ turn[:dim] @ turn.T).reshape(len(codes), n, dim)


def may_link(a: Sketches, b: Sketches, threshold: float) -> np.ndarray:
    """(rows of a, rows of b): whether the pair's confidence bound reaches the threshold."""
    rot, scale = a.rot, np.float32(1 / math.sqrt(a.rot.dim))
    estimate, spread = np.zeros((len(a.step), len(b.step)), np.float32), np.zeros(len(a.step))
    rounding = np.zeros(len(b.step))
    for r in range(rot.number):
        code = (a.signs[:, r].astype(np.float32) * 2 - 1) * scale
        estimate += (code @ b.turned[:, r].T) / a.factors[:, r, None]
        spread += (1 - np.minimum(a.factors[:, r].astype(np.float64) ** 2, 1)) / a.factors[:, r].astype(np.float64) ** 2 / max(1, rot.dim - 1)
        # a coordinate is off by half a step at most: their sum against a code by that times the root of their number
        rounding = np.maximum(rounding, b.step * math.sqrt(rot.dim) / 2 / float(a.factors[:, r].min()))
    return estimate / rot.number + (DEVIATIONS * np.sqrt(spread) / rot.number)[:, None] + rounding[None, :] + 1e-4 >= threshold


class Group:
    """The fetched rows of one group, as arrays."""

    def __init__(self, rows: list[tuple], bits: int, tables: int, rotations: dict):
        self.keys = [r[0] for r in rows]
        self.n = np.array([r[1] for r in rows], dtype=np.int64)
        self.unit = np.stack([unit_vector(np.frombuffer(r[2])) for r in rows])
        dim = self.unit.shape[1]
        rot = rotations_of(rotations, dim, bits, tables)
        self.cells = rot.cells(np.unpackbits(np.stack([np.frombuffer(r[3], np.uint8) for r in rows]), axis=1)[:, : rot.number * dim].reshape(len(rows), rot.number, dim))


def linked_pairs(a: Group, b: Group, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(indices in a, indices in b) of the pairs at the threshold or above; with same each unordered pair once."""
    near = a.unit @ b.unit.T >= threshold - CLOSE
    ia, ib = np.nonzero(np.triu(near, 1) if same else near)
    kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(ia), 65536):
        x, y = ia[at : at + 65536], ib[at : at + 65536]
        cos = np.einsum("ij,ij->i", a.unit[x], b.unit[y])
        for i in np.nonzero(np.abs(cos - threshold) < CLOSE)[0]:
            cos[i] = math.fsum(a.unit[x[i]] * b.unit[y[i]])
        kept[0].append(x[cos >= threshold])
        kept[1].append(y[cos >= threshold])
    return np.concatenate(kept[0]), np.concatenate(kept[1])


def earlier(a, b, ia: np.ndarray, ib: np.ndarray, table: int) -> np.ndarray:
    """Whether a pair shares a cell of a table before this one."""
    return (a.cells[ia, :table] == b.cells[ib, :table]).any(axis=1) if table else np.zeros(len(ia), bool)


def by_group(rows: DataFrame, columns: list[str], make, output: str, fields: str) -> DataFrame:
    """What make() makes of the rows of each group (cell, first, second), each a tuple of columns; groups come one after another."""
    tasks = rows.select("cell", "first", "second", *columns).repartition("cell", "first", "second").sortWithinPartitions("cell", "first", "second")
    names, kinds = fields.split(), [{"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}[k] for k in output.split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()

        def table(found):
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        at, own = None, []
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, 1024):
                for row in zip(*[c.to_pylist() for c in batch.slice(start, 1024).columns], strict=True):
                    if row[:3] != at:
                        found += work(*at, own) if len(own) > 1 else []
                        at, own = row[:3], []
                    own.append(row[3:])
            yield table(found)
        yield table(work(*at, own) if len(own) > 1 else [])

    return tasks.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, output.split(), strict=True)))


def sides_of(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    return tuple([r[1:] for r in rows if r[0] == s] for s in (0, 1))


def to_recompute(met: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(cell, first, second, side, tab, key): the rows of each group that have a pair to recompute there."""

    def make():
        rotations: dict[int, Rotations] = {}

        def work(cell, first, second, rows):
            table = rows[0][1]
            (mine, theirs), same = sides_of(rows), first == second
            if not mine or not same and not theirs:
                return []
            a = Sketches([r[2] for r in mine], [r[3] for r in mine], bits, tables, rotations)
            b = a if same else Sketches([r[2] for r in theirs], [r[3] for r in theirs], bits, tables, rotations)
            # either row's code may be the one that estimates: a pair is passed over if one of the two bounds is too low
            wanted = may_link(a, b, threshold) & may_link(b, a, threshold).T
            ia, ib = np.nonzero(np.triu(wanted, 1) if same else wanted)
            new = ~earlier(a, b, ia, ib, table)
            ia, ib = ia[new], ib[new]
            found = [(0, mine[i][1]) for i in np.unique(np.concatenate([ia, ib]) if same else ia)] + ([] if same else [(1, theirs[i][1]) for i in np.unique(ib)])
            return [(cell, first, second, side, table, key) for side, key in found]

        return work

    return by_group(met, ["side", "tab", "key", "code", "sketch"], make, "long int int int int binary", "cell first second side tab key")


def links_of_groups(wanted: DataFrame, classes: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(a, b, n): with b a forest's link; with b null, n more vectors are linked with a."""

    def make():
        rotations: dict[int, Rotations] = {}

        def work(cell, first, second, rows):
            table, out = rows[0][1], []
            (mine, theirs), same = sides_of(rows), first == second
            if not mine or not same and not theirs:
                return []
            a = Group([r[1:] for r in mine], bits, tables, rotations)
            b = a if same else Group([r[1:] for r in theirs], bits, tables, rotations)
            ia, ib = linked_pairs(a, b, threshold, same)
            new = ~earlier(a, b, ia, ib, table)
            for group, mine, other, theirs in ((a, ia, b, ib), (b, ib, a, ia)):
                counts = np.bincount(mine[new], weights=other.n[theirs[new]], minlength=len(group.keys)).astype(np.int64)
                out += [(group.keys[i], None, int(counts[i])) for i in np.nonzero(counts)[0]]
            keys = a.keys if same else a.keys + b.keys
            x, y = ia, ib if same else ib + len(a.keys)
            label = np.arange(len(keys))
            while len(x):
                now = label.copy()
                np.minimum.at(now, x, label[y])
                np.minimum.at(now, y, label[x])
                now = np.minimum(now, now[now])
                if (now == label).all():
                    break
                label = now
            return out + [(keys[i], keys[int(label[i])], 0) for i in np.nonzero(label != np.arange(len(keys)))[0]]

        return work

    fetched = wanted.join(classes.select("key", "n", "vec", "code"), "key")
    return by_group(fetched, ["side", "tab", "key", "n", "vec", "code"], make, "binary binary long", "a b n")


def near_duplicates(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = cut(keyed(vectors, vec_col, id_col))
    classes = cut(classes_of(rows))
    bits, tables = tables_for(classes.count(), threshold, recall)
    classes = cut(coded(classes, bits, tables))
    dealt = classes.select(F.posexplode("cells").alias("tab", "cell"), "key", "code", "sketch")
    wanted = cut(to_recompute(bounded_groups(dealt, "cell", "key", block, few_singles=True), bits, tables, threshold))
    found = cut(links_of_groups(wanted, classes, bits, tables, threshold))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = connected_components(found.filter("b is not null"))
    joined = classes.select("key", "n", "first_id").join(roots, F.col("key") == F.col("node"), "left").join(counts, F.col("key") == F.col("a"), "left")
    joined = cut(joined.select("key", "n", "first_id", F.coalesce("root", "key").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links")))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component"), F.count(F.lit(1)).alias("members"))
    labels = cut(look_up(joined, smallest, ["root"], "members").select("key", "component", "links", "n"))
    known = look_up(rows.filter("key is not null").select("vec_id", "key"), labels, ["key"], "n").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = known.unionByName(rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
