"""The operators on vectors: brute-force comparisons, odd rows, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, key string, rank string"


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 32))
    rows = [(i, base[i]) for i in range(60)]
    rows += [(100 + i, base[i % 5] + 0.05 * rng.standard_normal(32)) for i in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(300, rows[0][1]), (301, [2 * x for x in rows[0][1]]), (302, None), (303, []), (304, [0.0] * 32), (305, [None] + [1.0] * 31), (306, [float("nan")] * 32), (307, [float("inf")] * 32), (None, rows[1][1]), (308, [1.0, 0.0]), (309, [1.0, 0.01]), (7, rows[7][1])]
    return rows


@pytest.fixture(scope="module")
def vectors(spark, given):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in given], SCHEMA)


@pytest.mark.parametrize("block", [1024, 8])
def test_links_against_brute_force(vectors, given, block):
    good = [(n, i, np.array(v)) for n, (i, v) in enumerate(given) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = {n: 0 for n in range(len(given))}, list(range(len(given)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (n, _, x) in enumerate(good):
        for m, _, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[n] += 1
                links[m] += 1
                parent[root(n)] = root(m)
    smallest = {}
    for n, (i, _) in enumerate(given):
        if i is not None:
            smallest[root(n)] = min(smallest.get(root(n), i), i)
    expected = [(i, links[n], smallest[root(n)] if i is not None else None, None if i is None else i == smallest[root(n)]) for n, (i, _) in enumerate(given)]
    out = [tuple(r) for r in embed_dedup.near_duplicates(vectors, recall=0.9999, block=block).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    assert max(links.values()) > 20


def test_no_vectors(vectors):
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0
    assert topk.search(vectors.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert topk.search(vectors, F.lit(False)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        rot = embed_dedup.Rotations(32, 8, 4)
        a, b = (embed_dedup.unit_vector(rng.standard_normal(32)) for _ in range(2))
        turned_a, turned_b = rot.rotated(a[None])[0], rot.rotated(b[None])[0]
        code = np.where(turned_a > 0, 1, -1) / np.sqrt(32)
        errors += list((code * turned_b).sum(axis=1) / (code * turned_a).sum(axis=1) - a @ b)
    assert abs(np.mean(errors)) < 0.06 and np.abs(errors).max() < 4 * 0.2


@pytest.mark.parametrize("sizes", [(16384, 64, 4096), (16, 2, 2)])
def test_top_rows_against_brute_force(spark, vectors, given, sizes):
    rows = [(i, [int(x) for x in np.frombuffer(topk.quantise(v), "<i8")]) for i, v in given if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = []
    for n, (i, x) in enumerate(rows):
        if i % 10 == 0 or i == 7:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j) for m, (j, y) in enumerate(rows) if m != n)[:10]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    out = topk.search(vectors, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 7), block_rows=sizes[0], batch_queries=sizes[1], share_queries=sizes[2])
    assert sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == sorted(expected)
    assert sum(e[0] == 7 for e in expected) == 20  # two rows of one id are two queries, and candidates of each other


def test_every_finite_row_is_a_candidate(spark):
    given = [(0, [1.0, 0.0]), (1, [1e6, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.5, 0.0])]
    out = topk.search(spark.createDataFrame(given, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4)
    assert [tuple(r)[1:] for r in out.orderBy("rank").collect()] == [(1, 1, 1024 * 1024 * 10**6), (2, 2, 3 * 1024**2), (3, 2, 2 * 1024**2), (4, 3, 512 * 1024)]


def test_ties_go_to_the_smaller_id(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40, -1, -1)], "vec_id long, embedding array<double>")
    out = topk.search(frame, F.col("vec_id") == 3, k=5)
    assert [r["vec_id"] for r in out.orderBy("rank").collect()] == [1, 5, 7, 9, 11]


def test_recall_at_the_threshold(spark):
    """At the default recall, of at least ten thousand pairs just above the threshold at least 0.9 are linked, and none below it."""
    rng = np.random.default_rng(7)
    n, dim = 11_000, 64
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = np.where(np.arange(n) < 10_000, 0.9501, 0.9499)[:, None]
    b = cos * a + np.sqrt(1 - cos**2) * side
    rows = [(2 * i + k, v.tolist()) for i in range(n) for k, v in enumerate((a[i], b[i]))]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("n_links > 0").collect()
    linked = {r["vec_id"] // 2 for r in out}
    assert all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] // 2 * 2 for r in out)
    assert len([i for i in linked if i < 10_000]) >= 9_000 and not [i for i in linked if i >= 10_000]


def test_a_large_group_is_compared_in_blocks(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.02 * rng.standard_normal(16)).tolist()) for i in range(300)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(50)]
    out = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.999, block=32).collect()}
    assert all(out[i]["component_id"] == 0 and out[i]["n_links"] == 299 for i in range(300))


def test_sketches_bound_the_estimate():
    """No pair at the threshold or above is passed over: four deviations, and the rounding of a coordinate to a byte."""
    rng = np.random.default_rng(9)
    rot, known = embed_dedup.Rotations(64, 8, 7), {}
    unit = np.stack([embed_dedup.unit_vector(v) for v in rng.standard_normal((300, 64))])
    other = np.stack([embed_dedup.unit_vector(v) for v in unit + 0.3 * rng.standard_normal((300, 64)) / 8])
    sketches = []
    for x in (unit, other):
        turned = rot.rotated(x)
        step = np.abs(turned[:, 0]).max(axis=1) / 127
        heads = np.concatenate([step[:, None], np.abs(turned).sum(axis=2) / 8], axis=1).astype("<f4")
        held = [(64).to_bytes(4, "little") + h.tobytes() + np.rint(t / s).astype(np.int8).tobytes() for h, t, s in zip(heads, turned[:, 0], step, strict=True)]
        sketches.append(embed_dedup.Sketches([np.packbits(t.reshape(-1) > 0).tobytes() for t in turned], held, 8, 7, known))
    a, b = sketches
    assert np.abs(a.turned - rot.rotated(unit)).max() < 0.02
    may, cos = embed_dedup.may_link(a, b, 0.95) & embed_dedup.may_link(b, a, 0.95).T, unit @ other.T
    assert (cos.diagonal() >= 0.93).mean() > 0.9 and may[cos >= 0.95].mean() > 0.999 and may[cos < 0.3].mean() < 0.01


def test_sliced_sums_and_digits():
    rng = random.Random(3)
    for x in [0, 1, -1, 7, -7, 1023, *(rng.randint(-5000, 5000) for _ in range(200))]:
        assert sum(d << w for w, d in topk.signed_digits(x)) == x
    values = np.random.default_rng(4).integers(-600, 600, (130, 9))
    block = topk.SlicedBlock(np.arange(130), values)
    query = np.array([5, -3, 0, 1023, -1024, 1, -1, 77, 12])
    slices, constant = block.scores(query)
    total = sum(block.flags(s).astype(int) << w for w, s in enumerate(slices)) + constant
    assert (total == values @ query).all()


def test_large_finite_vectors_take_part(spark):
    given = [(0, [2.0**17, 1.0]), (1, [2.0**17, -3.0]), (2, [1.0, 2.0**20]), (3, [-(2.0**17), 0.5]), (4, [0.25, -1.0]), (5, [float("inf"), 0.0])]
    value = {i: [int(np.floor(1024 * x)) for x in v] for i, v in given[:5]}
    expected = []
    for i in value:
        scored = sorted((-sum(x * y for x, y in zip(value[i], value[j], strict=True)), j) for j in value if j != i)
        expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    out = topk.search(spark.createDataFrame(given, "vec_id long, embedding array<double>"), F.lit(True))
    assert sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == sorted(expected)


def test_only_scores_of_the_best_must_fit_a_long(spark):
    far, vectors = 2.0**52, "vec_id long, embedding array<double>"
    given = [(0, [far]), (1, [-far]), (2, [0.0]), (3, [0.0])]
    out = topk.search(spark.createDataFrame(given, vectors), F.col("vec_id") == 0, k=2)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 2, 0), (0, 2, 3, 0)]
    for rows, k in ((given, 3), ([(0, [far]), (1, [far])], 1), ([(0, [2.0**60]), (1, [0.0])], 1)):
        with pytest.raises(Exception, match="does not fit a long"):
            topk.search(spark.createDataFrame(rows, vectors), F.col("vec_id") == 0, k=k).collect()
