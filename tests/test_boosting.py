"""The learned method's trees are those of MLlib's GBTClassifier, in one block or in several, and its query makes features once."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weftline.operators import boosting

WEIGHTS = (0.75, 1.5)


@pytest.fixture(scope="module")
def rows(spark):
    rng, made = random.Random(5), []
    for i in range(3000):
        x = [rng.randrange(20) / 20, rng.randrange(9) - 1, rng.randrange(2), rng.random()]
        made.append((i, *x, int(x[0] + 0.1 * x[1] * x[2] + x[3] / 2 + rng.gauss(0, 0.3) > 1.0)))
    return spark.createDataFrame(made, "id int, x0 double, x1 int, x2 int, x3 double, label int").cache()


def test_trees_are_those_of_mllib(rows, monkeypatch):
    names = ["x0", "x1", "x2", "x3"]
    sizes = {"trees": 12, "depth": 5, "rate": 0.1, "least_leaf": 20}
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).withColumn("w", F.when(F.col("label") == 1, WEIGHTS[1]).otherwise(WEIGHTS[0]))
    theirs = GBTClassifier(labelCol="label", weightCol="w", maxIter=12, maxDepth=5, stepSize=0.1, minInstancesPerNode=20).fit(vectors)
    features = [F.col(n) for n in names]
    scored = theirs.transform(vectors).select("id", *names, vector_to_array("probability")[1].alias("theirs"))
    for most in (boosting.BLOCK_ROWS, 500):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", most)
        ours = boosting.fit(rows, features, WEIGHTS, **sizes)
        got = scored.withColumn("ours", ours.score(features)).collect()
        assert len({round(r["theirs"], 6) for r in got}) > 50
        assert max(abs(r["ours"] - r["theirs"]) for r in got) < 1e-9


def test_no_split_no_leaf_too_small(rows):
    model = boosting.fit(rows.filter("id < 60"), [F.col("x0")], (1.0, 1.0), 3, 5, 0.1, 50)
    assert all((t.cutoff == 255).all() for t in model.made)


def test_learned_decisions_makes_its_features_once(spark, monkeypatch):
    from weftline.plans import queries

    class Seen(Exception):
        pass

    def fit(features, truth, **sizes):
        raise Seen(*[df._jdf.queryExecution().optimizedPlan().toString() for df in (features, truth)])

    monkeypatch.setattr(queries.methods, "fit_learned", fit)
    with pytest.raises(Seen) as seen:
        queries.QUERIES["learned_decisions"](spark, "/root/testdata/sf0.001")
    assert not any(word in plan for plan in seen.value.args for word in ("Join", "Aggregate", "fuzzy_features"))
