"""The learned method makes the features of its labelled pairs once, whatever the number of trees."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import methods
from weftline.schemas import PAIR_FEATURES


def test_features_are_made_once_for_training(spark):
    rng, made = random.Random(2), spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    rows = [(f"a{i // 3}", f"b{i}", ("fit", "calibrate", "test")[i // 3 % 3], *[rng.random() * 0.5 + (i % 3 == 0) * 0.5 for _ in range(8)], 0, 0, rng.choice([None, 0, 1, 5]), 0, 0, 1, 1, 0) for i in range(180)]
    schema = "a_id string, b_id string, fold string, " + ", ".join(f"{f} {'double' if i < 8 else 'int'}" for i, f in enumerate(PAIR_FEATURES))
    features = spark.createDataFrame(rows, schema).withColumn(PAIR_FEATURES[0], F.udf(counted, T.DoubleType())(PAIR_FEATURES[0]))
    truth = spark.createDataFrame([(r[0], r[1]) for i, r in enumerate(rows) if i % 3 == 0], "a_id string, b_id string")
    record = methods.fit_learned(features, truth, trees=2, least_leaf=2).record
    assert (record["trained_on"], record["positive"], record["calibrated_on"]) == (60, 20, 60)
    assert made.value <= len(rows)
