"""The records are normalised once: what queries build on them is small, however large the rules are."""

import pytest

from weftline.sources import catalogue


@pytest.mark.parametrize("phonetic", [False, True])
def test_normalised_sides_have_small_plans(spark, phonetic):
    for side in catalogue.sides(spark, "/root/testdata/sf0.001", phonetic):
        assert len(side._jdf.queryExecution().optimizedPlan().toString()) < 20_000
