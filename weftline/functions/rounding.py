"""Rounding that equals Python's: correctly rounded from the exact binary value, ties to even."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rate(n: float | None, d: float | None, places: int = 6) -> float | None:
    """n / d rounded, None without a denominator."""
    return round(float(n) / float(d), places) if d else None


def round_exact(x: float | None, places: int = 6) -> float | None:
    """The same as round(x, places), spelled out by the exact decimal value of x."""
    return None if x is None else float(Decimal(x).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_EVEN))


@F.pandas_udf(T.DoubleType())
def round6(x: pd.Series) -> pd.Series:
    """For small results only (rows of metrics); Spark's round() is not correctly rounded."""
    return x.map(lambda v: round(v, 6), na_action="ignore")


def float32(percent: Column) -> Column:
    """A similarity in percent, through single precision, as a share."""
    return percent.cast("float").cast("double") / 100
