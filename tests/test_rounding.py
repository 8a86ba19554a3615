from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import params as P


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_quick_rounding_is_the_exact_one(spark, digits):
    draw = random.Random(digits)
    ties = [(k + 0.5) / 10**digits for k in range(-300, 300)]
    beside = [math.nextafter(t, s * math.inf) for t in ties for s in (1, -1)]
    values = [*ties, *beside, 0.0, -0.0, -0.004, 1e300, -1e18, math.nan, math.inf, None, *[draw.uniform(-60, 60) for _ in range(3000)], *[draw.uniform(0, 1) for _ in range(3000)]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for rounding in (F.round, F.bround):
        found = df.select("x", P.quickly(rounding, F.col("x"), digits).alias("quick"), rounding("x", digits).alias("exact"))
        assert found.where("NOT (quick <=> exact)").collect() == []
