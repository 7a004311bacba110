"""Rounding by the exact binary value."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillstream.functions import half_even

TIES = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.0, -0.0, 1e-300, 33.335, 66.665, 4.5e12 + 0.125, 0.005, 1.015, 99.995, 1e20]


def _exact(x: float, digits: int) -> float:
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)) if abs(x) < 1e15 else x


@pytest.mark.parametrize("digits", [0, 2, 4])
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(some=st.lists(st.floats(-1e9, 1e9) | st.integers(-(10**7), 10**7).map(lambda n: n / 1000) | st.integers(0, 10**6).map(lambda n: n / 64), min_size=300, max_size=300))
def test_half_even_is_exact(spark, digits, some):
    values = TIES + some
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = df.select("x", half_even(F.col("x"), digits).alias("r")).collect()
    assert got[-1].r is None
    assert [(r.x, r.r) for r in got[:-1]] == [(v, _exact(v, digits)) for v in values]
    assert [_exact(v, 2) for v in (2.675, 0.125, 0.375)] == [2.67, 0.12, 0.38] == [round(v, 2) for v in (2.675, 0.125, 0.375)]
