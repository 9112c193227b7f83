import math
import random

import pytest
from pyspark.sql import functions as F

from quaystone.llm.common import rank_error
from quaystone.llm.quantiles import combine, percentiles, rank_of, sketches

SCHEMA = "g string, day int, v double, sketch string"


def _rank_of(values, x):
    s = sorted(values)
    return sum(v < x for v in s) / len(s), sum(v <= x for v in s) / len(s)


def test_bounded_error_and_combination(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", i % 4, math.exp(rng.gauss(3, 1.5)), "x") for i in range(30000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    daily = sketches(df, ["g", "day"], "v")
    assert daily.count() == 8
    whole = percentiles(combine(daily, ["g"]), [0.1, 0.5, 0.9, 0.99]).collect()
    for r in whole:
        values = [v for g, _, v, _ in rows if g == r.g]
        assert r.n == len(values) and r.rejected == 0
        for p, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
            low, high = _rank_of(values, r[name])
            assert low - r.rank_error <= p <= high + r.rank_error
    got = rank_of(combine(daily, ["g"]), F.lit(20.0)).collect()
    for r in got:
        low, high = _rank_of([v for g, _, v, _ in rows if g == r.g], 20.0)
        assert low - rank_error(400) <= r["rank"] <= high + rank_error(400)


def test_breaches_of_the_stated_bound_over_many_sketches(spark):
    # 200 groups with their own values, seven percentiles each, combined from four days: 1,400 percentiles.
    rng = random.Random(17)
    rows = [(f"g{g}", day, rng.lognormvariate(g % 7, 1 + g % 3), None) for g in range(200) for day in range(4) for _ in range(600)]
    asked = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    got = percentiles(combine(sketches(spark.createDataFrame(rows, SCHEMA), ["g", "day"], "v"), ["g"]), asked).collect()
    values = {}
    for g, _, v, _ in rows:
        values.setdefault(g, []).append(v)
    breaches = 0
    for r in got:
        for p, name in zip(asked, ("p1", "p10", "p25", "p50", "p75", "p90", "p99")):
            low, high = _rank_of(values[r.g], r[name])
            breaches += not low - r.rank_error <= p <= high + r.rank_error
    # At 99 % confidence 14 are allowed.
    assert len(got) == 200 and breaches <= 14


def test_dirty_values_ties_and_empty(spark):
    rows = [("a", 1, None, None), ("a", 1, float("nan"), None), ("a", 1, -5.0, None), ("a", 1, float("inf"), None), (None, 1, 7.0, None), (None, 1, 7.0, None), ("c", 2, 0.0, None)]
    out = {r.g: r for r in percentiles(sketches(spark.createDataFrame(rows, SCHEMA), ["g"], "v"), [0.5]).collect()}
    assert out["a"].n == 0 and out["a"].rejected == 4 and out["a"].p50 is None
    assert out[None].p50 == 7.0 and out[None].n == 2
    assert out["c"].p50 == 0.0
    assert sketches(spark.createDataFrame([], SCHEMA), ["g"], "v").count() == 0


def test_rank_error():
    assert rank_error(200) == pytest.approx(0.0133, abs=2e-4)
