"""Quantiles against numpy: ties, frequent values, keys of any size, nulls and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions.quantiles import quantile, quantiles


@pytest.fixture(scope="module")
def keyed():
    r = np.random.default_rng(3)
    return {"normal": r.normal(size=3000), "zeros": np.where(r.random(2500) < 0.7, 0.0, r.normal(size=2500)), "equal": np.full(40, 2.5), "one": np.array([-4.0]), "two": np.array([1.0, 9.0]), "whole": r.integers(-3, 4, 700).astype(float), "huge": r.normal(size=300) * 1e300}


@pytest.mark.parametrize("count", [2, 7, 512])
def test_levels_of_each_key_as_numpy_gives_them(spark, keyed, count):
    df = spark.createDataFrame([(k, float(x)) for k, v in keyed.items() for x in v] + [("one", None), ("none", None)], "k string, x double").repartition(5)
    got = {}
    for r in quantiles(df, 0.0, 1 / (count - 1), count, "k").collect():
        got[r.k, r.i] = r.q
    assert len(got) == len(keyed) * count
    for k, v in keyed.items():
        np.testing.assert_allclose([got[k, i] for i in range(count)], np.quantile(v, np.linspace(0, 1, count)), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("level", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_one_level_of_all_rows(spark, keyed, level):
    for name in ("normal", "zeros", "one", "two"):
        df = spark.createDataFrame([(float(x),) for x in keyed[name]], "x double")
        assert quantile(df, level).first().q == pytest.approx(np.quantile(keyed[name], level), rel=1e-9, abs=1e-12)


def test_no_values(spark):
    assert quantile(spark.createDataFrame([(None,)], "x double"), 0.5).first().q is None
    assert quantiles(spark.createDataFrame([], "k int, x double"), 0.0, 0.5, 3, "k").count() == 0


def test_a_plan_without_a_whole_group(spark):
    df = spark.range(100_000).select((F.col("id") % 1000).cast("double").alias("x"))
    assert "percentile(" not in quantile(df, 0.5)._jdf.queryExecution().toString()
    assert quantile(df, 0.5).first().q == pytest.approx(499.5)
