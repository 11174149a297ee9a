"""Exact quantiles against numpy."""

import random

import numpy as np
import pytest

from pairforge.operators import metrics, quantiles

SHARES = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "low": 0.0, "high": 1.0}


@pytest.mark.parametrize("cells", [64, 1024])
def test_quantiles_equal_numpy(spark, monkeypatch, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = random.Random(2)
    groups = {
        "even": [rng.random() for _ in range(301)], "hot": [0.5] * 200 + [rng.random() for _ in range(100)], "one": [3.25], "two": [-1.0, 7.0],
        "wide": [-1e308, 1e308, 0.0, 1e-300, 5e-324, 1.0, 2.0], "near": [1.0, 1.0 + 2**-52, 1.0 + 2**-51], None: [1.0, 2.0, 4.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("even", float("nan")), ("nothing", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    for parts in (1, 5) if cells == 1024 else (3,):
        got = {r.g: r for r in quantiles.quantiles(df.repartition(parts), "x", SHARES, ("g",)).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            if g != "wide":
                assert [got[g][n] for n in SHARES] == pytest.approx(np.quantile(xs, list(SHARES.values())).tolist(), abs=1e-15)
        assert got["wide"].low == -1e308 and got["wide"].high == 1e308 and got["wide"].p50 == 1e-300


def test_edges(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantiles.quantiles(df, "x", {"m": 0.5}).collect() == [(None,)]
    assert [r.quartile for r in metrics.quartile(df.where("x IS NULL"), "x").collect()] == [None]
    assert quantiles.quantiles(df.selectExpr("1 AS g", "x"), "x", {"m": 0.5}, ("g",)).count() == 0
    with pytest.raises(ValueError, match="infinite"):
        quantiles.quantiles(spark.createDataFrame([(float("inf"),)], "x double"), "x", {"m": 0.5})
