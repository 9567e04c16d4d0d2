import numpy as np
import pandas as pd
import pytest

from barloom.operators.recurrence import average_state, exponential_averages

STEPS = [("a", "x", {"span": 12}), ("b", "x", {"span": 26}), ("e", "m", {"span": 9}), ("f", "z", {"alpha": 1 / 3}),
         ("g", "f", {"alpha": 1 / 3}), ("h", "z", {"alpha": 0.9})]
DIFFERENCES = [("m", "a", "b")]


def series(seed=0):
    """Five series with gaps, long holes, a late begin and one without any value."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(5):
        day = 0
        for i in range(900):
            day += int(rng.integers(1, 4)) if rng.random() < 0.97 else int(rng.integers(100, 400))
            x = None if rng.random() < 0.2 or (k == 1 and i < 300) or k == 4 else float(rng.normal(100, 10))
            rows.append((k, day, x, None if 400 < i < 700 else float(rng.normal())))
    return rows


def by_pandas(rows):
    parts = []
    for _, p in pd.DataFrame(rows, columns=["k", "t", "x", "z"]).groupby("k"):
        p = p.sort_values("t").copy()
        p["a"], p["b"] = (p.x.astype(float).ewm(span=n, adjust=False).mean() for n in (12, 26))
        p["m"] = p.a - p.b
        p["e"] = p.m.ewm(span=9, adjust=False).mean()
        p["f"] = p.z.astype(float).ewm(alpha=1 / 3, adjust=False).mean()
        p["g"] = p.f.ewm(alpha=1 / 3, adjust=False).mean()
        p["h"] = p.z.astype(float).ewm(alpha=0.9, adjust=False).mean()
        parts.append(p)
    return pd.concat(parts).sort_values(["k", "t"]).reset_index(drop=True)


def same(got, want):
    got = got.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = want.reset_index(drop=True)
    assert len(got) == len(want)
    for name in "abmefgh":
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-11, atol=1e-11)


def test_blocks_equal_one_pass(spark):
    rows = series()
    frame = spark.createDataFrame(rows, "k int, t int, x double, z double").repartition(7)
    out = exponential_averages(frame, ["k"], "t", STEPS, DIFFERENCES)
    assert out.columns == ["k", "t", "x", "z", "a", "b", "e", "f", "g", "h", "m"]
    same(out, by_pandas(rows))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("cut", [0, 300, 1200, 10_000_000])
def test_carried_state_continues_the_series(spark, cut):
    rows = series(1)
    frame = spark.createDataFrame(rows, "k int, t int, x double, z double")
    past = exponential_averages(frame.filter(f"t <= {cut}"), ["k"], "t", STEPS, DIFFERENCES)
    state = average_state(past, ["k"], "t", STEPS)
    recent = exponential_averages(frame.filter(f"t > {cut}"), ["k"], "t", STEPS, DIFFERENCES, state=state)
    want = by_pandas(rows)
    same(recent, want[want.t > cut])


def test_guards(spark):
    twice = spark.createDataFrame([(1, 5, 1.0), (1, 5, 2.0)], "k int, t int, x double")
    with pytest.raises(Exception, match="several rows"):
        exponential_averages(twice, ["k"], "t", [("a", "x", {"span": 3})]).collect()
    with pytest.raises(ValueError):
        exponential_averages(twice, ["k"], "t", [("a", "missing", {"span": 3})])
    with pytest.raises(ValueError):
        exponential_averages(twice, ["k"], "x", [("a", "x", {"span": 3})])
    with pytest.raises(ValueError):
        exponential_averages(twice, ["k"], "t", [("a", "x", {"alpha": 1.0})])
    assert exponential_averages(twice.filter("false"), ["k"], "t", [("a", "x", {"span": 3})]).collect() == []
