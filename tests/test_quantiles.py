"""Percentiles by radix selection equal numpy's, under ties, signs and extremes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import quantiles as Q

PROBS = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0]


def values(seed):
    r = np.random.default_rng(seed)
    yield r.normal(size=3000)
    yield np.repeat([1.0, 2.0, -3.0], [2000, 5, 900])  # heavy ties
    yield np.concatenate([10.0 ** r.uniform(-300, 300, 500), -(10.0 ** r.uniform(-300, 300, 500)), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf]])
    yield np.array([7.0])


@pytest.mark.parametrize("sent", [0, 10_000])
def test_radix_equals_numpy(spark, monkeypatch, sent):
    monkeypatch.setattr(Q, "BOUND", 0)
    monkeypatch.setattr(Q, "SENT", sent)
    groups = list(values(1))
    d = spark.createDataFrame([(g, float(x), 1) for g, v in enumerate(groups) for x in v] + [(0, None, 1), (9, None, 1)], "g int, x double, n int")
    exact = {r.g: r for r in Q.quantiles(d, "x", PROBS, ["g"], discrete=True).collect()}
    mixed = {r.g: r for r in Q.quantiles(d, "x", PROBS, ["g"]).collect()}
    assert set(exact) == set(mixed) == {0, 1, 2, 3}
    for g, v in enumerate(groups):
        assert exact[g].n == len(v)
        assert exact[g].p == [np.sort(v)[max(math.ceil(p * len(v)) - 1, 0)] for p in PROBS]
        if g != 2:
            assert np.allclose(mixed[g].p, np.percentile(v, [100 * p for p in PROBS]), rtol=1e-12)


def test_both_ways_agree(spark, monkeypatch):
    d = spark.range(5000).select((F.hash("id") % 97 / 7.0).alias("x"))
    a = [Q.quantiles(d, "x", PROBS, discrete=k).first() for k in (False, True)]
    monkeypatch.setattr(Q, "BOUND", 10)
    b = [Q.quantiles(d, "x", PROBS, discrete=k).first() for k in (False, True)]
    assert np.allclose(a[0].p, b[0].p) and a[1].p == b[1].p and a[0].n == b[0].n == 5000
    assert Q.with_quantiles(d, "x", [0.5]).select("p").distinct().count() == 1


def test_no_values(spark, monkeypatch):
    none = spark.createDataFrame([(1, None)], "g int, x double")
    assert Q.quantiles(none, "x", [0.5], discrete=True).first().p is None and Q.quantiles(none, "x", [0.5]).first().p is None
    assert Q.quantiles(none, "x", [0.5], ["g"]).count() == 0
    monkeypatch.setattr(Q, "BOUND", 0)
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert np.isnan(Q.quantiles(nan, "x", [1.0]).first().p[0]) and Q.quantiles(nan, "x", [0.5]).first().p == [2.0]


def test_a_round_ranks_counts_alone(spark, monkeypatch):
    """A hundred thousand equal values reach the window as one row."""
    monkeypatch.setattr(Q, "BOUND", 0)
    d = spark.range(100_000).select(F.lit(3.25).alias("x")).union(spark.range(10).select(F.col("id").cast("double").alias("x")))
    assert Q.quantiles(d, "x", [0.5], discrete=True).first().p == [3.25]


@pytest.mark.parametrize("bound", [1_000_000, 10])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles_equal_numpy(spark, monkeypatch, bound, by):
    monkeypatch.setattr(Q, "BOUND", bound)
    r = np.random.default_rng(1)
    rows = [(int(g), None if i % 50 == 0 else float(x)) for i, (g, x) in enumerate(zip(r.integers(0, 3, 4000), r.normal(size=4000).round(2)))]
    probs = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = {tuple(x[c] for c in by): (x["p"], x["n"]) for x in Q.quantiles(spark.createDataFrame(rows, "g int, x double"), "x", probs, by).collect()}
    groups = {(): [x for _, x in rows if x is not None]} if not by else {(g,): [x for h, x in rows if x is not None and h == g] for g in range(3)}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g][1] == len(xs) and np.allclose(got[g][0], np.quantile(xs, probs), atol=1e-12)


def test_quantiles_of_nothing(spark):
    d = spark.createDataFrame([(1, None)], "g int, x double")
    assert Q.quantiles(d, "x", [0.5], ["g"]).count() == 0
    assert [tuple(r) for r in Q.quantiles(d, "x", [0.5]).collect()] == [(None, 0)]


def test_trimmed_median_reads_its_rows_once(spark):
    """Sums that come out otherwise in their last bits each time must not move a value across its own percentile (F4)."""
    import os

    from pyspark.sql import functions as F

    from skyloom.operators.robust import trimmed_median

    noisy = F.udf(lambda v: v + 1e-9 * os.urandom(1)[0], "double").asNondeterministic()
    rows = spark.range(200 * 11).select((F.col("id") % 200).alias("g"), noisy(F.floor(F.col("id") / 200).cast("double")).alias("v"))
    out = trimmed_median(rows, "v", ["g"], 0.1, 0.9).collect()
    assert len(out) == 200 and all(abs(r["median"] - 5) < 1e-6 for r in out)
