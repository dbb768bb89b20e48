"""Fits of many gaps at once against the fits of one, and the model tables on small series."""

import numpy as np
import pandas as pd
import pytest

from recurra.functions import batch, dist
from recurra.operators import forecasts, models, roster, samples


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.lognormal(3, 0.4, 700), 40 * rng.weibull(2, 800), rng.exponential(12, 900), np.where(rng.random(800) < 0.3, rng.lognormal(1, 0.2, 800), rng.lognormal(4, 0.3, 800))))
    at = np.unique(np.concatenate((rng.choice(len(x), 150, replace=False), [0, 1, 11, 12, 23, 24, 59, 60, 61, 79, 80, 81, 299, 300, 301, 800, 801, len(x) - 1])))
    return x, rng.random(len(x)) < 0.4, at


ONE = {
    "lognormal": (lambda x, b, at: batch.lognormal(x, at), lambda x, b, i: dist.lognormal(x[:i][-100:])),
    "weibull": (lambda x, b, at: batch.weibull(x, at), lambda x, b, i: dist.weibull(x[:i][-100:])),
    "best_parametric": (lambda x, b, at: batch.best_parametric(x, at), lambda x, b, i: dist.best_parametric(x[:i])),
    "adaptive": (lambda x, b, at: batch.adaptive_lognormal(x, at)[0], lambda x, b, i: dist.adaptive_lognormal(x[:i])),
    "tail": (lambda x, b, at: batch.widened(x, at), lambda x, b, i: dist.widened(x[:i])),
    "series": (lambda x, b, at: batch.series_conditional(x, b, at), lambda x, b, i: dist.series_conditional(x[:i], b[:i], b[i])),
}


@pytest.mark.parametrize("name", ONE)
def test_many_is_one_by_one(series, name):
    x, branch, at = series
    many, one = ONE[name][0](x, branch, at), ONE[name][1]
    q, scores, pit = many.ppf([0.05, 0.5, 0.95]), batch.crps(many, x[at]), many.cdf(x[at])
    seen = 0
    for k, i in enumerate(at.tolist()):
        d = one(x, branch, i)
        assert (d is not None) == many.known[k]
        if d is not None:
            seen += 1
            assert np.allclose(d.ppf(np.array([0.05, 0.5, 0.95])), q[k], rtol=1e-9)
            assert abs(float(d.cdf(x[i])) - pit[k]) < 1e-10 and abs(dist.crps(d, float(x[i])) - scores[k]) < 1e-6 * max(1, scores[k])
    assert seen > 100


def test_normal_distribution_function():
    z = np.random.default_rng(1).normal(0, 3, 100_000)
    assert np.abs(batch.phi(z) - dist.phi(z)).max() < 1e-12
    assert batch.phi(np.array([-50.0, 50.0])).tolist() == pytest.approx([0, 1], abs=1e-15) and np.isnan(batch.phi(np.array([np.nan])))[0]


def test_renewals_of_many_are_those_of_one():
    many = batch.Many([4.0, 3.0], [0.2, 0.5], None, np.array([4.0, 3.0]), np.array([0.5, 1.0]), np.array([0.15, 0.0]))
    draws = batch.Draws(200_000, 12)
    for k, one in ((0, dist.Mixture(dist.Dist("lognormal", 4.0, 0.2), dist.Dist("lognormal", 4.0, 0.5))), (1, dist.Dist("lognormal", 3.0, 0.5))):
        middle = float(one.ppf(0.5))
        for a, (missed, none, q) in zip((0.5, 1.5, 3.0), draws.renewals(many, k, [a * middle for a in (0.5, 1.5, 3.0)], 0.9)):
            s, w, m, n = dist.renewal(one, a * middle, 0.9, 200_000)
            assert abs(missed - m) < 0.05 * max(1, m) and abs(none - n) < 0.03
            assert np.allclose(q, [dist.weighted_quantile(s, w, p) - a * middle for p in (0.05, 0.5, 0.95)], atol=0.06 * middle)


def test_series_of_any_length(spark):
    """Empty, short and equal gaps: no row where there is too little, and no failure."""
    schema = "key string, id long, epoch long, x double, regime boolean, prev_initial boolean"
    assert all(models.fits(spark.createDataFrame([], schema), name).count() == 0 for name in models.FITS)
    rows = [("same", i, 60 * i, 5.0, False, None) for i in range(90)] + [("few", 1000 + i, 60 * i, 1.0 + i, False, True) for i in range(11)]
    iv = spark.createDataFrame(rows, schema)
    assert models.fits(iv, "weibull_intervals").count() == 0  # gaps that never vary have no shape
    assert models.fits(iv, "parametric_choice").where("family = 'lognormal'").count() == 90 - 24
    assert models.fits(iv, "tail_mixtures").where("key = 'few'").count() == 0
    found = {r.id: r.begins for r in models.fits(iv, "changepoints").collect()}
    assert found == {i: dist.last_changepoint(np.full(i, 5.0)) for i in range(80, 90)}


def test_pieces_do_not_show(spark, series):
    x, branch, _ = series
    rows = [("a", i, 60 * i, float(v), bool(b)) for i, (v, b) in enumerate(zip(x[:900], branch))]
    iv = spark.createDataFrame(rows, "key string, id long, epoch long, x double, prev_initial boolean").repartition(3)
    for name in ("changepoints", "adaptive_fits", "series_modes"):
        whole, cut = (models.fits(iv, name, piece=n).toPandas().sort_values("id").reset_index(drop=True) for n in (5000, 130))
        pd.testing.assert_frame_equal(whole, cut, rtol=1e-9)


def test_reliability_counts_every_level(spark):
    got = forecasts.pit_reliability(spark, "/root/testdata/sf0.001").toPandas()
    assert set(got.groupby("model").size()) == {101} and got["share"].between(0, 1).all()
    assert got.sort_values(["model", "level"]).groupby("model")["share"].apply(lambda s: s.is_monotonic_increasing and s.iloc[-1] == 1).all()


def test_roster_together_is_one_by_one():
    """Every model of the roster, for all places of a piece and for one after the other."""
    rng = np.random.default_rng(8)
    n = 700
    flags = {c: rng.random(n) < 0.4 for c in ("prev_minor", "prev_electronic", "prev_initial")}
    x = np.where(flags["prev_initial"], rng.lognormal(4, 0.2, n), rng.lognormal(2, 0.3, n))
    dur = np.where(rng.random(n) < 0.7, rng.uniform(50, 250, n), np.where(rng.random(n) < 0.5, np.nan, 0.0))
    p = pd.DataFrame({"x": x, "prev_x": np.append(np.nan, x[:-1]), "prev_dur": dur, **flags, "prev_hour": rng.integers(0, 24, n), "prev_day": rng.integers(1, 366, n)})
    at = np.array([0, 7, 8, 12, 24, 30, 59, 60, 61, 80, 81, 199, 200, 201, 250, 400, 455, 699])
    for name, (make, together) in roster.TOGETHER.items():
        many, one = together(p, at), make()
        q, scores = many.ppf([0.05, 0.5, 0.95]), batch.crps(many, x[at])
        for k, i in enumerate(at.tolist()):
            d = one(p.iloc[:i], p.iloc[i])
            assert (d is not None) == many.known[k], (name, i)
            if d is not None:
                assert np.allclose(d.ppf(np.array([0.05, 0.5, 0.95])), q[k], rtol=1e-8), (name, i)
                assert abs(dist.crps(d, x[i]) - scores[k]) < 1e-6 * max(1, scores[k]), (name, i)


def test_weighted_samples(spark):
    """Quantiles, shares and scores of weighted samples against numpy; ties, zero and null weights, and no samples."""
    rng = np.random.default_rng(9)
    x = np.round(rng.lognormal(2, 1.5, 400), 1) + 0.1
    w = rng.random(400)
    rows = [("a", float(v), float(u)) for v, u in zip(x, w)] + [("a", 3.0, None), ("a", 1e6, 0.0), ("a", 0.001, -1.0), ("one", 5.0, 2.0), ("none", 1.0, 0.0)]
    d = spark.createDataFrame(rows, "key string, x double, w double").repartition(3)
    levels = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.key, r.level): r.value for r in samples.quantiles(d, levels).collect()}
    values = np.unique(x)
    shares = np.array([w[x <= v].sum() for v in values]) / w.sum()
    assert {k for k, _ in got} == {"a", "one"}
    for q in levels[1:4]:
        assert got["a", q] == pytest.approx(float(np.interp(q, shares, values)))
        assert got["one", q] == 5.0
    y = spark.createDataFrame([("a", 9.0), ("one", 4.0), ("none", 1.0)], "key string, y double")
    found = {r.key: (r.share, r.crps) for r in samples.scores(d, y).collect()}
    assert found["a"] == (pytest.approx(w[x <= 9].sum() / w.sum()), pytest.approx(dist.crps_sample(x, w, 9.0)))
    assert found["one"] == (0.0, pytest.approx(1.0)) and "none" not in found
    assert samples.quantiles(d.limit(0), levels).count() == 0


def test_thinned_is_even(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("long", 5000), ("short", 320), ("few", 300)) for i in range(n)], "key string, rn long")
    got = roster.thinned(rows, 300, 500).toPandas().groupby("key")["rn"].apply(sorted)
    assert got["long"] == np.unique(300 + np.arange(500) * 4699 // 499).tolist() and got["long"][-1] == 4999
    assert got["short"] == list(range(300, 320)) and "few" not in got
