"""Models with covariates and the ledger: known parameters and the rules of matching."""

import numpy as np
import pytest

from recurra.functions import dist
from recurra.sources import ledger


def test_regression_finds_its_coefficients():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(6000, 2))
    x = np.exp(z @ [0.3, -0.2] + 4) * rng.weibull(2.5, 6000)
    b, shape = dist.weibull_regression(x, z, ridge=1e-6)
    assert np.allclose(b, [0.3, -0.2, 4], atol=0.03) and abs(shape - 2.5) < 0.08
    assert dist.weibull_regression(x[:50], z[:50]) is None


def test_regression_without_covariates_is_the_plain_fit():
    x = 80 * np.random.default_rng(5).weibull(3.2, 1000)
    b, shape = dist.weibull_regression(x, np.zeros((1000, 0)))
    d = dist.weibull(x)
    assert abs(shape - d.a) < 1e-3 and abs(np.exp(b[-1]) - d.b) < 1e-2


def test_series_has_two_modes():
    rng = np.random.default_rng(6)
    first = np.arange(600) % 3 == 0
    x = np.where(first, rng.lognormal(np.log(600), 0.2, 600), rng.lognormal(np.log(83), 0.08, 600))
    d = dist.series_conditional(x, first, True)
    assert isinstance(d, dist.Mixture) and abs(d.w - 0.95) < 1e-9 and 500 < float(d.ppf(0.5)) < 700
    assert float(dist.series_conditional(x, first, False).ppf(0.5)) < 100
    assert isinstance(dist.series_conditional(x[~first], first[~first], False), dist.Dist)
    assert dist.series_conditional(x[:50], first[:50], True) is None


@pytest.fixture
def frames(spark):
    def make(forecasts, events):
        held = spark.createDataFrame([(s, "x", i, t, p, a, b, None, None, "") for s, i, t, p, a, b in forecasts], ledger.OPEN)
        return held, spark.createDataFrame([("x", i, t) for i, t in events], "key string, event_id long, epoch long"), spark.createDataFrame([], ledger.SCORED)

    return make


def test_ledger_matches_the_latest_before(frames):
    held, events, scored = frames([("s", "a", 0, 100, None, None), ("s", "b", 50, 160, 100, 220), ("s", "c", 200, 300, None, None), ("t", "d", 10, 400, 390, 410)], [(1, 200)])
    still, kept, stats = ledger.applied(held, events, scored, 1000)
    assert [r["forecast_id"] for r in still.collect()] == ["c"]  # issued in the second of the event: still open
    got = {r["source"]: r for r in kept.collect()}
    assert got["s"]["issued"] == 50 and got["s"]["signed_error_min"] == pytest.approx(0.7) and got["s"]["in_window"] and got["s"]["superseded"] == 1
    assert got["t"]["in_window"] is False
    assert {r["stat"]: r["n"] for r in stats.collect()} == {"superseded": 1, "expired": 0, "beyond_horizon": 0}
    again = ledger.applied(held, events, kept, 1000)[1]
    assert again.count() == 2


def test_ledger_horizon_expiry_and_order(frames):
    """An event that comes long after the prediction is beyond the horizon; one that comes long before it is scored."""
    far, day = 7 * 3600, 86400
    held, events, scored = frames([("s", "a", 0, 10, None, None), ("t", "b", 0, 10 + 2 * far, None, None), ("s", "c", far + 60, far + 70, None, None)], [(1, far + 20)])
    still, kept, stats = ledger.applied(held, events, scored, far + 60 + 3 * day)
    assert still.count() == 0 and [(r["source"], r["event_id"], r["signed_error_min"]) for r in kept.collect()] == [("t", 1, pytest.approx(-419.8))]
    assert {r["stat"]: r["n"] for r in stats.collect()} == {"superseded": 0, "expired": 1, "beyond_horizon": 1}
    wide = frames([("s", "a", 0, 10, 0, far), ("u", "b", 0, 10, 0, 3600)], [(1, 10 + 3 * far)])
    assert [r["source"] for r in ledger.applied(*wide, 4 * day)[1].collect()] == ["s"]


def test_ledger_behind_http(spark, frames):
    held, _, scored = frames([("s", "a", 0, 1, None, 5)], [(1, 1)])
    page = []
    http = ledger.Http(spark, lambda: page[-1] if page else None, page.append)
    assert http.read("open", ledger.OPEN).count() == 0
    http.write(open=held, scored=scored)
    assert http.read("open", ledger.OPEN).collect() == held.collect() and http.read("scored", ledger.SCORED).count() == 0


def test_first_seen_stays(frames):
    held, _, _ = frames([("s", "a", 0, 1, None, None)], [(1, 1)])
    new, _, _ = frames([("s", "a", 5, 9, None, None), ("s", "b", 6, 9, None, None), ("s", "b", 7, 8, None, None)], [(1, 1)])
    got = sorted((r["forecast_id"], r["issued"]) for r in ledger.added(held, new).collect())
    assert got == [("a", 0), ("b", 6)]


def test_store_keeps_generations(spark, frames, tmp_path):
    held, _, scored = frames([("s", "a", 0, 1, None, None)], [(1, 1)])
    store = ledger.Store(spark, str(tmp_path / "ledger"))
    assert store.read("open", ledger.OPEN).count() == 0
    for n in (1, 2, 3):
        assert store.write(open=held, scored=scored) == n
    assert store.read("open", ledger.OPEN).count() == 1 and store.read("scored", ledger.SCORED).count() == 0
    assert sorted(p.name for p in (tmp_path / "ledger").iterdir()) == ["g2", "g3"]
