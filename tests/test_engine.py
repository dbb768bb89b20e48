"""The catalogue against DuckDB, and models against what must hold of them."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from recurra.functions import dist
from recurra.operators import forecasts, intervals, models, trailing
from recurra.plans import catalog, scoring

DATA = "/root/testdata/sf0.001"
QUERIES = catalog.queries() | scoring.queries() | trailing.queries() | intervals.queries() | models.queries()
ORACLE = catalog.oracle_sql() | scoring.oracle_sql() | trailing.oracle_sql() | intervals.oracle_sql() | models.oracle_sql()


def rows(frame: pd.DataFrame) -> list[str]:
    cell = lambda v: "-" if pd.isna(v) else v if isinstance(v, str) else round(float(v), 5)
    return sorted(str([cell(v) for v in r]) for r in frame[sorted(frame)].itertuples(index=False))


@pytest.mark.parametrize("name", ["still_open", "beyond_horizon", "comparisons_page", "cap_open_per_series", "basin_activity_range", "recent_gaps", "duration_split_intervals", "sparse_labels", "typed_events", "dedupe_gaps", "raw_intervals", "interval_stats", "asof_backward", "asof_forward", "interval_semi", "lognormal_intervals", "minor_conditional_intervals", "prediction_match", "score_rows", "scoreboard", "minute_rms", "feed_parse", "interval_labels", "second_mode", *models.FITS])
def test_oracle(spark, name):
    query = QUERIES[name]
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{DATA}/events.parquet')")
    got, want = query(spark, DATA).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got) == sorted(want) and len(got) > 0
    assert rows(got) == rows(want)


def test_pieces_do_not_change_labels(spark):
    iv = intervals.gaps(spark, spark.read.parquet(f"{DATA}/events.parquet"))
    assert rows(intervals.labels(iv, 37).toPandas()) == rows(intervals.labels(iv, 100_000).toPandas())


def test_no_forecast_is_matched_with_the_event_it_was_made_at(spark):
    got = scoring.queries()["score_rows"](spark, DATA).selectExpr("min(lead_min) least", "count(*) n").first()
    assert got.n > 0 and got.least > 0


def test_pieces_do_not_change_trailing_fits(spark):
    iv = intervals.gaps(spark, spark.read.parquet(f"{DATA}/events.parquet"))
    assert rows(trailing.intervals_of(iv, "minor_conditional_intervals", 37).toPandas()) == rows(trailing.intervals_of(iv, "minor_conditional_intervals").toPandas())


def test_normal_functions():
    x = np.linspace(-6, 6, 301)
    assert np.allclose(dist.erfc(x), [math.erfc(v) for v in x], rtol=1e-13, atol=0)
    assert np.allclose(dist.phi(dist.inverse_phi(np.linspace(0.001, 0.999, 99))), np.linspace(0.001, 0.999, 99), atol=1e-14)


def test_weibull_finds_its_parameters():
    d = dist.weibull(80 * np.random.default_rng(1).weibull(3.2, 4000))
    assert abs(d.a - 3.2) < 0.15 and abs(d.b - 80) < 2


def test_crps_of_a_normal():
    d, y = dist.Dist("normal", 0.0, 1.0), 0.7
    exact = y * (2 * float(d.cdf(y)) - 1) + 2 * math.exp(-y * y / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)
    assert abs(dist.crps(d, y, 4096) - exact) < 2e-3


def test_changepoint_and_mixture():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(150, 5, 300), rng.normal(100, 5, 200)))
    assert abs(dist.last_changepoint(x) - 300) <= 2
    m = dist.Mixture(dist.Dist("lognormal", 4.0, 0.1), dist.Dist("lognormal", 4.0, 0.5))
    q = np.array([0.05, 0.5, 0.95])
    assert np.allclose(m.cdf(m.ppf(q)), q, atol=1e-6)


def test_renewal_limits():
    d = dist.Dist("lognormal", math.log(90), 0.15)
    s, w, missed, none = dist.renewal(d, 0.0, 0.9)
    assert missed == 0 and abs(none - 1) < 1e-9 and abs(dist.weighted_quantile(s, w, 0.5) - 90) < 4
    assert dist.renewal(d, 200.0, 0.5)[2] > 1


def test_forecasts_have_rows(spark):
    assert forecasts.crps_by_model(spark, "/root/testdata/sf0.01").where("crps > 0 and cover90 between 0.5 and 1").count() > 0


def test_every_gap_is_forecast(spark):
    rng = np.random.default_rng(2)
    sizes = {"a": 150, "b": 2600, "c": 61, "d": 60}
    rows = [(k, 10_000 * j + i, 60 * (i // 2), float(rng.lognormal(4, 0.3)), False) for j, (k, n) in enumerate(sizes.items()) for i in range(n)]
    iv = spark.createDataFrame(rows, "key string, id long, epoch long, x double, regime boolean").repartition(3)
    def past(key, ids, x, branch, at):
        return pd.DataFrame([(key, ids[i], x[i], len(p := x[max(0, i - 2000) : i]), float(p.sum())) for i in at], columns=["key", "id", "x", "n", "s"])

    got = {(r.key, r.id): (r.x, r.n, r.s) for r in models.by_piece(iv, past, "key string, id long, x double, n long, s double", least=60, piece=700).collect()}
    want = {}
    for k, n in sizes.items():
        x = [r[3] for r in rows if r[0] == k]
        ids = [r[1] for r in rows if r[0] == k]
        want |= {(k, ids[i]): (x[i], len(p := x[max(0, i - 2000) : i]), pytest.approx(sum(p))) for i in range(60, n)}
    assert got == want
    few = iv.where("key = 'a'")
    assert forecasts.predictions(few).where("model = 'lognormal'").count() == 90
    assert forecasts.renewals(few).count() == 3 * 90
