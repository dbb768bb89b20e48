"""Nowcasts against what must hold of them; coverage and the veto against DuckDB."""

import duckdb
import numpy as np
import pytest

from recurra.functions import dist
from recurra.operators import nowcasts
from recurra.plans import catalog

from .test_engine import rows

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["all_gap_coverage", "regional_veto", "nowcast_inputs"])
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{DATA}/events.parquet')")
    want = con.sql((catalog.oracle_sql() | nowcasts.oracle_sql())[name]).df()
    got = (catalog.queries() | nowcasts.queries())[name](spark, DATA).toPandas()
    assert len(got) > 0 and rows(got) == rows(want)


def test_sample_crps_is_the_integral():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=200), rng.random(200)
    t = np.linspace(-8, 8, 400_001)
    order = np.argsort(x)
    f = np.concatenate(([0], np.cumsum(w[order]) / w.sum()))[np.searchsorted(x[order], t, side="right")]
    assert abs(dist.crps_sample(x, w, 0.4) - ((f - (t >= 0.4)) ** 2).sum() * (t[1] - t[0])) < 1e-3


def test_announcement_fades():
    rng = np.random.default_rng(1)
    fresh, late = nowcasts.announcement(1.0, rng, 2000), nowcasts.announcement(20.0, rng, 2000)
    assert fresh[0] > 0.9 and late[0] < fresh[0] and (late[1] > 0).all()
    assert abs(np.median(fresh[1]) - 10.9) < 1 and nowcasts.announcement(41.0, rng, 2000)[0] == 0


def test_only_the_past_is_known(spark):
    gaps = [("purchase", i, 3600 * i, 60.0, True) for i in range(1, 30)] + [("signup", 100, 3600 * 20 + 1200, 60.0, True)]
    iv = spark.createDataFrame(gaps, "key string, id long, epoch long, x double, is_valid boolean")
    got = {r["t"]: r for r in nowcasts.known(iv, nowcasts.ANNOUNCES).where("key = 'purchase'").collect()}
    assert min(got) == 12 * 3600 and all(r["own"] == t // 3600 * 3600 for t, r in got.items())
    assert [t for t, r in got.items() if r["announced"]] == [3600 * 20 + 1800]
    assert all(r["next"] == r["own"] + 3600 for t, r in got.items() if r["own"] < 29 * 3600) and got[29 * 3600]["next"] is None
    out = nowcasts.nowcasts(iv).where("key = 'purchase'").collect()
    assert {r["regime"] for r in out if r["t"] == 3600 * 20 + 1800} == {"indicator_active"}
    assert all(r["lo90"] <= r["median"] <= r["hi90"] for r in out)
    assert nowcasts.nowcasts(iv.limit(0)).count() == 0


def test_triggers_precursors_and_the_lattice(spark):
    """Extra times after an announcement, a shift while precursors count, the neighbour's period; each against values worked out by hand."""
    own = [("view", i, 7200 * i, 120.0, i != 20) for i in range(1, 30)]
    near = [("click", 100, 7200 * 20 + 600, 20.0, True), ("click", 101, 7200 * 21 + 6000, 20.0, True), ("error", 102, 7200 * 20 + 600, 20.0, True)]
    cycle = [("signup", 200 + i, 1200 * i, 20.0, True) for i in range(1, 130)]
    iv = spark.createDataFrame(own + near + cycle, "key string, id long, epoch long, x double, is_valid boolean")
    got = {r["t"]: r for r in nowcasts.known(iv, {"click": "view"}, 1800, nowcasts.PRECURSORS, nowcasts.LATTICES, (1, 4, 8)).where("key = 'view'").collect()}
    assert all(7200 * 20 + 600 + 60 * m in got for m in (1, 4, 8))
    assert got[7200 * 20]["shift"] == 0 and got[7200 * 20 + 1800]["shift"] == 5 and got[7200 * 21 + 5400]["shift"] == 0 and got[7200 * 22]["shift"] == 0
    assert got[7200 * 13 + 1800]["lattice"].period == 20 and got[7200 * 28]["lattice"] is None  # the last of the cycle is too old
    assert got[7200 * 19 + 1800]["next"] == 7200 * 20 and got[7200 * 19 + 1800]["next_valid"] is False
    g = nowcasts.gate(np.array([1.0, 9.0, 20.0, 28.0]), 19.0)
    assert g[0] == 1 and abs(g[1] - (1 - 0.95 * (1 - 4.2 * (9 / 19) ** 0.5 / 4.75))) < 1e-9 and g[2] == 1 and g[1] < g[3] <= 1
    out = nowcasts.backtest(nowcasts.nowcasts(iv, {"click": "view"}, precursors=nowcasts.PRECURSORS)).where("key = 'view'").collect()
    n = {r["regime"]: r["n"] for r in out}
    assert n["overall"] == sum(v for k, v in n.items() if k != "overall") and n["overall"] > 10
