"""Numbering, framed windows and carried values against pandas, over stretches that are empty, tied or before 1970."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recurra.operators.pieces import carried, framed, numbered


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    rows = []
    for key, n in (("a", 400), ("b", 37), ("c", 1)):
        t = np.sort(np.concatenate((rng.integers(-400_000, 300_000, n - n // 4), rng.integers(2_000_000, 2_050_000, n // 4))))
        rows += [(key, i + 1000 * len(key) + 10_000 * ord(key), int(v), None if rng.random() < 0.6 else float(rng.integers(1, 99)), float(rng.random())) for i, v in enumerate(t)]
    return pd.DataFrame(rows, columns=["key", "id", "epoch", "v", "x"])


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [(k, i, t, None if pd.isna(v) else v, x) for k, i, t, v, x in table.itertuples(index=False)]
    return spark.createDataFrame(rows, "key string, id long, epoch long, v double, x double").repartition(5)


def test_numbers(df, table):
    want = dict(zip(table["id"], table.groupby("key").cumcount()))
    assert {r.id: r.rn for r in numbered(df, "key").collect()} == want


@pytest.mark.parametrize("back,size", [(0, 5), (7, 5), (99, 40), (3, 10_000)])
def test_framed_is_a_window(df, table, back, size):
    got = {r.id: r.s for r in framed(df, "key", back, lambda w: {"s": F.sum("x").over(w)}, size).collect()}
    want = table.groupby("key")["x"].rolling(back + 1, min_periods=1).sum().reset_index(level=0, drop=True)
    assert got == {i: pytest.approx(s) for i, s in zip(table["id"], want)}


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("itself", [False, True])
def test_carried_is_a_fill(df, table, ahead, itself):
    got = {r.id: r.last for r in carried(df, "key", "epoch", "id", {"last": F.col("v")}, ahead, itself).collect()}
    for _, g in table.groupby("key"):
        v = g["v"] if itself else g["v"].shift(-1 if ahead else 1)
        want = v.bfill() if ahead else v.ffill()
        assert [got[i] for i in g["id"]] == [None if pd.isna(x) else x for x in want]


def test_nothing(df):
    none = df.limit(0)
    assert numbered(none, "key").count() == framed(none, "key", 3, lambda w: {"s": F.sum("x").over(w)}).count() == carried(none, "key", "epoch", "id", {"last": F.col("v")}).count() == 0
