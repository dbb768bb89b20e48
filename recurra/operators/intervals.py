"""Which gaps are genuine: robust local baselines over centred frames, in pieces of a series with the rows around them.

A series is numbered by stretches of time, cut into pieces of `piece` rows, and each piece gets the `HALO` rows on either side
that its frames reach (baselines look 400 rows away, medians of banded gaps 300 more), so no task holds a whole series.
Regimes (what kind of event began the gap) have baselines of their own where they have 200 rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.plans import catalog

from .pieces import numbered, reached

FAR, NEAR, LEAST = 400, 300, 200
HALO = FAR + NEAR


def _quantile(x: pd.Series, q: float, reach: int) -> np.ndarray:
    return x.rolling(2 * reach + 1, center=True, min_periods=1).quantile(q).to_numpy()


def _banded(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Median of the gaps near their own rows' bases."""
    near = (x >= 0.55 * base) & (x <= 1.4 * base)
    return _quantile(pd.Series(np.where(near, x, np.nan)), 0.5, NEAR)


def _baselines(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("rn")
    x = p["x"]
    p["p25"], p["p75"] = _quantile(x, 0.25, FAR), _quantile(x, 0.75, FAR)
    return p


def labels(iv: DataFrame, piece: int = 20_000, sparse: tuple[str, ...] = ()) -> DataFrame:
    """id, key, epoch, x, prev_x (the gap before), med_interval, med_long and is_valid of gaps (key, id, epoch, x, regime).

    The series in `sparse` are seldom seen, so most of their gaps hold events that nobody saw: their base is the tenth percentile
    of the pooled gaps, and they have no second mode.
    """
    rows = numbered(numbered(iv, "key"), "key", "regime", name="rr")
    sizes = iv.groupBy("key", "regime").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, ["key", "regime"])

    def regime(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rr")
        p["base"] = _quantile(p["x"], 0.25, FAR)
        p["med"] = _banded(p["x"].to_numpy(), p["base"].to_numpy())
        own = p["rr"] // piece == p["piece"]
        return p.loc[own, ["key", "id", "epoch", "x", "rn", "size", "base", "med"]]

    def pooled(p: pd.DataFrame) -> pd.DataFrame:
        p = _baselines(p)
        x, big = p["x"].to_numpy(), (p["size"] >= LEAST).to_numpy()
        few = p["key"].iloc[0] in sparse
        base = _quantile(p["x"], 0.10, FAR) if few else np.where(big, p["base"], p["p25"])
        med = _banded(x, base) if few else np.where(big, p["med"], _banded(x, base))
        long = _banded(x, p["p75"].to_numpy())
        with np.errstate(invalid="ignore"):
            second = (long >= 3.5 * med) & (x >= 0.5 * long) & (x <= 1.75 * long) & (not few)
            ok = ((x >= 0.5 * med) & (x <= 1.75 * med)) | second
        out = pd.DataFrame({"key": p["key"], "id": p["id"], "epoch": p["epoch"], "x": x, "prev_x": p["x"].shift(1), "med_interval": med, "med_long": long, "is_valid": ok & ~np.isnan(med)})
        return out[(p["rn"] // piece == p["piece"]).to_numpy()]

    fields = "key string, id long, epoch long, x double, rn long, size long, base double, med double"
    apart = rows.withColumn("piece", reached("rr", piece, HALO, HALO)).groupBy("key", "regime", "piece").applyInPandas(regime, fields)
    return apart.withColumn("piece", reached("rn", piece, HALO, HALO)).groupBy("key", "piece").applyInPandas(pooled, "key string, id long, epoch long, x double, prev_x double, med_interval double, med_long double, is_valid boolean")


def gaps(spark: SparkSession, events: DataFrame) -> DataFrame:
    """key, id, epoch, x, regime and what began each gap, of all gaps of a table of events."""
    text = catalog.CHAIN + " SELECT key, id, epoch, x, coalesce(prev_minor, false) regime, prev_minor, prev_electronic, prev_initial, prev_dur, hour(prev_lts) prev_hour, dayofyear(prev_lts) prev_day, month(lts) month_local FROM iv"
    return spark.sql(catalog.filled(text, catalog._SPARK), events=events)


ORACLE = (
    catalog.CHAIN
    + """, r AS (SELECT *, coalesce(prev_minor, false) g, count(*) OVER (PARTITION BY key, coalesce(prev_minor, false)) size FROM iv),
  a AS (SELECT *, quantile_cont(x, 0.25) OVER (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 400 PRECEDING AND 400 FOLLOWING) p25, quantile_cont(x, 0.25) OVER (PARTITION BY key, g ORDER BY epoch, id ROWS BETWEEN 400 PRECEDING AND 400 FOLLOWING) r25,
    quantile_cont(x, 0.75) OVER (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 400 PRECEDING AND 400 FOLLOWING) p75 FROM r),
  b AS (SELECT *, CASE WHEN size >= 200 THEN r25 ELSE p25 END base FROM a),
  m AS (SELECT *, median(CASE WHEN x BETWEEN 0.55e0 * base AND 1.4e0 * base THEN x END) OVER (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 300 PRECEDING AND 300 FOLLOWING) mp,
    median(CASE WHEN x BETWEEN 0.55e0 * base AND 1.4e0 * base THEN x END) OVER (PARTITION BY key, g ORDER BY epoch, id ROWS BETWEEN 300 PRECEDING AND 300 FOLLOWING) mr,
    median(CASE WHEN x BETWEEN 0.55e0 * p75 AND 1.4e0 * p75 THEN x END) OVER (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 300 PRECEDING AND 300 FOLLOWING) ml FROM b),
  l AS (SELECT *, CASE WHEN size >= 200 THEN mr ELSE mp END med FROM m)
  SELECT key, id, round(x, 6) x, round(med, 6) med_interval, round(ml, 6) med_long, (med IS NOT NULL AND x >= 0.5e0 * med AND x <= 1.75e0 * med) OR (med IS NOT NULL AND ml IS NOT NULL AND ml >= 3.5e0 * med AND x >= 0.5e0 * ml AND x <= 1.75e0 * ml) is_valid FROM l"""
)


def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels(gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet")))
    return out.select("key", "id", *[F.round(c, 6).alias(c) for c in ("x", "med_interval", "med_long")], "is_valid")


#: The series that count as seldom seen in sparse_labels.
SPARSE = ("error",)


def sparse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interval_labels, with one series that counts as seldom seen."""
    out = labels(gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet")), sparse=SPARSE).where(F.col("key").isin(*SPARSE))
    return out.select("key", "id", *[F.round(c, 6).alias(c) for c in ("x", "med_interval")], "is_valid")


def second_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels(gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet")))
    long = (F.col("med_long") >= 3.5 * F.col("med_interval")) & F.col("x").between(0.5 * F.col("med_long"), 1.75 * F.col("med_long"))
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid"), F.count_if(long).alias("second_mode"))


def queries() -> dict:
    return {"interval_labels": interval_labels, "second_mode": second_mode, "sparse_labels": sparse_labels}


def oracle_sql() -> dict[str, str]:
    text = catalog.filled(ORACLE, catalog._DUCK)
    count = ", l2 AS (SELECT *, ml >= 3.5e0 * med AND x BETWEEN 0.5e0 * ml AND 1.75e0 * ml long, (x BETWEEN 0.5e0 * med AND 1.75e0 * med) near FROM l) SELECT key, count(*) n, count(*) FILTER (WHERE near OR long) valid, count(*) FILTER (WHERE long) second_mode FROM l2 GROUP BY key"
    sparse = """@CHAIN@, own AS (SELECT * FROM iv WHERE key = 'error'),
      a AS (SELECT *, quantile_cont(x, 0.10) OVER (ORDER BY epoch, id ROWS BETWEEN 400 PRECEDING AND 400 FOLLOWING) base FROM own),
      m AS (SELECT *, median(CASE WHEN x BETWEEN 0.55e0 * base AND 1.4e0 * base THEN x END) OVER (ORDER BY epoch, id ROWS BETWEEN 300 PRECEDING AND 300 FOLLOWING) med FROM a)
      SELECT key, id, round(x, 6) x, round(med, 6) med_interval, coalesce(x >= 0.5e0 * med AND x <= 1.75e0 * med, false) is_valid FROM m"""
    return {"sparse_labels": catalog.filled(sparse, catalog._DUCK), "interval_labels": text, "second_mode": text[: text.index("  SELECT key, id, round(x, 6) x")] + count}
