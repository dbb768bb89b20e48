"""Scores of the fitted models, and renewal forecasts, at every gap of every series.

Every gap after the first WARM of its series is a decision, made from the gaps strictly before it.  The gaps of a piece of a series are
fitted and scored together (models.by_piece, functions/batch.py).
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.functions import batch
from recurra.functions.sqlmath import phi
from recurra.plans import catalog

from . import models
from .intervals import gaps
from .models import LEVELS, by_piece

WARM = 60
MODELS = {"lognormal": batch.lognormal, "weibull": batch.weibull, "best_parametric": batch.best_parametric, "adaptive_lognormal": lambda x, at: batch.adaptive_lognormal(x, at)[0], "tail_mixture": batch.widened}


def predictions(iv: DataFrame) -> DataFrame:
    """model, key, id, x, median, the 50 and 90 % intervals, crps and pit of every decision; models that cannot be fitted give no row."""

    def answer(key, ids, x, branch, at):
        out = []
        for name, fit in MODELS.items():
            many = fit(x, at)
            own = np.flatnonzero(many.known)
            many, y = many.take(own), x[at[own]]
            q = many.ppf([*LEVELS.values()])
            out.append(pd.DataFrame({"model": name, "key": key, "id": ids[at[own]], "x": y, "crps": batch.crps(many, y), "pit": many.cdf(y)} | {c: q[:, k] for k, c in enumerate(LEVELS)}))
        return pd.concat(out)

    return by_piece(iv, answer, "model string, key string, id long, x double, lo90 double, lo50 double, median double, hi50 double, hi90 double, crps double, pit double", least=WARM)


def renewals(iv: DataFrame, ages=(0.5, 1.5, 3.0), p_seen: float = 0.9, sims: int = 4000) -> DataFrame:
    """Next-event forecasts after silences of some multiples of the median: expected misses, chance of none, and quantiles of the minutes left.

    Paths are drawn once for all ages of a decision, from the same random numbers for every decision.
    """

    def answer(key, ids, x, branch, at):
        many, out = batch.widened(x, at), []
        middle = many.ppf([0.5])[:, 0]
        draws = batch.Draws(sims, int(max(ages)) + 6)
        for k in np.flatnonzero(many.known):
            for a, (missed, none, q) in zip(ages, draws.renewals(many, k, [a * middle[k] for a in ages], p_seen)):
                out.append((key, ids[at[k]], a, missed, none, *q))
        return pd.DataFrame(out, columns=["key", "id", "ages", "missed", "p_current", "lo90", "median", "hi90"])

    return by_piece(iv, answer, "key string, id long, ages double, missed double, p_current double, lo90 double, median double, hi90 double", least=WARM, piece=500)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def crps_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(_gaps(spark, sf_dir))
    inside = lambda a, b: F.avg(F.col("x").between(F.col(a), F.col(b)).cast("double"))
    mean = lambda c: F.round(c + 1e-9, 5)  # noqa: E731  shares may lie halfway between two roundings
    crps, mae = mean(F.avg("crps")).alias("crps"), mean(F.avg(F.abs(F.col("x") - F.col("median")))).alias("mae")
    return p.groupBy("key", "model").agg(F.count(F.lit(1)).alias("n"), crps, mae, mean(inside("lo50", "hi50")).alias("cover50"), mean(inside("lo90", "hi90")).alias("cover90"))


def pit_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of decisions whose pit is at most each of 101 levels, by model: pits are counted by level, and the counts added up."""
    p = predictions(_gaps(spark, sf_dir))
    counts = p.groupBy("model", F.ceil(F.col("pit") * 100).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("model").agg(F.collect_list(F.struct("k", "n")).alias("held"), F.sum("n").alias("total"))  # at most 101 for a model
    upto = F.expr("aggregate(filter(held, c -> c.k <= level), 0L, (s, c) -> s + c.n)")
    return held.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(100)))).select("model", (F.col("level") / 100).alias("level"), F.round(upto / F.col("total") + 1e-9, 6).alias("share"))


def renewal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renewals(_gaps(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (crps_by_model, pit_reliability, renewal_forecast)}


# ---- the same in SQL, from the fits of models.py


def _cdf(t: str) -> str:
    """SQL of F(t) of a row of `fits`; z1 and z2 are columns made from it."""
    return f"CASE WHEN wb THEN 1e0 - exp(-pow({t} / b, a)) WHEN w > 0 THEN (1 - w) * ({phi('z1')}) + w * ({phi('z2')}) ELSE {phi('z1')} END"


def _oracle() -> str:
    """CTEs up to `fits`: model, key, id, x, whether Weibull, a, b, and a second lognormal's deviation and weight, of every decision."""
    raw = {name: sql.replace(", 4)", ", 15)") for name, sql in models.oracle_sql().items()}
    one = lambda model, name, wb, a, b, tail="0e0", w="0e0": f"SELECT '{model}' model, key, id, {wb} wb, {a} a, {b} b, coalesce({tail}, 0e0) b2, {w} w FROM ({raw[name]})"
    near = "WINDOW v AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
    each = [
        f"SELECT 'lognormal' model, key, id, false wb, m a, greatest(s, 1e-6) b, 0e0 b2, 0e0 w FROM (SELECT key, id, avg(ln(x)) OVER v m, stddev_samp(ln(x)) OVER v s, count(*) OVER v n FROM iv {near}) WHERE n >= 12",
        one("weibull", "weibull_intervals", "true", "shape", "scale"),
        one("best_parametric", "parametric_choice", "family = 'weibull'", "a", "b"),
        one("adaptive_lognormal", "adaptive_fits", "false", "mean", "sd"),
        one("tail_mixture", "tail_mixtures", "false", "mean", "sd", "tail_sd", "weight"),
    ]
    return f"""@CHAIN@, decisions AS (SELECT key, id, x FROM (SELECT key, id, x, row_number() OVER (PARTITION BY key ORDER BY epoch, id) rn FROM iv) WHERE rn > {WARM}),
  fits AS (SELECT f.*, x FROM ({' UNION ALL '.join(each)}) f JOIN decisions USING (key, id))"""


def _crps_sql() -> str:
    # a mixture's quantiles lie as far below its median as above: halving between the two parts' own
    half = f"SELECT model, key, id, b, b2, w, q, CASE WHEN up < q THEN z ELSE lo END, CASE WHEN up < q THEN hi ELSE z END, k + 1 FROM (SELECT *, (1 - w) * ({phi('z1')}) + w * ({phi('z2')}) up FROM (SELECT *, (lo + hi) / 2 z, (lo + hi) / 2 / b z1, (lo + hi) / 2 / b2 z2 FROM halved WHERE k < 48))"
    return f"""{_oracle()},
  halved AS (SELECT model, key, id, b, b2, w, q, least(n * b, n * b2) lo, greatest(n * b, n * b2) hi, 0 k FROM fits, (VALUES (0.75e0, 0.674489750196082e0), (0.95e0, 1.644853626951473e0), (0.9995e0, 3.290526731491926e0)) v(q, n) WHERE w > 0 UNION ALL {half}),
  mixed AS (SELECT model, key, id, max(CASE WHEN q < 0.8e0 THEN (lo + hi) / 2 END) z50, max(CASE WHEN q > 0.9e0 AND q < 0.96e0 THEN (lo + hi) / 2 END) z90, max(CASE WHEN q > 0.99e0 THEN (lo + hi) / 2 END) z99 FROM halved WHERE k = 48 GROUP BY model, key, id),
  cut AS (SELECT f.*, coalesce(z50, 0.674489750196082e0 * b) z50, coalesce(z90, 1.644853626951473e0 * b) z90, coalesce(z99, 3.290526731491926e0 * b) z99 FROM fits f LEFT JOIN mixed USING (model, key, id)),
  edges AS (SELECT *, {', '.join(f"CASE WHEN wb THEN b * pow(-ln(1 - {q}e0), 1 / a) ELSE exp(a {s} {z}) END {c}" for c, q, s, z in (('lo99', 0.0005, '-', 'z99'), ('lo90', 0.05, '-', 'z90'), ('lo50', 0.25, '-', 'z50'), ('mid', 0.5, '+', '0e0'), ('hi50', 0.75, '+', 'z50'), ('hi90', 0.95, '+', 'z90'), ('hi99', 0.9995, '+', 'z99')))} FROM cut),
  spans AS (SELECT *, least(lo99, x) - 1e-9 l, (greatest(hi99, x) - least(lo99, x) + 2e-9) / 511 step FROM edges),
  grid AS (SELECT *, l + step * k t FROM spans, range(512) r(k)), points AS (SELECT *, (ln(t) - a) / b z1, CASE WHEN w > 0 THEN (ln(t) - a) / b2 ELSE 0e0 END z2 FROM grid),
  heights AS (SELECT model, key, id, step, k, {_cdf('t')} - CASE WHEN t >= x THEN 1e0 ELSE 0e0 END d FROM points),
  scored AS (SELECT model, key, id, sum(step * d * d * CASE WHEN k IN (0, 511) THEN 0.5e0 ELSE 1e0 END) crps FROM heights GROUP BY model, key, id)
  SELECT key, model, count(*) n, round(avg(crps) + 1e-9, 5) crps, round(avg(abs(x - mid)) + 1e-9, 5) mae, round(avg(CASE WHEN x BETWEEN lo50 AND hi50 THEN 1e0 ELSE 0e0 END) + 1e-9, 5) cover50,
    round(avg(CASE WHEN x BETWEEN lo90 AND hi90 THEN 1e0 ELSE 0e0 END) + 1e-9, 5) cover90 FROM scored JOIN edges USING (model, key, id) GROUP BY key, model"""


def oracle_sql() -> dict[str, str]:
    pits = f"""{_oracle()}, points AS (SELECT *, (ln(x) - a) / b z1, CASE WHEN w > 0 THEN (ln(x) - a) / b2 ELSE 0e0 END z2 FROM fits), pits AS (SELECT model, {_cdf('x')} pit FROM points)
  SELECT model, level / 100e0 AS level, round(avg(CASE WHEN pit <= level / 100e0 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS share FROM pits, range(101) r(level) GROUP BY model, level"""
    return {"pit_reliability": catalog.filled(pits, catalog._DUCK), "crps_by_model": models.recursive(catalog.filled(_crps_sql(), catalog._DUCK))}
