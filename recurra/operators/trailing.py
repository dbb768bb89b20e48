"""Normal and lognormal fits of the gaps strictly before each gap, over trailing windows, in pieces of a series.

The conditional models fit the gaps of the window that began as this one did, or all of them where there are too few.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.plans import catalog

from .intervals import gaps
from .pieces import numbered, reached

Z = {"lo90": -1.644853626951473, "lo50": -0.674489750196082, "median": 0.0, "hi50": 0.674489750196082, "hi90": 1.644853626951473}


def _stats(y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, standard deviation (of samples) and number of what is used in each row."""
    n = use.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(use, y, 0).sum(axis=1) / n
        return mean, np.sqrt((np.where(use, y - mean[:, None], 0) ** 2).sum(axis=1) / (n - 1)), n


def fits(x: np.ndarray, kind: np.ndarray, window: int, least: int, least_branch: int, log: bool, least_kinds: int = 0, step: int = 2048):
    """Mean and deviation for each of x from the window before it; nan where there are too few.

    kind: how each gap began (1, 0, or -1: not known, which is fitted from all); least_kinds: gaps of a known kind that a branch needs.
    """
    y = np.log(x) if log else x
    pad = lambda v, z: np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(window, z), v[:-1])), window) if len(v) else np.zeros((0, window))
    past, kinds = pad(y, np.nan), pad(kind.astype(float), np.nan)
    mean, sd = np.full(len(x), np.nan), np.full(len(x), np.nan)
    for at in range(0, len(x), step):
        s = slice(at, at + step)
        there = ~np.isnan(past[s])
        m, d, n = _stats(past[s], there)
        own = kinds[s] == kind[s][:, None]
        bm, bd, bn = _stats(past[s], own)
        branch = (kind[s] >= 0) & (bn >= least_branch) & ((kinds[s] >= 0).sum(axis=1) >= least_kinds)
        ok = n >= least
        mean[s], sd[s] = np.where(ok, np.where(branch, bm, m), np.nan), np.where(ok, np.where(branch, bd, d), np.nan)
    return mean, sd


#: window, least, least of a branch, logarithms, what began a gap (SQL over the gaps), least of known kinds
MODELS = {
    "rolling_normal_intervals": (30, 8, 1 << 30, False, "-1", 0),
    "lognormal_intervals": (100, 12, 1 << 30, True, "-1", 0),
    "minor_conditional_intervals": (400, 60, 25, True, "int(coalesce(prev_minor, false))", 0),
    "entry_conditional_intervals": (400, 60, 25, True, "int(coalesce(prev_electronic, false))", 0),
    "duration_split_intervals": (400, 24, 12, True, "CASE WHEN prev_dur > 0 THEN int(prev_dur >= 150) ELSE -1 END", 24),
}


def intervals_of(iv: DataFrame, model: str, piece: int = 20_000) -> DataFrame:
    """key, id, x and the model's 50 and 90 % intervals and median for every gap that has history enough."""
    window, least, least_branch, log, kind, kinds = MODELS[model]
    rows = numbered(iv.withColumn("kind", F.expr(kind)), "key").select("key", "id", "x", "kind", "rn", reached("rn", piece, window).alias("piece"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        x = p["x"].to_numpy(float)
        mean, sd = fits(x, p["kind"].to_numpy(), window, least, least_branch, log, kinds)
        own = (p["rn"] // piece == p["piece"]).to_numpy() & ~np.isnan(sd)
        at = lambda z: mean + z * np.maximum(sd, 1e-3)
        return pd.DataFrame({"key": p["key"], "id": p["id"], "x": x} | {c: np.exp(at(z)) if log else at(z) for c, z in Z.items()})[own]

    out = rows.groupBy("key", "piece").applyInPandas(run, "key string, id long, x double, " + ", ".join(f"{c} double" for c in Z))
    return out.select("key", "id", *[F.round(c, 6).alias(c) for c in ("x", *Z)])


def _oracle(window: int, least: int, least_branch: int, log: bool, kind: str, kinds: int) -> str:
    """The same over frames of SQL."""
    kind = kind.replace("int(", "(").replace("ELSE -1", "ELSE NULL").replace("-1", "NULL::boolean")
    part = lambda f, c: f"{f}(CASE WHEN {c} THEN y END) OVER w"
    q = ", ".join(f"round({'exp(' if log else ''}mean + {z}e0 * greatest(sd, 1e-3){')' if log else ''}, 6) {c}" for c, z in Z.items())
    return f"""@CHAIN@, g AS (SELECT key, id, epoch, x, {'ln(x)' if log else 'x'} y, {kind} k FROM iv),
  s AS (SELECT key, id, x, k, {part('avg', 'k')} m1, {part('stddev_samp', 'k')} s1, {part('count', 'k')} n1, {part('avg', 'NOT k')} m0, {part('stddev_samp', 'NOT k')} s0, {part('count', 'NOT k')} n0, avg(y) OVER w ma, stddev_samp(y) OVER w sa, count(*) OVER w na
    FROM g WINDOW w AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)),
  f AS (SELECT key, id, x, na, CASE WHEN k AND n1 >= {least_branch} AND n0 + n1 >= {kinds} THEN m1 WHEN NOT k AND n0 >= {least_branch} AND n0 + n1 >= {kinds} THEN m0 ELSE ma END mean,
    CASE WHEN k AND n1 >= {least_branch} AND n0 + n1 >= {kinds} THEN s1 WHEN NOT k AND n0 >= {least_branch} AND n0 + n1 >= {kinds} THEN s0 ELSE sa END sd FROM s)
  SELECT key, id, round(x, 6) x, {q} FROM f WHERE na >= {least} AND sd IS NOT NULL"""


def queries() -> dict:
    def run(model):
        return lambda spark, sf_dir: intervals_of(gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet")), model)

    return {m: run(m) for m in MODELS}


def oracle_sql() -> dict[str, str]:
    return {m: catalog.filled(_oracle(*spec), catalog._DUCK) for m, spec in MODELS.items()}
