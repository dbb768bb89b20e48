"""Which model serves which series, and the walk-forward backtest of all of them.

A model is a function of the history before a gap and of what is known when the gap begins: fit(history, row) gives a
distribution or None.  `register` adds one of your own to every series, or to some.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import batch, dist

from .intervals import gaps, labels
from .pieces import kept, numbered

HISTORY = 2000
#: What is known of a gap when it begins.
KNOWN = ("prev_x", "prev_dur", "prev_minor", "prev_electronic", "prev_initial", "prev_hour", "prev_day")


@dataclass(frozen=True)
class Series:
    """What is special about some series (of the tables at hand by default)."""

    minor: frozenset = frozenset({"purchase", "signup"})  # a second, smaller kind of event
    series: frozenset = frozenset({"click"})  # events come in series
    electronic: frozenset = frozenset({"purchase", "click"})  # many events are logged by instruments
    durations: frozenset = frozenset({"purchase"})
    best: dict = field(default_factory=lambda: {"purchase": "minor_conditional", "signup": "minor_conditional", "click": "series_conditional", "view": "adaptive_lognormal"})
    phase_cycles: dict = field(default_factory=lambda: {"view": 2.5})  # series whose phase is lost after so many cycles
    context: frozenset = frozenset({"error"})  # series that are shown but not forecast


SERIES = Series()


def _columns(history: pd.DataFrame) -> np.ndarray:
    return dist.design(history["prev_x"], history["prev_hour"], history["prev_day"], history[["prev_minor", "prev_electronic", "prev_initial"]].to_numpy(float))


def _normal(h, row):
    x = h["x"].to_numpy()[-30:]
    return dist.Dist("normal", float(x.mean()), max(float(x.std(ddof=1)), 1e-3)) if len(x) >= 8 else None


def _duration(h, row):
    h = h.iloc[-400:]
    if len(h) < 24:
        return None
    x, d = h["x"].to_numpy(), h["prev_dur"].to_numpy(float)
    known = np.isfinite(d) & (d > 0)
    if not (row["prev_dur"] and np.isfinite(row["prev_dur"]) and row["prev_dur"] > 0) or known.sum() < 24:
        return dist.lognormal(x)
    own = x[known & ((d < 150) == (row["prev_dur"] < 150))]
    return dist.lognormal(own) or dist.lognormal(x)


def _by(flag):
    return lambda h, row: dist.conditional(h["x"].to_numpy(), h[flag].to_numpy(bool), bool(row[flag]))


class _Covariates:
    """One regression for a stretch of forecasts, fitted again as its rule says."""

    def __init__(self):
        self.model = dist.Regression()

    def __call__(self, h, row):
        h = h.iloc[-self.model.window :]
        return self.model.predict(h["x"].to_numpy(), _columns(h), _columns(pd.DataFrame([row]))[0])


#: name -> (makes a model; the series it is for, None: all)
MODELS: dict[str, tuple[Callable, Callable[[Series, str], bool] | None]] = {
    "rolling_normal": (lambda: _normal, None),
    "lognormal": (lambda: lambda h, row: dist.lognormal(h["x"].to_numpy()[-100:]), None),
    "weibull": (lambda: lambda h, row: dist.weibull(h["x"].to_numpy()[-100:]), None),
    "best_parametric": (lambda: lambda h, row: dist.best_parametric(h["x"].to_numpy()), None),
    "adaptive_lognormal": (lambda: lambda h, row: dist.adaptive_lognormal(h["x"].to_numpy()), None),
    "weibull_aft": (_Covariates, None),
    "duration_lognormal": (lambda: _duration, lambda s, key: key in s.durations),
    "minor_conditional": (lambda: _by("prev_minor"), lambda s, key: key in s.minor),
    "series_conditional": (lambda: lambda h, row: dist.series_conditional(h["x"].to_numpy(), h["prev_initial"].to_numpy(bool), bool(row["prev_initial"])), lambda s, key: key in s.series),
    "entry_conditional": (lambda: _by("prev_electronic"), lambda s, key: key in s.electronic),
}


def _flag(p: pd.DataFrame, name: str) -> np.ndarray:
    return p[name].map(bool).to_numpy(bool).astype(np.int64)


def _durations(p: pd.DataFrame) -> np.ndarray:
    d = p["prev_dur"].to_numpy(float)
    return np.where(np.isfinite(d) & (d > 0), (d < 150).astype(np.int64), -1)


def _covariates(p: pd.DataFrame, at: np.ndarray) -> batch.Many:
    model, x, z = dist.Regression(), p["x"].to_numpy(float), _columns(p)
    fits = [model.predict(x[max(0, k - model.window) : k], z[max(0, k - model.window) : k], z[k]) for k in at.tolist()]
    return batch.Many([d.a if d else np.nan for d in fits], [d.b if d else np.nan for d in fits], np.ones(len(at), bool))


#: The models above for many gaps at once: of a piece's gaps (with what is known of them) and the places to be forecast.
TOGETHER: dict[str, tuple[Callable, Callable]] = {
    name: (MODELS[name][0], f)
    for name, f in {
        "rolling_normal": lambda p, at: batch.normal(p["x"].to_numpy(float), at),
        "lognormal": lambda p, at: batch.lognormal(p["x"].to_numpy(float), at),
        "weibull": lambda p, at: batch.weibull(p["x"].to_numpy(float), at),
        "best_parametric": lambda p, at: batch.best_parametric(p["x"].to_numpy(float), at),
        "adaptive_lognormal": lambda p, at: batch.adaptive_lognormal(p["x"].to_numpy(float), at)[0],
        "weibull_aft": _covariates,
        "duration_lognormal": lambda p, at: batch.branched(p["x"].to_numpy(float), _durations(p), at, least=24, least_branch=12, least_known=24),
        "minor_conditional": lambda p, at: batch.branched(p["x"].to_numpy(float), _flag(p, "prev_minor"), at),
        "entry_conditional": lambda p, at: batch.branched(p["x"].to_numpy(float), _flag(p, "prev_electronic"), at),
        "series_conditional": lambda p, at: batch.series_conditional(p["x"].to_numpy(float), _flag(p, "prev_initial"), at),
    }.items()
}


def register(name: str, make: Callable, only: Callable[[Series, str], bool] | None = None) -> None:
    """Add a model: make() gives fit(history, row); only(series, key) says whom it is for.  Tasks get the models there are when a query is built."""
    MODELS[name] = make, only


def models_for(key: str, series: Series = SERIES) -> list[str]:
    return [name for name, (_, only) in MODELS.items() if only is None or only(series, key)]


def default_for(key: str, series: Series = SERIES) -> str:
    return series.best.get(key, "best_parametric")


def valid_gaps(iv: DataFrame) -> DataFrame:
    """The genuine gaps with what was known when they began, numbered (rn) in their series."""
    judged = labels(iv).where("is_valid").select("key", "id", "prev_x")
    return numbered(iv.join(judged, ["key", "id"]), "key")


def _evaluated(n: int, start: int, most: int) -> np.ndarray:
    """Which gaps from `start` on are forecast: all, or `most` of them at even distances."""
    return np.arange(start, n) if n - start <= most else np.unique(np.linspace(start, n - 1, most).astype(int))


def walk_forward(iv: DataFrame, days: int, now: int, least: int = 300, most: int = 2000, series: Series = SERIES, refit: int = 250) -> DataFrame:
    """model, key, idx, x, median, the 50 and 90 % intervals, crps and pit of every forecast of the last `days`.

    The first `least` genuine gaps of a series only teach; where the days hold under ten, the last 2,000 are forecast.  Above `most`,
    which is a rule of this backtest, forecasts are made at even distances.  Each task makes `refit` forecasts of a series, which is as
    long as a regression is kept, and gets the history they need.
    """
    rows = kept(valid_gaps(iv))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("epoch") < now - days * 86400).alias("old"))

    @F.udf("array<struct<piece: int, first: bigint, last: bigint, n: bigint, start: bigint>>")
    def cut(n, old):  # a row for each series
        if n < least + 50:
            return []
        start = max(old, least)
        start = max(least, n - 2000) if start >= n - 10 else start
        at = _evaluated(n, start, most)
        return [(k // refit, int(at[k]), int(at[min(k + refit, len(at)) - 1]), n, start) for k in range(0, len(at), refit)]

    pieces = sizes.select("key", F.explode(cut("n", "old")).alias("p")).select("key", "p.*").withColumn("span", F.explode(F.sequence(F.greatest(F.floor((F.col("first") - HISTORY) / HISTORY), F.lit(0)), F.floor(F.col("last") / HISTORY))))
    held = rows.withColumn("span", F.floor(F.col("rn") / HISTORY)).join(pieces, ["key", "span"]).where(F.col("rn").between(F.col("first") - HISTORY, F.col("last")))
    models = dict(MODELS)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn").reset_index(drop=True)
        key, first = p["key"].iloc[0], int(p["rn"].iloc[0])
        at = _evaluated(int(p["n"].iloc[0]), int(p["start"].iloc[0]), most)
        at = at[(at >= p["first"].iloc[0]) & (at <= p["last"].iloc[0])]
        out, x = [], p["x"].to_numpy(float)
        for name, (make, only) in models.items():
            if only is not None and not only(series, key):
                continue
            if name in TOGETHER and TOGETHER[name][0] is make:
                many = TOGETHER[name][1](p, at - first)
                own = np.flatnonzero(many.known)
                many, y = many.take(own), x[at[own] - first]
                rows = zip(at[own].tolist(), y, many.ppf([0.05, 0.25, 0.5, 0.75, 0.95]), batch.crps(many, y), many.cdf(y))
            else:
                rows = _one_by_one(make(), p, at, first)
            out += [(name, key, i, y, *map(float, q), float(score), float(pit)) for i, y, q, score, pit in rows if np.isfinite(score)]
        return pd.DataFrame(out, columns=FIELDS_NAMES)

    columns = ["key", "rn", "x", *KNOWN, "piece", "first", "last", "n", "start"]
    tasks = 4 * iv.sparkSession.sparkContext.defaultParallelism
    return held.select(*columns).repartition(tasks, "key", "piece").groupBy("key", "piece").applyInPandas(run, FIELDS)


def _one_by_one(fit: Callable, p: pd.DataFrame, at: np.ndarray, first: int):
    """Place, gap, quantiles, crps and pit of the forecasts of a model of one's own."""
    for i in at.tolist():
        k = i - first
        row = p.iloc[k]
        d = fit(p.iloc[max(0, k - HISTORY) : k], row)
        if d is not None:
            yield i, row["x"], d.ppf(np.array([0.05, 0.25, 0.5, 0.75, 0.95])), dist.crps(d, row["x"]), d.cdf(row["x"])


FIELDS = "model string, key string, idx long, x double, lo90 double, lo50 double, median double, hi50 double, hi90 double, crps double, pit double"
FIELDS_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def common(records: DataFrame, least: int = 50) -> DataFrame:
    """The records of the gaps that all models of their series have forecast; all records of a series where those are under `least`."""
    kinds = records.groupBy("key").agg(F.count_distinct("model").alias("models"))
    per = records.groupBy("key", "idx").agg(F.count(F.lit(1)).alias("m")).join(kinds, "key").withColumn("full", F.col("m") == F.col("models"))
    enough = per.groupBy("key").agg((F.count_if("full") >= least).alias("enough"))
    return records.join(per.join(enough, "key").where("full or not enough").select("key", "idx"), ["key", "idx"], "left_semi")


def scores(records: DataFrame) -> DataFrame:
    """key, model, n, crps, mae, cover50, cover90, mean_median, place by crps and gain over the rolling normal in percent; records: kept, as they are used three times."""
    inside = lambda a, b: F.avg(F.col("x").between(F.col(a), F.col(b)).cast("double"))
    each = common(records).groupBy("key", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps"), F.avg(F.abs(F.col("x") - F.col("median"))).alias("mae"), inside("lo50", "hi50").alias("cover50"), inside("lo90", "hi90").alias("cover90"), F.avg("median").alias("mean_median")
    )
    own = Window.partitionBy("key")  # a row for each model
    out = each.withColumn("place", F.row_number().over(own.orderBy("crps", "model"))).withColumn("base", F.max(F.when(F.col("model") == "rolling_normal", F.col("crps"))).over(own))
    return out.withColumn("gain_pct", F.when(F.col("base") > 0, 100 * (F.col("base") - F.col("crps")) / F.col("base"))).drop("base")


def backtest_records(spark: SparkSession, sf_dir: str, days: int = 20) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = events.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0] or 0
    return kept(walk_forward(gaps(spark, events), days, now))


def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(backtest_records(spark, sf_dir))


def thinned(rows: DataFrame, start: int, most: int) -> DataFrame:
    """Of numbered rows (rn from 0, by key) those from `start` on: all, or `most` of them at even distances, the first and the last among them."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > start)
    span = F.col("size") - 1 - start
    at = F.when(span < most, F.sequence(F.lit(start).cast("long"), F.col("size") - 1)).otherwise(F.expr(f"array_distinct(transform(sequence(0L, {most - 1}L), i -> {start} + (i * (size - 1 - {start})) div {most - 1}))"))
    return rows.join(sizes.select("key", F.explode(at).alias("rn")), ["key", "rn"])


def evaluated_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps that a backtest of 500 forecasts of each series makes, at even distances from the 300th gap on."""
    rows = numbered(gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet")).select("key", "id", "epoch", "x"), "key")
    return thinned(rows, 300, 500).select("key", "id", "rn", F.round("x", 6).alias("x"))


def validity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and p_seen: the share of a series' last 400 gaps that are genuine, as the chance that an event is seen."""
    iv = gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = numbered(labels(iv), "key")
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    last = rows.join(size, "key").where("rn >= size - 400").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_valid").cast("double")).alias("share"))
    return last.select("key", F.round(F.when(F.col("n") < 20, 0.9).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(0.995), "share"))), 6).alias("p_seen"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and epoch of the events that close a genuine gap: the only ones forecasts are scored against."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    valid = labels(gaps(spark, events)).where("is_valid").select("key", "epoch")
    from recurra.plans import catalog

    singles = spark.sql(catalog.filled("@CHAIN@ SELECT key, id, epoch FROM singles", catalog._SPARK), events=events)
    return singles.join(valid, ["key", "epoch"], "left_semi").select("key", "id", "epoch")


def queries() -> dict:
    return {f.__name__: f for f in (walk_forward_scores, evaluated_gaps, validity_share, scored_events)}


def oracle_sql() -> dict[str, str]:
    from recurra.plans import catalog

    from .intervals import ORACLE

    text = catalog.filled(ORACLE, catalog._DUCK)
    text = text[: text.index("  SELECT key, id, round(x, 6) x")] + ", v AS (SELECT key, id, epoch, x, coalesce(x BETWEEN 0.5e0 * med AND 1.75e0 * med, false) OR coalesce(ml >= 3.5e0 * med AND x BETWEEN 0.5e0 * ml AND 1.75e0 * ml, false) ok FROM l)"
    even = """@CHAIN@, g AS (SELECT key, id, x, row_number() OVER (PARTITION BY key ORDER BY epoch, id) - 1 rn, count(*) OVER (PARTITION BY key) n FROM iv),
      picked AS (SELECT DISTINCT key, 300 + (i * (n - 301)) // 499 rn FROM (SELECT DISTINCT key, n FROM g WHERE n - 301 >= 500), range(500) t(i))
      SELECT key, id, rn, round(x, 6) x FROM g WHERE rn >= 300 AND (n - 301 < 500 OR EXISTS (FROM picked p WHERE p.key = g.key AND p.rn = g.rn))"""
    return {
        "evaluated_gaps": catalog.filled(even, catalog._DUCK),
        "validity_share": text + ", newest AS (FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY epoch DESC, id DESC) <= 400) SELECT key, round(CASE WHEN count(*) < 20 THEN 0.9e0 ELSE greatest(0.3e0, least(0.995e0, avg(ok::int))) END, 6) p_seen FROM newest GROUP BY key",
        "scored_events": text + " SELECT key, id, epoch FROM v WHERE ok",
    }
