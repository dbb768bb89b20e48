"""The models' fits for every gap of every series, each from the gaps strictly before it, as tables.

Series are cut into pieces with the HISTORY gaps before them, and the gaps of a piece are fitted together (functions/batch.py), so work
spreads over pieces rather than series and no task holds a whole one.  Gaps with too little history before them have no row.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.functions import batch
from recurra.plans import catalog

from .intervals import gaps
from .pieces import numbered, reached

HISTORY, PIECE = 2000, 1000
LEVELS = {"lo90": 0.05, "lo50": 0.25, "median": 0.5, "hi50": 0.75, "hi90": 0.95}


def by_piece(iv: DataFrame, answer, fields: str, branch: str = "false", least: int = 0, piece: int = PIECE) -> DataFrame:
    """The rows of answer(key, id, x, branch, at) for every piece: arrays of the piece's gaps and those before them; at: the places of its own.

    branch: SQL over the gaps, what each began with; least: gaps of a series that only teach.
    """
    rows = numbered(iv.withColumn("branch", F.expr(f"coalesce({branch}, false)")), "key").select("key", "id", "x", "branch", "rn", reached("rn", piece, HISTORY).alias("piece"))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        at = np.flatnonzero((p["rn"] // piece == p["piece"]) & (p["rn"] >= least))
        if not len(at):
            return pd.DataFrame(columns=names)
        return answer(p["key"].iloc[0], p["id"].to_numpy(), p["x"].to_numpy(float), p["branch"].to_numpy(bool), at)[names]

    tasks = 4 * iv.sparkSession.sparkContext.defaultParallelism  # given, as the rows are few and the work on each is much
    return rows.repartition(tasks, "key", "piece").groupBy("key", "piece").applyInPandas(run, fields)


def _rows(key, ids, at, known, **columns) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "id": ids[at]} | columns)[known]


def _weibull(key, ids, x, branch, at):
    m = batch.weibull(x, at)
    q = m.ppf([*LEVELS.values()])
    return _rows(key, ids, at, m.known, x=x[at], shape=m.a, scale=m.b, **{c: q[:, k] for k, c in enumerate(LEVELS)})


def _choice(key, ids, x, branch, at):
    m = batch.best_parametric(x, at)
    return _rows(key, ids, at, m.known, family=np.where(m.weibull, "weibull", "lognormal"), a=m.a, b=m.b)


def _changes(key, ids, x, branch, at):
    return _rows(key, ids, at, np.minimum(at, 800) >= 80, held=np.minimum(at, 800), begins=batch.last_changepoint(x, at))


def _adaptive(key, ids, x, branch, at):
    m, stretch, used = batch.adaptive_lognormal(x, at)
    return _rows(key, ids, at, m.known, stretch=stretch, used=used, mean=m.a, sd=m.b)


def _modes(key, ids, x, branch, at):
    m = batch.series_modes(x, branch, at)
    return _rows(key, ids, at, np.isfinite(m["mean"]), **m)


def _tails(key, ids, x, branch, at):
    m = batch.widened(x, at)
    return _rows(key, ids, at, m.known, mean=m.a, sd=m.b, tail_sd=np.where(m.w > 0, m.b2, np.nan), weight=m.w)


#: query -> (fits, its columns after key and id, what began a gap)
FITS = {
    "weibull_intervals": (_weibull, "x double, shape double, scale double, lo90 double, lo50 double, median double, hi50 double, hi90 double", "false"),
    "parametric_choice": (_choice, "family string, a double, b double", "false"),
    "changepoints": (_changes, "held long, begins long", "false"),
    "adaptive_fits": (_adaptive, "stretch long, used long, mean double, sd double", "false"),
    "series_modes": (_modes, ", ".join(f"{c} double" for c in ("split", "short_mean", "short_sd", "long_mean", "long_sd", "share", "share_all", "mean", "sd")), "prev_initial"),
    "tail_mixtures": (_tails, "mean double, sd double, tail_sd double, weight double", "false"),
}


def fits(iv: DataFrame, name: str, piece: int = PIECE) -> DataFrame:
    """key, id and what the model `name` of FITS gives for every gap."""
    answer, fields, branch = FITS[name]
    return by_piece(iv, answer, f"key string, id long, {fields}", branch, piece=piece)


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fits(gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet")), name)
        return out.select(*[F.round(F.nanvl(c, F.lit(None).cast("double")), 4).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])

    return run


# ---- the same in SQL: windows as lists, Newton's method as a recursion

_LISTS = "@CHAIN@, g AS (SELECT key, id, x, coalesce(prev_initial, false) br, row_number() OVER (PARTITION BY key ORDER BY epoch, id) - 1 rn FROM iv), h AS (SELECT *, list({what}) OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) h FROM g)"
#: Of rows w (key, id, tag, h): shape and scale of each list h.
_NEWTON = """y AS (SELECT key, id, tag, list_avg(h) m, list_transform(h, lambda v: ln(v / list_avg(h))) y FROM w WHERE len(h) >= 12 AND list_max(h) > list_min(h)),
  newton AS (SELECT key, id, tag, y, list_avg(y) mid, 1.2e0 / greatest(list_stddev_pop(y), 1e-3) c, 0 k FROM y
    UNION ALL SELECT key, id, tag, y, mid, greatest(c - (s1 / s0 - 1 / c - mid) / (s2 / s0 - (s1 / s0) * (s1 / s0) + 1 / (c * c)), c / 4), k + 1
    FROM (SELECT *, list_sum(list_transform(y, lambda v: exp(c * v))) s0, list_sum(list_transform(y, lambda v: v * exp(c * v))) s1, list_sum(list_transform(y, lambda v: v * v * exp(c * v))) s2 FROM newton WHERE k < 14)),
  wb AS (SELECT n.key, n.id, n.tag, c shape, m * pow(list_avg(list_transform(n.y, lambda v: exp(c * v))), 1 / c) scale FROM newton n JOIN y ON n.key = y.key AND n.id = y.id AND n.tag = y.tag WHERE k = 14)"""


def recursive(text: str) -> str:
    return text.replace("WITH ev", "WITH RECURSIVE ev", 1)


_SQL = {
    "weibull_intervals": _LISTS.format(what="x", window=100)
    + f", w AS (SELECT key, id, 0 tag, h FROM h), {_NEWTON} SELECT key, id, round(x, 4) x, round(shape, 4) shape, round(scale, 4) scale, "
    + ", ".join(f"round(scale * pow(-ln(1 - {q}e0), 1 / shape), 4) {c}" for c, q in LEVELS.items())
    + " FROM wb JOIN g USING (key, id)",
    "parametric_choice": _LISTS.format(what="x", window=150)
    + f""", e AS (SELECT key, id, h, cast(floor(0.75e0 * len(h)) AS int) cut FROM h WHERE len(h) >= 24), w AS (SELECT key, id, 0 tag, h[1:cut] h FROM e UNION ALL SELECT key, id, 1, h FROM e), {_NEWTON},
  l AS (SELECT key, id, h, cut, list_transform(h, lambda v: ln(v)) y FROM e), b AS (SELECT *, list_avg(y[1:cut]) m, list_stddev_samp(y[1:cut]) s FROM l),
  v AS (SELECT b.key, b.id, y, list_sum(list_transform(y[cut + 1:], lambda v: -0.5e0 * ((v - m) / s) * ((v - m) / s) - ln(s * sqrt(2 * pi())) - v)) bell,
    list_sum(list_transform(h[cut + 1:], lambda v: ln(shape / scale) + (shape - 1) * ln(v / scale) - pow(v / scale, shape))) other FROM b LEFT JOIN wb ON b.key = wb.key AND b.id = wb.id AND tag = 0)
  SELECT v.key, v.id, CASE WHEN other > bell THEN 'weibull' ELSE 'lognormal' END AS family, round(CASE WHEN other > bell THEN shape ELSE list_avg(y) END, 4) a, round(CASE WHEN other > bell THEN scale ELSE list_stddev_samp(y) END, 4) b
  FROM v LEFT JOIN wb ON v.key = wb.key AND v.id = wb.id AND tag = 1""",
    "tail_mixtures": """@CHAIN@, s AS (SELECT key, id, count(*) OVER far n, avg(ln(x)) OVER near m, stddev_samp(ln(x)) OVER near s, stddev_samp(ln(x)) OVER far t FROM iv
  WINDOW near AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), far AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING))
  SELECT key, id, round(m, 4) mean, round(s, 4) sd, CASE WHEN n >= 300 THEN round(greatest(t, 2 * s, 0.2e0), 4) END tail_sd, CASE WHEN n >= 300 THEN 0.15e0 ELSE 0e0 END weight FROM s WHERE n >= 12""",
    "series_modes": _LISTS.format(what="{'x': x, 'br': br}", window=600)
    + """, o AS (SELECT key, id, br, h, list_sort(list_transform(h, lambda v: v.x)) o, len(h) n FROM h WHERE len(h) >= 80),
  q AS (SELECT *, quantile_cont_25 lo, quantile_cont_75 hi FROM (SELECT *, o[cast(floor(0.25e0 * (n - 1)) AS int) + 1] + (0.25e0 * (n - 1) - floor(0.25e0 * (n - 1))) * (o[least(cast(floor(0.25e0 * (n - 1)) AS int) + 2, n)] - o[cast(floor(0.25e0 * (n - 1)) AS int) + 1]) quantile_cont_25,
    o[cast(floor(0.75e0 * (n - 1)) AS int) + 1] + (0.75e0 * (n - 1) - floor(0.75e0 * (n - 1))) * (o[least(cast(floor(0.75e0 * (n - 1)) AS int) + 2, n)] - o[cast(floor(0.75e0 * (n - 1)) AS int) + 1]) quantile_cont_75 FROM o)),
  p AS (SELECT *, sqrt(lo * hi) cut, list_transform(list_filter(h, lambda v: v.x < sqrt(lo * hi)), lambda v: ln(v.x)) short, list_transform(list_filter(h, lambda v: v.x >= sqrt(lo * hi)), lambda v: ln(v.x)) long,
    list_filter(h, lambda v: v.br = br) same, list_transform(h, lambda v: ln(v.x)) every FROM q),
  t AS (SELECT *, hi >= 3.5e0 * lo AND least(len(short), len(long)) >= 25 two, len(long) / (n * 1e0) sall, CASE WHEN len(same) >= 25 THEN len(list_filter(same, lambda v: v.x >= cut)) / (len(same) * 1e0) ELSE len(long) / (n * 1e0) END sown FROM p)
  SELECT key, id, CASE WHEN two THEN round(cut, 4) END split, CASE WHEN two THEN round(list_avg(short), 4) END short_mean, CASE WHEN two THEN round(list_stddev_samp(short), 4) END short_sd, CASE WHEN two THEN round(list_avg(long), 4) END long_mean,
    CASE WHEN two THEN round(list_stddev_samp(long), 4) END long_sd, CASE WHEN two THEN round(least(greatest(sown, 0.05e0), 0.95e0), 4) END AS share, CASE WHEN two THEN round(least(greatest(sall, 0.05e0), 0.95e0), 4) END share_all,
    round(list_avg(every), 4) mean, round(list_stddev_samp(every), 4) sd FROM t""",
}
#: Running sums of centred gaps, and for each gap the split of the 800 before it that lowers the squares most.
_CHANGE = """@CHAIN@, g AS (SELECT key, id, x, x - avg(x) OVER (PARTITION BY key) c, row_number() OVER (PARTITION BY key ORDER BY epoch, id) - 1 rn FROM iv),
  s AS (SELECT key, rn + 1 j, sum(c) OVER w s, sum(c * c) OVER w q FROM g WINDOW w AS (PARTITION BY key ORDER BY rn) UNION ALL SELECT DISTINCT key, 0, 0e0, 0e0 FROM g),
  d AS (SELECT key, id, rn, least(rn, 800) n FROM g), cand AS (SELECT *, unnest(range(greatest(40, n - 600), n - 40)) k FROM d WHERE n >= 80),
  e AS (SELECT c.key, c.id, c.n, k, (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / k + (z.q - b.q) - (z.s - b.s) * (z.s - b.s) / (n - k) apart, (z.q - a.q) - (z.s - a.s) * (z.s - a.s) / n total
    FROM cand c JOIN s a ON a.key = c.key AND a.j = rn - n JOIN s b ON b.key = c.key AND b.j = rn - n + k JOIN s z ON z.key = c.key AND z.j = rn),
  best AS (SELECT key, id, any_value(n) n, any_value(total) total, min({'w': apart, 'k': k}) m FROM e GROUP BY key, id),
  changes AS (SELECT key, id, n, CASE WHEN total - m.w >= 8e0 * total / n * ln(n) THEN m.k ELSE 0 END begins FROM best)"""
_SQL["changepoints"] = _CHANGE + " SELECT d.key, d.id, d.n held, cast(coalesce(begins, 0) AS bigint) begins FROM d LEFT JOIN changes USING (key, id) WHERE d.n >= 80"
_SQL["adaptive_fits"] = (
    _CHANGE
    + """, h AS (SELECT key, id, list(ln(x)) OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN 800 PRECEDING AND 1 PRECEDING) h FROM g),
  r AS (SELECT h.key, h.id, CASE WHEN len(h) - coalesce(begins, 0) >= 40 THEN h[coalesce(begins, 0) + 1:] ELSE h END r FROM h LEFT JOIN changes c ON c.key = h.key AND c.id = h.id WHERE len(h) >= 60),
  p AS (SELECT key, id, len(r) n, r[len(r) - 24:] held, w, r[greatest(len(r) - 25 - w, 0) + 1:len(r) - 25] past FROM r, (VALUES (25), (50), (100), (200)) t(w)),
  l AS (SELECT *, list_avg(past) m, list_stddev_samp(past) s FROM p WHERE len(past) >= 12), f AS (SELECT key, id, w, list_sum(list_transform(held, lambda v: -0.5e0 * ((v - m) / s) * ((v - m) / s) - ln(s * sqrt(2 * pi())) - v)) gain FROM l),
  b AS (SELECT key, id, max({'g': round(gain, 9), 'w': -w}) b FROM f GROUP BY key, id), u AS (SELECT r.key, r.id, r, least(coalesce(-b.b.w, 200), len(r)) used FROM r LEFT JOIN b ON b.key = r.key AND b.id = r.id)
  SELECT key, id, len(r) stretch, cast(used AS bigint) used, round(list_avg(r[len(r) - used + 1:]), 4) mean, round(list_stddev_samp(r[len(r) - used + 1:]), 4) sd FROM u"""
)


def queries() -> dict:
    return {name: _query(name) for name in FITS}


def oracle_sql() -> dict[str, str]:
    return {name: recursive(catalog.filled(text, catalog._DUCK)) if "newton" in text else catalog.filled(text, catalog._DUCK) for name, text in _SQL.items()}
