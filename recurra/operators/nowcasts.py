"""Nowcasts on a grid of times, with a neighbour whose events announce ours; their paired backtest; coverage over all gaps.

Everything known at a grid time comes from one as-of window over the union of a series' events, its neighbour's events and its grid.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import dist
from recurra.functions.sqlmath import phi
from recurra.plans import catalog

from . import intervals
from .pieces import carried, framed, kept, numbered

#: Reliability of an announcement, mean and sd of its lead in minutes, the longest wait for it.
RELIABLE, LEAD, LEAD_SD, WAIT = 0.94, 11.9, 4.8, 40.0
#: How long after an event precursors count, in minutes.
PRECURSOR_WINDOW = 90.0
#: Fixed values of a lattice: period where it is not known, its sd, the part of a cycle in which nothing begins, what weight is left there, and how old its last event may be (all in minutes).
PERIOD, PERIOD_SD, FORBIDDEN, RESIDUAL, FRESH = 19.0, 4.2, (4.5, 13.5), 0.05, 45.0
#: Which key announces which, in the tables at hand.
ANNOUNCES = {"signup": "purchase"}
#: key -> {neighbour: minutes by which its event puts ours off}, and key -> the neighbour whose cycle ours keeps to; both are off unless asked for.
PRECURSORS = {"view": {"click": 3.0, "error": 2.0}}
LATTICES = {"view": "signup"}


def periods(iv: DataFrame, back: int = 40) -> DataFrame:
    """key, epoch and period: the median of those of the last gaps that last 8 to 45 minutes; PERIOD where there are under four."""
    good = F.when((F.col("x") > 8) & (F.col("x") < 45), F.col("x"))
    period = lambda w: {"period": F.when(F.count(good).over(w) >= 4, F.percentile(good, 0.5).over(w)).otherwise(PERIOD)}
    return framed(iv.select("key", "epoch", "id", "x"), "key", back - 2, period).select("key", "epoch", "id", "period")


def known(iv: DataFrame, announces: dict[str, str], step: int = 1800, precursors: dict | None = None, lattices: dict | None = None, triggers: tuple[int, ...] = (), least: int = 12) -> DataFrame:
    """What is known at each multiple of `step` seconds, and `triggers` minutes after each announcement, at which a series had `least` genuine gaps behind it.

    key, t, own (the last event), mean and sd of the last 100 genuine gaps, announced, shift (minutes by precursors), lattice (last event and
    period of the neighbour's cycle), next and next_valid.  iv: key, id, epoch, x and is_valid.  Only `next` looks ahead: it is the first
    event after t, and next_valid says whether it closes a genuine gap.
    """
    moments = lambda w: {"mean": F.avg(F.log("x")).over(w), "sd": F.stddev_samp(F.log("x")).over(w)}
    fits = framed(iv.where("is_valid").select("key", "epoch", "id", "x"), "key", 99, moments).select("key", "epoch", "id", F.struct("mean", "sd", (F.col("rn") + 1).alias("n")).alias("fit"))
    blank = {"fit": F.lit(None).cast(fits.schema["fit"].dataType), "own": F.lit(None).cast("long"), "valid": F.lit(None).cast("boolean"), "ann": F.lit(None).cast("long"), "pre": F.lit(None).cast("map<string,bigint>"), "lat": F.lit(None).cast("struct<epoch: bigint, period: double>")}

    def rows(df: DataFrame, key, t, side: int, **values) -> DataFrame:
        return df.select(key.alias("key"), t.cast("long").alias("t"), F.lit(side).alias("side"), *[values.get(k, v).alias(k) for k, v in blank.items()])

    all_rows = [rows(iv.join(fits, ["key", "epoch", "id"], "left"), F.col("key"), F.col("epoch"), 1, fit=F.col("fit"), own=F.col("epoch"), valid=F.col("is_valid"))]
    for a, b in announces.items():
        near = iv.where(F.col("key") == a)
        all_rows.append(rows(near, F.lit(b), F.col("epoch"), 0, ann=F.col("epoch")))
        if triggers:
            moved = near.select("epoch", F.explode(F.array(*[F.lit(60 * m) for m in triggers])).alias("m"))
            all_rows.append(rows(moved, F.lit(b), F.col("epoch") + F.col("m"), 2))
    for b, each in (precursors or {}).items():
        for a in each:
            all_rows.append(rows(iv.where(F.col("key") == a), F.lit(b), F.col("epoch"), 0, pre=F.create_map(F.lit(a), F.col("epoch"))))
    for b, a in (lattices or {}).items():
        all_rows.append(rows(periods(iv.where(F.col("key") == a)), F.lit(b), F.col("epoch"), 0, lat=F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("period").alias("period"))))
    ends = iv.groupBy("key").agg(F.min("epoch").alias("a"), F.max("epoch").alias("b"))
    first = F.ceil(F.col("a") / step) * step
    grid = ends.where(first <= F.col("b")).select("key", F.explode(F.sequence(first, F.col("b"), F.lit(step).cast("long"))).alias("t"))
    every = rows(grid, F.col("key"), F.col("t"), 2)
    for r in all_rows:
        every = every.unionByName(r)
    every = kept(every)
    # From the newest back, each row sees the first event after it; of one instant, times come before events and those before neighbours'.
    names = sorted({a for each in (precursors or {}).values() for a in each})
    after = {f"after_{i}": F.try_element_at("pre", F.lit(a)) for i, a in enumerate(names)}
    ahead = carried(every, "key", "t", "side", {"next": F.col("own"), "next_valid": F.col("valid"), **after}, ahead=True, itself=False)
    event = F.when(F.col("own").isNotNull(), F.struct("own", *after))
    told = ahead.select("key", "t", "side", "next", "next_valid", F.col("fit").alias("f"), event.alias("e"), F.col("ann").alias("a"), F.col("lat").alias("l"))
    seen = carried(told, "key", "t", "side", {"fit": F.col("f"), "event": F.col("e"), "ann": F.col("a"), "lat": F.col("l")})
    shift = F.lit(0.0)
    for b, each in (precursors or {}).items():
        for a, minutes in each.items():
            came = F.col(f"event.after_{names.index(a)}") <= F.least(F.col("event.own") + int(PRECURSOR_WINDOW * 60), F.col("t"))
            shift = shift + F.when((F.col("key") == b) & came, minutes).otherwise(0.0)
    out = seen.where((F.col("side") == 2) & (F.col("fit.n") >= least)).dropDuplicates(["key", "t"])
    fresh = F.when((F.col("t") - F.col("lat.epoch")) / 60 <= FRESH, F.col("lat"))
    return out.select("key", "t", "event.own", "fit.mean", F.greatest("fit.sd", F.lit(1e-3)).alias("sd"), F.when(F.col("ann") > F.col("event.own"), F.col("ann")).alias("announced"), shift.alias("shift"), fresh.alias("lattice"), "next", "next_valid")


def announcement(elapsed: float, rng: np.random.Generator, sims: int) -> tuple[float, np.ndarray]:
    """Chance that an event announced `elapsed` minutes ago is still to come by this announcement, and draws of the minutes left."""
    if not 0 <= elapsed <= WAIT:
        return 0.0, np.zeros(0)
    d = dist.Dist("normal", LEAD, LEAD_SD)
    passed = float(d.cdf(elapsed))
    w = RELIABLE * (1 - passed) / (RELIABLE * (1 - passed) + 1 - RELIABLE)
    if w <= 0.01 or (1 - passed) * sims < 20:  # too far out in the tail
        return 0.0, np.zeros(0)
    return w, d.ppf(np.clip(passed + (1 - passed) * rng.random(sims), 1e-12, 1 - 1e-12)) - elapsed


def gate(minutes: np.ndarray, period: float) -> np.ndarray:
    """Weights of times, in minutes since a lattice's last event: less in the part of a cycle where nothing begins, the less sure the further off."""
    sd = PERIOD_SD * np.sqrt(np.maximum(np.maximum(minutes / period, 0), 1e-9))
    sure = np.clip(1 - sd / (period / 4), 0, 1)
    phase = np.mod(minutes, period)
    inside = (phase > FORBIDDEN[0]) & (phase < FORBIDDEN[1])
    return 1 - (1 - RESIDUAL) * sure * inside if sure.max(initial=0) > 0.02 else np.ones(len(minutes))


class _Shifted:
    """A distribution that begins later."""

    def __init__(self, d, by: float):
        self.d, self.by = d, by

    def ppf(self, q):
        return self.d.ppf(q) + self.by

    def rvs(self, shape, rng):
        return self.d.rvs(shape, rng) + self.by


def nowcast(mean: float, sd: float, age: float, elapsed: float | None, p_seen: float = 0.9, sims: int = 2000, seed: int = 0, shift: float = 0.0, lattice: tuple[float, float] | None = None):
    """Minutes left until the next event: samples, weights, the announcement's weight, misses and chance of none; None if no path lasts.

    shift: minutes by which precursors put it off; lattice: minutes since the last event of the neighbour's cycle, and its period.
    """
    base = dist.Dist("lognormal", mean, sd)
    s, w, missed, none = dist.renewal(_Shifted(base, shift) if shift else base, max(age, 0.0), p_seen, sims, seed)
    left = s - age
    w = w * (left > 0)
    if w.sum() <= 0:
        return None
    if lattice is not None:
        w = w * gate(lattice[0] + left, lattice[1])
    w = w / w.sum()
    share, soon = announcement(elapsed, np.random.default_rng(seed), sims) if elapsed is not None else (0.0, left[:0])
    if share:
        left, w = np.concatenate((left, soon)), np.concatenate(((1 - share) * w, np.full(len(soon), share / len(soon))))
    return left, w, share, missed, none


FIELDS = "key string, t long, age_min double, indicator_weight double, regime string, missed double, p_current double, lo90 double, lo50 double, median double, hi50 double, hi90 double, actual double, scored boolean, crps double, lo90_off double, lo50_off double, median_off double, hi50_off double, hi90_off double, crps_off double"


def nowcasts(iv: DataFrame, announces: dict[str, str] | None = None, step: int = 1800, p_seen: float = 0.9, **options) -> DataFrame:
    """Rows of FIELDS; _off: the same time without neighbours.  actual and the scores are null after the last event; scored: whether the next event closes a genuine gap."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                age = (r.t - r.own) / 60
                elapsed = None if pd.isna(r.announced) else (r.t - r.announced) / 60
                lattice = r.lattice if isinstance(r.lattice, dict) else r.lattice.asDict() if r.lattice is not None else None
                cycle = ((r.t - lattice["epoch"]) / 60, lattice["period"]) if lattice else None
                seed = int(r.t) % (1 << 31)
                on = nowcast(r.mean, r.sd, age, elapsed, p_seen, seed=seed, shift=r.shift, lattice=cycle)
                off = nowcast(r.mean, r.sd, age, None, p_seen, seed=seed) if elapsed is not None or r.shift or cycle else on
                if on is None or off is None:
                    continue
                left, w, share, missed, none = on
                actual = None if pd.isna(r.next) else (r.next - r.t) / 60
                score = lambda x, v: None if actual is None else dist.crps_sample(x, v, actual)  # noqa: E731, B023
                q = lambda x, v: [dist.weighted_quantile(x, v, p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
                regime = "indicator_active" if share >= 0.5 else "lattice_gated" if cycle else "precursor_shifted" if r.shift else "base"
                out.append((r.key, r.t, age, share, regime, missed, none, *q(left, w), actual, bool(r.next_valid) if not pd.isna(r.next) else None, score(left, w), *q(off[0], off[1]), score(off[0], off[1])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIELDS.split(", ")])

    rows = known(iv, ANNOUNCES if announces is None else announces, step, **options)
    return rows.repartition("key", F.floor(F.col("t") / 86400)).mapInPandas(run, FIELDS)


def backtest(casts: DataFrame) -> DataFrame:
    """Paired by key and regime, and over all regimes (`overall`): errors, scores and coverage with and without neighbours, and what they gain in percent."""
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    inside = lambda a, b: F.avg(F.col("actual").between(F.col(a), F.col(b)).cast("double"))
    out = casts.where("scored and actual > 0").rollup("key", "regime").agg(
        F.grouping("key").alias("all_keys"), F.grouping("regime").alias("all"), F.count(F.lit(1)).alias("n"), err("median").alias("mae"), err("median_off").alias("mae_off"), F.avg("crps").alias("crps"), F.avg("crps_off").alias("crps_off"),
        inside("lo50", "hi50").alias("cover50"), inside("lo50_off", "hi50_off").alias("cover50_off"), inside("lo90", "hi90").alias("cover90"), inside("lo90_off", "hi90_off").alias("cover90_off"),
    )
    delta = lambda c: (100 * (F.col(c) - F.col(c + "_off")) / F.nullif(F.col(c + "_off"), F.lit(0.0))).alias(c + "_delta_pct")
    return out.where("all_keys = 0").withColumn("regime", F.when(F.col("all") == 1, "overall").otherwise(F.col("regime"))).select("*", delta("crps"), delta("mae")).drop("all", "all_keys")


def coverage_over_all(iv: DataFrame, least: int = 300, valid_least: int = 50) -> DataFrame:
    """Coverage of a lognormal of the last 100 valid gaps over all gaps, valid or not: key, n, filtered_pct, cover50 and cover90."""
    all_gaps = kept(intervals.labels(iv).select("key", "id", "epoch", "x", "is_valid"))
    moments = lambda w: {"m": F.avg(F.log("x")).over(w), "s": F.stddev_samp(F.log("x")).over(w)}
    fits = framed(all_gaps.where("is_valid").select("key", "epoch", "id", "x"), "key", 99, moments).select("key", "id", F.struct("m", "s", (F.col("rn") + 1).alias("n")).alias("own"))
    rows = numbered(all_gaps.join(fits, ["key", "id"], "left"), "key")
    rows = carried(rows, "key", "epoch", "id", {"fit": F.col("own")}, itself=False).where((F.col("rn") >= least) & (F.col("fit.n") >= valid_least) & (F.col("x") > 0))

    def inside(z: float) -> Column:
        s = F.greatest(F.col("fit.s"), F.lit(1e-3)) * z
        return F.round(F.avg(F.col("x").between(F.exp(F.col("fit.m") - s), F.exp(F.col("fit.m") + s)).cast("double")), 6)

    out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((~F.col("is_valid")).cast("double")), 6).alias("filtered_pct"), inside(0.674489750196082).alias("cover50"), inside(1.644853626951473).alias("cover90"))
    return out.where("n >= 50")


COVERAGE = """, judged AS (SELECT key, id, epoch, x, coalesce((med IS NOT NULL AND x BETWEEN 0.5e0 * med AND 1.75e0 * med) OR (ml >= 3.5e0 * med AND x BETWEEN 0.5e0 * ml AND 1.75e0 * ml), false) ok FROM l),
  fitted AS (SELECT key, avg(ln(x)) OVER w m, stddev_samp(ln(x)) OVER w s, row_number() OVER (PARTITION BY key ORDER BY epoch, id) n FROM judged WHERE ok WINDOW w AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch, id) rn, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY epoch, id) - CASE WHEN ok THEN 1 ELSE 0 END before FROM judged)
  SELECT p.key, count(*) n, round(100 * avg(CASE WHEN ok THEN 0e0 ELSE 1e0 END), 6) filtered_pct, round(avg(CASE WHEN p.x BETWEEN exp(m - 0.674489750196082e0 * greatest(s, 1e-3)) AND exp(m + 0.674489750196082e0 * greatest(s, 1e-3)) THEN 1e0 ELSE 0e0 END), 6) cover50,
  round(avg(CASE WHEN p.x BETWEEN exp(m - 1.644853626951473e0 * greatest(s, 1e-3)) AND exp(m + 1.644853626951473e0 * greatest(s, 1e-3)) THEN 1e0 ELSE 0e0 END), 6) cover90
  FROM placed p JOIN fitted f ON p.key = f.key AND f.n = p.before WHERE rn > 300 AND before >= 50 GROUP BY p.key HAVING count(*) >= 50"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(intervals.labels(_gaps(spark, sf_dir)).select("key", "id", "epoch", "x", "is_valid"))


def nowcast_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nowcasts(_judged(spark, sf_dir), triggers=(1, 4, 8))


def nowcast_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(nowcasts(_judged(spark, sf_dir), triggers=(1, 4, 8), least=300))


def nowcast_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest with both options on: precursors and the lattice."""
    return backtest(nowcasts(_judged(spark, sf_dir), triggers=(1, 4, 8), least=300, precursors=PRECURSORS, lattices=LATTICES))


def nowcast_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known at each time, with both options on."""
    got = known(_judged(spark, sf_dir), ANNOUNCES, 1800, PRECURSORS, LATTICES, (1, 4, 8), 300)
    return got.select("key", "t", "own", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "announced", "shift", F.col("lattice.epoch").alias("lattice_epoch"), F.round("lattice.period", 6).alias("period"), "next", F.coalesce("next_valid", F.lit(False)).alias("next_valid"))


INPUTS = f""", v AS (SELECT key, id, epoch, x, coalesce((med IS NOT NULL AND x BETWEEN 0.5e0 * med AND 1.75e0 * med) OR (ml >= 3.5e0 * med AND x BETWEEN 0.5e0 * ml AND 1.75e0 * ml), false) ok FROM l),
  fit AS (SELECT key, epoch, avg(ln(x)) OVER w m, stddev_samp(ln(x)) OVER w s, row_number() OVER (PARTITION BY key ORDER BY epoch, id) n FROM v WHERE ok WINDOW w AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
  lat AS (SELECT epoch, CASE WHEN count(*) FILTER (WHERE x > 8 AND x < 45) OVER w >= 4 THEN median(CASE WHEN x > 8 AND x < 45 THEN x END) OVER w ELSE {PERIOD}e0 END period FROM v WHERE key = 'signup' WINDOW w AS (ORDER BY epoch, id ROWS BETWEEN 38 PRECEDING AND CURRENT ROW)),
  ends AS (SELECT key, min(epoch) a, max(epoch) b FROM v GROUP BY key),
  times AS (SELECT key, unnest(range(cast(ceil(a / 1800e0) AS bigint) * 1800, b + 1, 1800)) t FROM ends UNION SELECT 'purchase', epoch + 60 * m FROM v, (VALUES (1), (4), (8)) d(m) WHERE key = 'signup'),
  q1 AS (SELECT q.key, q.t, o.epoch own FROM times q ASOF JOIN v o ON q.key = o.key AND q.t >= o.epoch),
  q2 AS (SELECT q1.*, f.m, f.s, f.n FROM q1 ASOF JOIN fit f ON q1.key = f.key AND q1.t >= f.epoch),
  q3 AS (SELECT q2.*, u.epoch u FROM q2 ASOF LEFT JOIN (SELECT 'purchase' AS key, epoch FROM v WHERE key = 'signup') u ON q2.key = u.key AND q2.t >= u.epoch),
  q4 AS (SELECT q3.*, p.epoch lat_epoch, p.period FROM q3 ASOF LEFT JOIN (SELECT 'view' AS key, * FROM lat) p ON q3.key = p.key AND q3.t >= p.epoch),
  q5 AS (SELECT q4.*, x.epoch next, x.ok next_ok FROM q4 ASOF LEFT JOIN v x ON q4.key = x.key AND q4.t < x.epoch)
  SELECT key, t, own, round(m, 6) mean, round(greatest(s, 1e-3), 6) sd, CASE WHEN u > own THEN u END announced,
    CASE WHEN key = 'view' AND EXISTS (FROM v o WHERE o.key = 'click' AND o.epoch > own AND o.epoch <= least(own + 5400, t)) THEN 3e0 ELSE 0e0 END + CASE WHEN key = 'view' AND EXISTS (FROM v o WHERE o.key = 'error' AND o.epoch > own AND o.epoch <= least(own + 5400, t)) THEN 2e0 ELSE 0e0 END "shift",
    CASE WHEN t - lat_epoch <= {FRESH * 60} THEN lat_epoch END lattice_epoch, CASE WHEN t - lat_epoch <= {FRESH * 60} THEN round(period, 6) END period, next, coalesce(next_ok, false) next_valid FROM q5 WHERE n >= 300"""


#: Of columns elapsed (minutes since an announcement) and z (how far beyond its mean lead, in deviations): the chance that its event is still to come; too far out in the tail it is 0.
_WEIGHT = f"(CASE WHEN left_p * 2000 < 20 OR {RELIABLE}e0 * left_p / ({RELIABLE}e0 * left_p + {1 - RELIABLE:.2f}e0) <= 0.01e0 THEN 0e0 ELSE {RELIABLE}e0 * left_p / ({RELIABLE}e0 * left_p + {1 - RELIABLE:.2f}e0) END)"


def indicator_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, t, elapsed (minutes since the neighbour announced), weight and whether it makes the forecast's regime, at every time with an announcement under way."""
    got = known(_judged(spark, sf_dir), ANNOUNCES, 1800, triggers=(1, 4, 8), least=300).withColumn("elapsed", (F.col("t") - F.col("announced")) / 60)
    got = got.where(F.col("elapsed").between(0, WAIT)).withColumn("z", (F.lit(LEAD) - F.col("elapsed")) / LEAD_SD)
    got = got.withColumn("left_p", F.expr(phi("z"))).withColumn("weight", F.expr(_WEIGHT))
    return got.select("key", "t", F.round("elapsed", 6).alias("elapsed"), F.round("weight", 6).alias("weight"), (F.col("weight") >= 0.5).alias("active"))


def all_gap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_over_all(_gaps(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (nowcast_grid, nowcast_backtest, nowcast_options, nowcast_inputs, indicator_weights, all_gap_coverage)}


def oracle_sql() -> dict[str, str]:
    text = catalog.filled(intervals.ORACLE, catalog._DUCK)
    text = text[: text.index("  SELECT key, id, round(x, 6) x")]
    weights = f"""SELECT key, t, round(elapsed, 6) elapsed, round({_WEIGHT}, 6) weight, {_WEIGHT} >= 0.5e0 active FROM (SELECT *, {phi('z')} left_p FROM (SELECT key, t, (t - announced) / 60e0 elapsed, ({LEAD}e0 - (t - announced) / 60e0) / {LEAD_SD}e0 z
      FROM ({text + INPUTS}) WHERE t - announced BETWEEN 0 AND {int(WAIT * 60)}))"""
    return {"all_gap_coverage": text + COVERAGE, "nowcast_inputs": text + INPUTS, "indicator_weights": weights}
