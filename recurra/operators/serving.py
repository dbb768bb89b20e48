"""Forecasts as served: how well a series is watched, the renewal forecast of each from its newest event, and the order they are shown in.

How well a series is watched comes from two tables of 24 local hours: the share of genuine gaps by the hour that a gap began in
(two seasons, drawn towards the series' own share), and where its events fall in the day, which says at which hours events go
unseen.  Events of any series in the last 45 minutes lift the present hour.  "Now" is given, or the newest event of all.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import dist
from recurra.plans import catalog

from . import nowcasts
from .intervals import gaps, labels
from .pieces import kept, numbered
from .roster import HISTORY, KNOWN, MODELS, SERIES, Series, default_for

#: Pull towards a series' own share, bounds of a chance to be seen, minutes and events that mean that someone is there.
PULL, LEAST, MOST, ACTIVE_MIN, ACTIVE_FULL = 200, 0.30, 0.995, 45, 8
PROFILE_LEAST = 0.05
RANK = {"live": 0, "planning": 1, "context": 2}


def _dense() -> str:
    """All seasons and hours, whether there are events or none."""
    return "SELECT key, season, hr FROM (SELECT DISTINCT key FROM judged) LATERAL VIEW explode(sequence(0, 1)) AS season LATERAL VIEW explode(sequence(0, 23)) AS hr"


def judged_gaps(events: DataFrame) -> DataFrame:
    """key, id, season, hr (local hour in which the gap began) and is_valid of every gap."""
    iv = gaps(events.sparkSession, events)
    season = F.when(F.col("month_local").between(5, 9), 0).otherwise(1)
    return iv.select("key", "id", season.alias("season"), F.col("prev_hour").alias("hr")).join(labels(iv).select("key", "id", "is_valid"), ["key", "id"])


def completeness(judged: DataFrame) -> DataFrame:
    """key, season (0 warm, 1 cold), hr, n and rate: the chance that the event after one of that hour was seen; 48 rows a series."""
    return judged.sparkSession.sql(
        f"""WITH judged AS (SELECT * FROM {{judged}}), p AS (SELECT key, avg(CASE WHEN is_valid THEN 1e0 ELSE 0e0 END) prior FROM judged GROUP BY key),
        c AS (SELECT key, season, hr, count(*) n, sum(CASE WHEN is_valid THEN 1 ELSE 0 END) v FROM judged GROUP BY key, season, hr), g AS ({_dense()})
        SELECT g.key, g.season, g.hr, coalesce(n, 0L) n, greatest({LEAST}e0, least({MOST}e0, (coalesce(v, 0) + {PULL} * prior) / (coalesce(n, 0) + {PULL}))) rate FROM g JOIN p ON g.key = p.key LEFT JOIN c ON g.key = c.key AND g.season = c.season AND g.hr = c.hr""",
        judged=judged,
    )


def profile(judged: DataFrame) -> DataFrame:
    """key, season, hr and p: the chance that an event of that hour is seen, of mean the series' own share; an hour without events counts as one."""
    return judged.sparkSession.sql(
        f"""WITH judged AS (SELECT * FROM {{judged}}), p AS (SELECT key, avg(CASE WHEN is_valid THEN 1e0 ELSE 0e0 END) base FROM judged GROUP BY key),
        c AS (SELECT key, season, hr, count(*) n FROM judged GROUP BY key, season, hr), g AS ({_dense()}),
        d AS (SELECT g.key, g.season, g.hr, 1 + coalesce(n, 0) n, sum(1 + coalesce(n, 0)) OVER (PARTITION BY g.key, g.season) total FROM g LEFT JOIN c ON g.key = c.key AND g.season = c.season AND g.hr = c.hr)
        SELECT d.key, season, hr, greatest({PROFILE_LEAST}e0, least({MOST}e0, base * n * 24 / total)) p FROM d JOIN p ON d.key = p.key""",
        judged=judged,
    )


def lifted(p: float, active: int) -> float:
    """A chance to be seen, where so many events were logged in the last minutes; never above what one can be sure of."""
    return max(p, LEAST + (MOST - LEAST) * min(active / ACTIVE_FULL, 1.0)) if active > 0 else p


SERVED = (
    "key string, model string, mode string, regime string, error string, anchor long, anchor_id long, age_min double, n_training long, completeness double, active long, missed double, p_current double, overdue boolean, stale boolean, "
    "median_min double, predicted long, lo50 long, hi50 long, lo90 long, hi90 long, minutes_until double, naive_median double, naive_lo90 double, naive_hi90 double, phase_window_min double, "
    "entry string, flags array<string>, branch string, n_branch long, n_window long, density array<double>"
)
NAMES = [f.split()[0] for f in SERVED.split(", ")]


def serve_one(key: str, h: pd.DataFrame, anchor: dict, now: int, rates: np.ndarray, hours: np.ndarray, active: int, announced: int | None = None, series: Series = SERIES, model: str | None = None, window_hours: float = 12.0, points: int = 96, sims: int = 4000) -> dict:
    """A row of SERVED.

    h: the genuine gaps, oldest first, with what was known when each began; anchor: the newest event and the gap before it; rates:
    completeness[season, hour]; hours: the chances by the hour in the present season; announced: when a neighbour's event announced one.
    """
    out = dict.fromkeys(NAMES) | {"key": key, "mode": "live", "regime": "base", "anchor": anchor["epoch"], "anchor_id": anchor["id"], "n_training": len(h), "active": active}
    if key in series.context:
        return out | {"mode": "context"}
    if len(h) < 50:
        return out | {"error": "insufficient data"}
    x = h["x"].to_numpy(float)
    age = (now - anchor["epoch"]) / 60
    row = {"prev_x": anchor["x"] if anchor["x"] and anchor["x"] > 0 else float(np.median(x[-200:])), "prev_dur": anchor["dur"]} | {"prev_" + k: anchor[k] for k in ("minor", "electronic", "initial", "hour", "day")}
    name = model or default_for(key, series)
    if name not in MODELS:
        return out | {"error": f"unknown model {name}"}
    fit = MODELS[name][0]()(h, row)
    if fit is None:
        return out | {"error": "no fit"}
    local = pd.Timestamp(now, unit="s", tz="UTC").tz_convert(catalog.ZONE)
    season = 0 if 5 <= local.month <= 9 else 1
    seen = min(max(lifted(float(rates[season, local.hour]), active), LEAST), MOST)
    by_hour = hours.copy()
    by_hour[local.hour] = lifted(by_hour[local.hour], active)
    first = dist.widened(x, fit) or fit
    rest = (dist.series_marginal(x) if key in series.series else None) or dist.widened(x) or first
    s, w, missed, none = dist.renewal(first, max(age, 0.0), by_hour, sims, 0, rest, anchor["hour"] + anchor["minute"] / 60)
    q = [dist.weighted_quantile(s, w, p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    regime = "base"
    ahead = s - age
    if announced is not None and announced > anchor["epoch"]:
        past = h["x"].to_numpy(float)[-100:]
        got = nowcasts.nowcast(float(np.log(past).mean()), max(float(np.log(past).std(ddof=1)), 1e-3), max(age, 0.0), (now - announced) / 60, seen, sims)
        if got is not None and got[2] >= 0.5:  # what a neighbour announces beats the gaps
            left, w, _, missed, none = got
            regime, ahead = "indicator_active", left
            q = [age + max(dist.weighted_quantile(left, w, p), 0.0) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    naive = fit.ppf(np.array([0.05, 0.5, 0.95]))
    at = lambda m: int(anchor["epoch"] + round(m * 60))
    phase = series.phase_cycles[key] * float(naive[1]) if key in series.phase_cycles else None
    branch, n_branch, n_window = None, None, None
    for keys, flag, back, yes, no in ((series.minor, "prev_minor", 400, "after a minor", "after a full event"), (series.series, "prev_initial", 600, "after the first of a series", "within a series")):
        if key in keys and branch is None:
            recent = h[flag].to_numpy(bool)[-back:]
            branch, n_branch, n_window = yes if row[flag] else no, int((recent == bool(row[flag])).sum()), len(recent)
    grid = np.linspace(0, window_hours * 60, points)
    return out | {
        "model": name if regime == "base" else f"{name} + {regime}",
        "mode": "planning" if phase is not None and age > phase else "live",
        "regime": regime,
        "age_min": age,
        "completeness": round(seen, 3),
        "missed": round(missed, 2),
        "p_current": round(none, 3),
        "overdue": bool(age > float(first.ppf(0.5)) and none > 0.5),
        "stale": bool(missed >= 0.5),
        "median_min": round(q[2], 1),
        "predicted": at(q[2]),
        "lo50": at(q[1]),
        "hi50": at(q[3]),
        "lo90": at(q[0]),
        "hi90": at(q[4]),
        "minutes_until": round(q[2] - age, 1),
        "naive_median": round(float(naive[1]), 1),
        "naive_lo90": round(float(naive[0]), 1),
        "naive_hi90": round(float(naive[2]), 1),
        "phase_window_min": None if phase is None else round(phase, 1),
        "entry": "electronic logger" if anchor["electronic"] else "in-person",
        "flags": [k for k in ("minor", "initial") if anchor[k]],
        "branch": branch,
        "n_branch": n_branch,
        "n_window": n_window,
        "density": dist.density(grid, samples=ahead, weights=w).tolist(),
    }


def anchors(events: DataFrame, now: int) -> DataFrame:
    """The newest event of each series up to `now`, and the gap in minutes before it."""
    ev = events.sparkSession.sql(catalog.filled("SELECT * FROM (@EV@)", catalog._SPARK), events=events).where(F.col("epoch") <= now)
    newest = Window.partitionBy("key").orderBy(F.desc("epoch"), F.desc("id"))
    two = ev.withColumn("turn", F.row_number().over(newest)).where("turn <= 2")
    one = lambda c: F.max(F.when(F.col("turn") == 1, F.col(c))).alias(c)
    out = two.withColumn("hour", F.hour("lts")).withColumn("minute", F.minute("lts")).withColumn("day", F.dayofyear("lts"))
    out = out.groupBy("key").agg(*[one(c) for c in ("epoch", "id", "dur", "minor", "electronic", "initial", "hour", "minute", "day")], ((F.max("epoch") - F.max(F.when(F.col("turn") == 2, F.col("epoch")))) / 60).alias("x"))
    return out


def serve(events: DataFrame, now: int | None = None, series: Series = SERIES, announces: dict[str, str] | None = None, keys: list[str] | None = None, model: str | None = None, hours: float = 12.0, points: int = 96, live: DataFrame | None = None) -> DataFrame:
    """Rows of SERVED and `place`: live ones first, soonest first, then those that only plan, then context, then those that failed.

    A series that fails, fails alone: its row has the error.  live: rows of recent events that add to the table's, and win over it by event_id.
    """
    spark = events.sparkSession
    if live is not None:
        events = events.join(live.select("event_id"), "event_id", "left_anti").unionByName(live)
    if now is None:
        now = events.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0] or 0
    events = events.where(F.unix_seconds(F.col("ts").cast("timestamp")) <= now)
    announces = nowcasts.ANNOUNCES if announces is None else announces
    local = pd.Timestamp(now, unit="s", tz="UTC").tz_convert(catalog.ZONE)
    season = 0 if 5 <= local.month <= 9 else 1
    iv = gaps(spark, events)
    judged = kept(iv.withColumn("season", F.when(F.col("month_local").between(5, 9), 0).otherwise(1)).withColumn("hr", F.col("prev_hour")).join(labels(iv).select("key", "id", "prev_x", "is_valid"), ["key", "id"]))
    rows = numbered(judged.where("is_valid"), "key")
    last = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").where(F.col("rn") >= F.col("n") - HISTORY)
    history = last.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rn", "x", *KNOWN))).alias("h"))  # at most HISTORY rows
    rates = completeness(judged).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("season", "hr", "rate"))).alias("rates"))
    chances = profile(judged).where(F.col("season") == season).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("hr", "p"))).alias("chances"))
    first = anchors(events, now)
    active = events.where(F.unix_seconds(F.col("ts").cast("timestamp")) > now - ACTIVE_MIN * 60).count()
    told = F.create_map(*[F.lit(x) for a, b in announces.items() for x in (a, b)]) if announces else F.lit(None).cast("map<string,string>")
    heard = first.select(F.try_element_at(told, F.col("key")).alias("key"), F.col("epoch").alias("announced")).where("key is not null")
    table = first.join(history, "key", "left").join(rates, "key", "left").join(chances, "key", "left").join(heard, "key", "left")
    if keys is not None:
        table = table.where(F.col("key").isin(keys))

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                h = pd.DataFrame([dict(x) if isinstance(x, dict) else x.asDict() for x in (r["h"] if r["h"] is not None else [])], columns=["rn", "x", *KNOWN])
                table = np.full((2, 24), 0.9)
                for x in r["rates"] if r["rates"] is not None else []:
                    table[x["season"], x["hr"]] = x["rate"]
                by_hour = np.array([x["p"] for x in r["chances"]]) if r["chances"] is not None else np.full(24, 0.9)
                whole = lambda v: None if v is None or pd.isna(v) else int(v)
                anchor = {k: None if pd.isna(r[k]) else r[k] for k in ("epoch", "id", "dur", "minor", "electronic", "initial", "hour", "minute", "day", "x")}
                try:
                    got = serve_one(r["key"], h, anchor, now, table, by_hour, active, whole(r["announced"]), series, model, hours, points)
                except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                    got = dict.fromkeys(NAMES) | {"key": r["key"], "mode": "live", "regime": "base", "error": f"{type(e).__name__}: {e}"}
                out.append(got)
            yield pd.DataFrame(out, columns=NAMES).astype({c: "Int64" for c in ("anchor", "anchor_id", "n_training", "active", "predicted", "lo50", "hi50", "lo90", "hi90", "n_branch", "n_window")})

    served = table.repartition("key").mapInPandas(run, SERVED)
    rank = F.when(F.col("error").isNotNull(), 3).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)]), F.col("mode")))
    return served.withColumn("place", F.row_number().over(Window.orderBy(rank, F.col("minutes_until").asc_nulls_last(), "key")))  # a row for each series


#: Which key's events say what of which: key, target (None: of all), minutes they count for, what is said.
SIGNALS = [("signup", "purchase", 30, "signup logged {ago} ago"), ("error", "purchase", 60, "error logged {ago} ago"), ("click", "view", 35, "click logged {ago} ago"), ("error", None, 360, "errors, the last {ago} ago")]


def signals(events: DataFrame, now: int | None = None, rules: list = SIGNALS, live: DataFrame | None = None) -> DataFrame:
    """key, target, newest, minutes and note of each rule whose key has an event within its time; where live has one, the table's are not looked at."""
    spark = events.sparkSession
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    if now is None:
        now = events.agg(F.max(seconds)).first()[0] or 0
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule int, key string, target string, lookback int, template string")
    newest = lambda df, n: df.groupBy(F.trim("event_type").alias("key")).agg(F.max(seconds).alias(n))
    late = F.broadcast(table).join(newest(events, "held"), "key", "left")
    late = late.join(newest(live, "fresh"), "key", "left") if live is not None else late.withColumn("fresh", F.lit(None).cast("long"))
    within = lambda c: F.when(F.col(c) > now - F.col("lookback") * 60, F.col(c))
    out = late.withColumn("newest", F.coalesce(within("fresh"), within("held"))).where("newest is not null").withColumn("minutes", F.greatest(F.floor((now - F.col("newest")) / 60), F.lit(0)))
    ago = F.when(F.col("minutes") < 90, F.concat(F.col("minutes").cast("string"), F.lit(" min"))).otherwise(F.concat(F.format_number(F.col("minutes") / 60, 1), F.lit(" h")))
    return out.select("rule", "key", "target", "newest", "minutes", F.replace(F.col("template"), F.lit("{ago}"), ago).alias("note"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def hourly_rate_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(judged_gaps(_events(spark, sf_dir))).withColumn("rate", F.round("rate", 6))


def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(kept(judged_gaps(_events(spark, sf_dir)))).withColumn("p", F.round("p", 6))


def completeness_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, p_seen (of the present hour, lifted by who is there), active, and the present hour's chance of the profile, lifted too."""
    events = _events(spark, sf_dir)
    judged = kept(judged_gaps(events))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    now = events.agg(F.max(seconds).alias("now"))
    active = events.join(F.broadcast(now), seconds > F.col("now") - ACTIVE_MIN * 60).groupBy("now").agg(F.count(F.lit(1)).alias("active"))
    lts = F.from_utc_timestamp(F.timestamp_seconds("now"), catalog.ZONE)
    there = active.select("active", F.when(F.month(lts).between(5, 9), 0).otherwise(1).alias("season"), F.hour(lts).alias("hr"))
    live = F.lit(LEAST) + F.lit(MOST - LEAST) * F.least(F.col("active") / ACTIVE_FULL, F.lit(1.0))
    lift = lambda c: F.round(F.when(F.col("active") > 0, F.greatest(F.col(c), live)).otherwise(F.col(c)), 6)
    return completeness(judged).join(profile(judged), ["key", "season", "hr"]).join(F.broadcast(there), ["season", "hr"]).select("key", "active", lift("rate").alias("p_seen"), lift("p").alias("p_hour"))


def serve_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve(_events(spark, sf_dir))


def served_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, minute and d: the relative height of each forecast over the next twelve hours."""
    return serve(_events(spark, sf_dir)).select("key", F.posexplode("density").alias("i", "d")).select("key", F.round(F.col("i") * 720 / 95, 6).alias("minute"), "d")


def live_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(_events(spark, sf_dir))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, series, newest and its age in hours behind the newest of the whole table, by series."""
    ev = spark.sql(catalog.filled("SELECT * FROM (@EV@)", catalog._SPARK), events=_events(spark, sf_dir))
    by = ev.groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.max("epoch").alias("newest"))
    return by.join(by.agg(F.max("newest").alias("now")), F.col("now") >= F.col("newest")).select("key", "events", "newest", F.round((F.col("now") - F.col("newest")) / 3600, 2).alias("age_hours"))


def sync_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of recent entries to ask for at the end of the table's last day: since the newest event and an hour more, 60 at least, a week at most."""
    ev = spark.sql(catalog.filled("SELECT * FROM (@EV@)", catalog._SPARK), events=_events(spark, sf_dir)).groupBy("key").agg(F.max("epoch").alias("newest"))
    end = (F.floor(F.col("newest") / 86400) + 1) * 86400
    return ev.select("key", F.greatest(F.lit(60), F.least(F.lit(10080), F.floor((end - F.col("newest")) / 60) + 60)).cast("long").alias("minutes"))


def queries() -> dict:
    return {f.__name__: f for f in (hourly_rate_shrunk, hourly_profile, completeness_now, serve_predictions, served_density, live_notes, health, sync_lookback)}


def oracle_sql() -> dict[str, str]:
    from .intervals import ORACLE

    text = ORACLE[: ORACLE.index("  SELECT key, id, round(x, 6) x")]
    text += """, v AS (SELECT key, CASE WHEN month(lts) BETWEEN 5 AND 9 THEN 0 ELSE 1 END season, hour(prev_lts) hr, coalesce(x BETWEEN 0.5e0 * med AND 1.75e0 * med, false) OR coalesce(ml >= 3.5e0 * med AND x BETWEEN 0.5e0 * ml AND 1.75e0 * ml, false) ok FROM l),
      grid AS (SELECT key, season, hr FROM (SELECT DISTINCT key FROM v), range(2) a(season), range(24) h(hr)),
      rates AS (SELECT g.key, g.season, g.hr, (SELECT count(*) FROM v WHERE v.key = g.key AND v.season = g.season AND v.hr = g.hr) n, (SELECT count(*) FILTER (WHERE ok) FROM v WHERE v.key = g.key AND v.season = g.season AND v.hr = g.hr) k, (SELECT avg(ok::int) FROM v WHERE v.key = g.key) prior FROM grid g),
      tables AS (SELECT key, season, hr, n, least(0.995e0, greatest(0.3e0, (k + 200 * prior) / (n + 200))) rate, least(0.995e0, greatest(0.05e0, (1 + n) * 24 * prior / (SELECT sum(1 + n) FROM rates o WHERE o.key = r.key AND o.season = r.season))) p FROM rates r)"""
    lift = lambda c: f"round(CASE WHEN active > 0 THEN greatest({c}, 0.3e0 + 0.695e0 * least(active / 8e0, 1)) ELSE {c} END, 6)"
    out = {
        "hourly_rate_shrunk": text + " SELECT key, cast(season AS int) season, cast(hr AS int) hr, n, round(rate, 6) rate FROM tables",
        "hourly_profile": text + " SELECT key, cast(season AS int) season, cast(hr AS int) hr, round(p, 6) p FROM tables",
        "completeness_now": text
        + f""", t AS (SELECT count(*) active FROM ev WHERE epoch > (SELECT max(epoch) FROM ev) - 2700), n AS (SELECT arg_max(lts, epoch) lts FROM ev)
      SELECT key, active, {lift('rate')} p_seen, {lift('p')} p_hour FROM tables, t, n WHERE hr = hour(n.lts) AND season = CASE WHEN month(n.lts) BETWEEN 5 AND 9 THEN 0 ELSE 1 END""",
        "live_notes": "WITH ev AS (@EV@), r(rule, key, target, lookback, template) AS (VALUES "
        + ", ".join(f"({i}, '{k}', {'NULL' if t is None else repr(t)}, {b}, '{n}')" for i, (k, t, b, n) in enumerate(SIGNALS))
        + """), l AS (SELECT rule, r.key, target, lookback, template, max(epoch) newest, (SELECT max(epoch) FROM ev) now FROM r JOIN ev ON ev.key = r.key GROUP BY ALL), m AS (SELECT *, (now - newest) // 60 AS minutes FROM l WHERE newest > now - lookback * 60)
      SELECT rule, key, target, newest, "minutes", replace(template, '{ago}', CASE WHEN minutes < 90 THEN minutes || ' min' ELSE printf('%.1f', minutes / 60e0) || ' h' END) note FROM m""",
        "health": "WITH ev AS (@EV@) SELECT key, count(*) events, max(epoch) newest, round(((SELECT max(epoch) FROM ev) - max(epoch)) / 3600e0, 2) age_hours FROM ev GROUP BY key",
        "sync_lookback": "WITH ev AS (@EV@) SELECT key, cast(greatest(60, least(10080, (86400 - max(epoch) % 86400) // 60 + 60)) AS bigint) AS minutes FROM ev GROUP BY key",
    }
    return {k: catalog.filled(v, catalog._DUCK) for k, v in out.items()}
