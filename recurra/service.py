"""The engine as an application: answers as plain dictionaries, by a session and a table of events.

Each answer is one or a few queries whose results have a row for a series, a day or a line on a page.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.operators import intervals, roster, serving
from recurra.operators.roster import SERIES, Series
from recurra.plans import catalog, scoring

METHOD = (
    "Every forecast was logged before the event it is scored by. A source is scored by the window it states itself, so its share of hits means little without the window's width. "
    "Where a source forecasts again, only the last forecast before the event is scored. Coverage is the share of all scored events that a source had a forecast for. "
    "An event that comes long after a forecast is scored for nobody: most likely another went unseen in between."
)


class Unknown(KeyError):
    """A series that there is not."""


def _iso(epoch) -> str | None:
    return None if epoch is None else dt.datetime.fromtimestamp(int(epoch), dt.UTC).isoformat()


class Service:
    """get_predictions, get_recent, get_stats, get_scoreboard, get_comparisons and get_health over a table of events; now: epoch seconds, or the newest event."""

    def __init__(self, spark: SparkSession, events: DataFrame, series: Series = SERIES, now: int | None = None, live: DataFrame | None = None):
        self.spark, self.events, self.series, self.live = spark, events, series, live
        if live is not None:
            self.events = events.join(live.select("event_id"), "event_id", "left_anti").unionByName(live)
        self.ev = self._sql("SELECT * FROM (@EV@)")
        self.now = now if now is not None else self.ev.agg(F.max("epoch")).first()[0]

    def _sql(self, text: str, **args) -> DataFrame:
        return self.spark.sql(catalog.filled(text, catalog._SPARK), args=args or None, events=self.events)

    def names(self) -> list[str]:
        return [r[0] for r in self.ev.select("key").distinct().orderBy("key").collect()]

    def resolve(self, name: str) -> str:
        for key in self.names():
            if key.lower() == name.strip().lower():
                return key
        raise Unknown(f"unknown series {name!r}; there are {self.names()}")

    def get_predictions(self, keys: list[str] | None = None, hours: float = 12.0, points: int = 96, model: str | None = None, density: bool = True) -> dict:
        """All series' forecasts in the order they are shown, with signals."""
        rows = serving.serve(self.events, self.now, self.series, keys=keys, model=model, hours=hours, points=points).orderBy("place").collect()
        notes = serving.signals(self.events, self.now).orderBy("rule").collect()
        out = []
        for r in rows:
            p = {k: v for k, v in r.asDict().items() if v is not None and k != "place"}
            if not density:
                p.pop("density", None)
            elif "density" in p:
                p["density"] = [{"t": _iso(self.now + hours * 3600 * i / (points - 1)), "d": d} for i, d in enumerate(p["density"])]
            for k in ("anchor", "predicted", "lo50", "hi50", "lo90", "hi90"):
                if k in p:
                    p[k + "_utc"] = _iso(p[k])
            if r["mode"] == "context":
                p |= self.context(r["key"])
            if own := [n["note"] for n in notes if n["target"] == r["key"]]:
                p["live_signals"] = own
            out.append(p)
        return {"generated_utc": _iso(self.now), "window_hours": hours, "predictions": out, "park_signals": [n["note"] for n in notes if n["target"] is None]}

    def context(self, key: str) -> dict:
        """When a series that is not forecast last had a major event, and the gaps between the last nine."""
        majors = self.ev.where((F.col("key") == key) & ~F.col("minor") & (F.col("epoch") <= self.now)).select("epoch").distinct().orderBy(F.desc("epoch")).limit(9)
        t = [r[0] for r in majors.collect()]
        gaps = sorted((a - b) / 86400 for a, b in zip(t[:-1], t[1:]))
        if not gaps:
            return {}
        middle = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2
        return {"days_since": round((self.now - t[0]) / 86400, 1), "recent_intervals_days": {"n": len(gaps), "min": round(gaps[0], 1), "median": round(middle, 1), "max": round(gaps[-1], 1)}}

    def get_recent(self, hours: int = 24, keys: list[str] | None = None) -> dict:
        rows = self.ev.where((F.col("epoch") > self.now - hours * 3600) & (F.col("epoch") <= self.now))
        if keys:
            rows = rows.where(F.col("key").isin(keys))
        items = [{"id": r["id"], "key": r["key"], "time_utc": _iso(r["epoch"]), "minor": r["minor"], "duration": r["dur"]} for r in rows.orderBy(F.desc("epoch"), F.desc("id")).collect()]
        return {"hours": hours, "count": len(items), "events": items}

    def get_stats(self, key: str | None = None) -> dict:
        """Of the genuine gaps of each series, and of those of the last year."""
        valid = intervals.labels(intervals.gaps(self.spark, self.events)).where("is_valid")
        if key:
            valid = valid.where(F.col("key") == key)
        year = F.when(F.col("epoch") >= self.now - 365 * 86400, F.col("x"))
        local = F.year(F.from_utc_timestamp(F.timestamp_seconds("epoch"), catalog.ZONE))
        p = F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
        rows = valid.groupBy("key").agg(F.count("x").alias("n"), p.alias("p"), F.avg("x").alias("mean"), F.stddev("x").alias("sd"), F.min(local).alias("first"), F.max(local).alias("last"), F.count(year).alias("yn"), F.median(year).alias("ym"), F.stddev(year).alias("ys"))
        num = lambda v: None if v is None else round(float(v), 1)
        return {
            "stats": [
                {"key": r["key"], "n_valid_intervals": r["n"], "median_interval_min": num(r["p"][1]), "mean_interval_min": num(r["mean"]), "sd_interval_min": num(r["sd"]), "p05_interval_min": num(r["p"][0]), "p95_interval_min": num(r["p"][2])}
                | {"first_year": r["first"], "last_year": r["last"], "last_12mo": {"n": r["yn"], "median_interval_min": num(r["ym"]), "sd_interval_min": num(r["ys"])}}
                for r in rows.orderBy("key").collect()
            ]
        }

    def _scoring(self, name: str) -> DataFrame:
        return self.spark.sql(scoring.text(name, "spark"), events=self.events)

    def get_scoreboard(self, key: str | None = None) -> dict:
        """Every series by every source: None where a source never forecasts it, a zero where it waits for its first event."""
        by: dict[str, dict] = {}
        for r in self._scoring("scoreboard").collect():
            if key and r["key"] != key:
                continue
            d = {k: (round(v, 3) if isinstance(v, float) else v) for k, v in r.asDict().items() if k not in ("key", "source", "state", "n_events")}
            shown = None if r["state"] == "none" else {"n": 0, "awaiting_first_event": True} if r["state"] == "awaiting" else d
            by.setdefault(r["key"], {"key": r["key"], "n_events": r["n_events"], "by_source": {}})["by_source"][r["source"]] = shown
        return {"generated_utc": _iso(self.now), "window_days": scoring.DAYS, "sources": list(scoring.SOURCES), "rows": [by[k] for k in sorted(by)], "methodology": METHOD}

    def get_comparisons(self, limit: int = 20, offset: int = 0, day: str | None = None, key: str | None = None) -> dict:
        """Scored events, newest first, with each source's forecast beside them, and the days there are."""
        rows = self._scoring("score_rows").withColumn("day", F.date_format(F.from_utc_timestamp(F.timestamp_seconds("actual"), catalog.ZONE), "yyyy-MM-dd"))
        if key:
            rows = rows.where(F.col("key") == key)
        each = rows.groupBy("key", "event_id", "actual", "day").agg(F.collect_list(F.struct("source", "predicted", "err", "abs_err", "lead_min", "in_window", "in_inner", "opens", "closes", "inner_opens", "inner_closes", "width")).alias("by"))
        days = [{"date": r["day"], "n_events": r["count"]} for r in each.groupBy("day").count().orderBy(F.desc("day")).collect()]
        chosen = each.where(F.col("day") == day) if day else each
        total = chosen.count()
        page = chosen.orderBy(F.desc("actual"), F.desc("event_id")).offset(offset).limit(limit).collect()
        shown = [
            {"key": r["key"], "event_id": r["event_id"], "actual_utc": _iso(r["actual"]), "day": r["day"], "sources": {s: next(({k: v for k, v in x.asDict().items() if k != "source"} for x in r["by"] if x["source"] == s), None) for s in scoring.SOURCES}}
            for r in page
        ]
        return {"count": len(shown), "total": total, "offset": offset, "limit": limit, "has_more": offset + len(shown) < total, "day": day, "available_days": days, "comparisons": shown}

    def get_health(self) -> dict:
        n, newest = self.ev.agg(F.count(F.lit(1)), F.max("epoch")).first()
        return {"status": "ok", "now_utc": _iso(self.now), "archive_rows": n, "newest_event_utc": _iso(newest), "data_age_hours": None if newest is None else round((self.now - newest) / 3600, 2), "series": self.names()}

    def backtest(self, days: int = 20) -> DataFrame:
        return roster.scores(roster.kept(roster.walk_forward(intervals.gaps(self.spark, self.events), days, self.now)))
