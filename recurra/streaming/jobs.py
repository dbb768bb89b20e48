"""Structured Streaming: upserts, minute amplitudes, presence counts and the detector.

Sinks are a log of batches: each micro-batch overwrites its own folder, so a batch that runs again after a failure leaves the
same rows, and `latest` gives the newest row of each key.  State is bounded by watermarks or by the detector's look-back.
"""

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from recurra.operators.pieces import carried


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='recurra')).rstrip('/')}/{uuid.uuid4().hex}"


def log(stream: DataFrame, path: str, mode: str = "append", **trigger):
    """Start a query that logs its batches below path; trigger: as writeStream.trigger takes it (default: all there is, then stop)."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def logged(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of a log with their batch; schema: of the stream, so that an empty log can be read."""
    fields = schema.add("batch", "long") if "batch" not in schema.names else schema
    rows = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    rows.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(rows)
    return spark.read.schema(fields).parquet(f"{path}/rows")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the newest batch for each key; a map-side maximum, no window."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def upserted(stream: DataFrame, path: str, *keys: str) -> DataFrame:
    """Run a stream to its end and give the newest row of each key."""
    log(stream, path, "update" if stream.isStreaming else "append").awaitTermination()
    return latest(logged(stream.sparkSession, path, stream.schema), *keys)


def minute_amplitudes(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """m (epoch minute), rms of value and n of tumbling minutes; later than `delay` is late."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    got = rows.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return got.select((F.unix_seconds("w.start") / 60).cast("long").alias("m"), "rms", "n")


def presence(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """key, start (epoch seconds) and n of 45-minute windows that start every 5 minutes."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    got = rows.groupBy(F.col("event_type").alias("key"), F.window("ts", "45 minutes", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("key", F.unix_seconds("w.start").alias("start"), "n")


@dataclass(frozen=True)
class Detector:
    """Fires at minute m if the `sustain` minutes from m are all there and none is under max(least, ratio * base): base is the
    median of the `back` minutes before m, at least `known` of them there and below `quiet`; not within `rest` minutes of a fire."""

    sustain: int = 15
    back: int = 360
    known: int = 120
    quiet: float = 2500.0
    least: float = 6000.0
    ratio: float = 3.0
    rest: int = 60

    def scan(self, m: np.ndarray, v: np.ndarray, done: int | None, fired: int | None) -> tuple[list[tuple[int, float, float]], int | None, int | None]:
        """Fires (m, least of the window, base), the last minute judged and the last fire; m sorted, without repeats.

        A minute is judged once its window has ended, so that minutes still to come are waited for.
        """
        out = []
        if len(m):
            for t in range(int(m[0]) if done is None else done + 1, int(m[-1]) - self.sustain + 2):
                a, b, c = np.searchsorted(m, (t - self.back, t, t + self.sustain))
                done = t
                if c - b < self.sustain or b - a < self.known or (fired is not None and t < fired + self.rest):
                    continue
                base, low = float(np.median(v[a:b])), float(v[b:c].min())
                if base < self.quiet and low >= max(self.least, self.ratio * base):
                    out.append((t, low, base))
                    fired = t
        return out, done, fired


FIRES = "station string, m long, least_next double, base double"


def detections(minutes: DataFrame, rule: Detector = Detector(), idle_ms: int | None = None) -> DataFrame:
    """Fires of a stream of (station, m, rms), with state of `back` + `sustain` minutes a station; a repeated minute's last value counts.  A station that says nothing for idle_ms is forgotten; for streams that run on, as one that stops when all is read would wait for the timeout for ever."""

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        past_m, past_v, done, fired = state.get if state.exists else ([], [], None, None)
        seen = dict(zip(past_m, past_v))
        for f in frames:
            f = f.dropna(subset=["m", "rms"])
            seen.update(zip(f["m"].astype(int).tolist(), f["rms"].tolist()))
        m = np.array(sorted(seen), np.int64)
        v = np.array([seen[k] for k in m.tolist()], float)
        out, done, fired = rule.scan(m, v, done, fired)
        keep = m >= (m[-1] - rule.back - rule.sustain if len(m) else 0)
        state.update((m[keep].tolist(), v[keep].tolist(), done, fired))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["station", "m", "least_next", "base"])

    state = "m array<bigint>, v array<double>, done bigint, fired bigint"
    return minutes.select("station", "m", "rms").groupBy("station").applyInPandasWithState(step, FIRES, state, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def singles(events: DataFrame, gap: int = 60) -> DataFrame:
    """key, id and epoch of a stream's events without those within `gap` seconds of the one before them, so that a chain of reports leaves its first.

    State is a series' last time.  Events of one batch may come in any order; one that is older than its series' state came too late
    to begin a chain and is left out.
    """

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat([f for f in frames]).sort_values(["epoch", "id"])
        t = rows["epoch"].to_numpy(np.int64)
        before = np.concatenate(([t[0] - gap - 1 if last is None else last], t[:-1]))
        before = np.maximum.accumulate(before)
        state.update((int(max(t.max(), before.max())),))
        kept = rows[(t - before) > gap]
        yield pd.DataFrame({"key": key[0], "id": kept["id"], "epoch": kept["epoch"]})

    return events.select("key", "id", "epoch").groupBy("key").applyInPandasWithState(step, "key string, id long, epoch long", "last bigint", "append", GroupStateTimeout.NoTimeout)


def stream_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("event_type IS NOT NULL AND ts IS NOT NULL").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    path = folder(spark)
    out = singles(rows)
    log(out, path).awaitTermination()
    return logged(spark, path, out.schema).select("key", "id", "epoch")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: a stream takes no path of one file


def stream_minute_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = upserted(minute_amplitudes(_events(spark, sf_dir)), folder(spark), "m")
    return out.select("m", F.round("rms", 6).alias("rms"), "n")


def stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(presence(_events(spark, sf_dir)), folder(spark), "key", "start")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(_events(spark, sf_dir).select("event_id", "event_type", "value"), folder(spark), "event_id")


#: The detector over bins of ten minutes, for tables with few events: three bins, three hours to two days before, a fifth above.
SPARSE_BINS = 600
SPARSE_RULE = Detector(sustain=3, back=288, known=60, quiet=2500.0, least=100.0, ratio=1.2, rest=12)


def stream_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires of each station (event type), from a stream of the bins' amplitudes."""
    bins = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null and ts is not null")
    bins = bins.groupBy(F.col("event_type").alias("station"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / SPARSE_BINS).alias("m")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    path = folder(spark)
    bins.write.parquet(f"{path}/bins")
    fires = detections(spark.readStream.schema(bins.schema).parquet(f"{path}/bins"), SPARSE_RULE)
    log(fires, f"{path}/fires").awaitTermination()
    return logged(spark, f"{path}/fires", fires.schema).select("station", "m", F.round("least_next", 6).alias("least_next"), F.round("base", 6).alias("base"))


def batch_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fires by windows over stretches of bins with those around them, and a fold over each run of candidates.

    A candidate that comes the rest or more after the one before it fires whatever came earlier, so runs begin there, and no task holds a station.
    """
    r = SPARSE_RULE
    block = 5 * r.back
    found = spark.sql(
        f"""WITH bins AS (SELECT event_type station, unix_seconds(cast(ts AS timestamp)) div {SPARSE_BINS} m, sqrt(avg(value * value)) v FROM {{events}} WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
        held AS (SELECT *, floor(m / {block}) d, 0 halo FROM bins UNION ALL SELECT *, floor(m / {block}) + 1, 1 FROM bins WHERE pmod(m, {block}) >= {block - r.back} UNION ALL SELECT *, floor(m / {block}) - 1, 1 FROM bins WHERE pmod(m, {block}) < {r.sustain - 1}),
        w AS (SELECT station, m, halo, min(v) OVER f low, count(*) OVER f n, percentile(v, 0.5) OVER b base, count(*) OVER b known FROM held
          WINDOW f AS (PARTITION BY station, d ORDER BY m RANGE BETWEEN CURRENT ROW AND {r.sustain - 1} FOLLOWING), b AS (PARTITION BY station, d ORDER BY m RANGE BETWEEN {r.back} PRECEDING AND 1 PRECEDING))
        SELECT station, m, m * {SPARSE_BINS} t, low, base FROM w WHERE halo = 0 AND n = {r.sustain} AND known >= {r.known} AND base < {r.quiet} AND low >= greatest({r.least}, {r.ratio} * base)""",
        events=spark.read.parquet(f"{sf_dir}/events.parquet"),
    )
    before = carried(found, "station", "t", "m", {"before": F.col("m")}, itself=False)
    runs = carried(before, "station", "t", "m", {"run": F.when(F.col("before").isNull() | (F.col("m") - F.col("before") >= r.rest), F.col("m"))})
    each = runs.groupBy("station", "run").agg(F.array_sort(F.collect_list(F.struct("m", "low", "base"))).alias("a"))
    kept = F.expr(f"aggregate(a, cast(array() AS array<struct<m: bigint, low: double, base: double>>), (s, e) -> if(size(s) = 0 OR e.m >= s[size(s) - 1].m + {r.rest}, concat(s, array(e)), s))")
    return each.select("station", F.explode(kept).alias("x")).select("station", "x.m", F.round("x.low", 6).alias("least_next"), F.round("x.base", 6).alias("base"))


def watch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, status, lag_min, and the last 50 fires' newest with its age: no_data where a station lags more than 30 bins behind, recent within 48 hours."""
    fires = batch_detections(spark, sf_dir).groupBy("station").agg(F.max("m").alias("newest"), F.count(F.lit(1)).alias("fires"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null and ts is not null")
    heard = events.groupBy(F.col("event_type").alias("station")).agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("heard"))
    now = heard.agg(F.max("heard").alias("now"))
    local = F.from_utc_timestamp(F.timestamp_seconds("now"), "America/Denver")
    day = F.month(local) * 100 + F.dayofmonth(local)
    mode = F.when((day >= 1215) | (day <= 321), "suspended").when(F.month(local).between(5, 9) & F.hour(local).between(8, 16), "paused")
    rows = heard.join(fires, "station", "left").join(F.broadcast(now), F.col("now") >= F.col("heard"))
    lag = F.floor((F.col("now") - F.col("heard")) / 60)
    age = (F.col("now") - F.col("newest") * SPARSE_BINS) / 3600
    return rows.select("station", F.coalesce(mode, F.when(lag > 30, "no_data").otherwise("watching")).alias("status"), lag.alias("lag_min"), F.least(F.col("fires"), F.lit(50)).alias("fires"), F.when(age < 48, F.round(age, 1)).alias("hours_ago"))


def queries() -> dict:
    return {f.__name__: f for f in (stream_minute_rms, stream_presence, stream_upsert, stream_singles, stream_detections, batch_detections, watch_status)}


def oracle_sql() -> dict[str, str]:
    r = SPARSE_RULE
    fires = f"""WITH RECURSIVE bins AS (SELECT event_type station, cast(floor(epoch_us(ts) / {SPARSE_BINS}e6) AS bigint) m, sqrt(avg(value * value)) v FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT a.station, a.m, min(b.v) low, (SELECT median(o.v) FROM bins o WHERE o.station = a.station AND o.m BETWEEN a.m - {r.back} AND a.m - 1) base, (SELECT count(*) FROM bins o WHERE o.station = a.station AND o.m BETWEEN a.m - {r.back} AND a.m - 1) held
        FROM bins a JOIN bins b ON a.station = b.station AND b.m BETWEEN a.m AND a.m + {r.sustain - 1} GROUP BY a.station, a.m HAVING count(*) = {r.sustain}),
      ok AS (SELECT * FROM c WHERE held >= {r.known} AND base < {r.quiet} AND low >= greatest({r.least}, {r.ratio} * base)),
      fire AS (SELECT station, min(m) m FROM ok GROUP BY station UNION ALL SELECT f.station, (SELECT min(m) FROM ok WHERE ok.station = f.station AND ok.m >= f.m + {r.rest}) FROM fire f WHERE f.m IS NOT NULL)
      SELECT station, m, round(low, 6) least_next, round(base, 6) base FROM fire JOIN ok USING (station, m)"""
    status = f"""WITH f AS ({fires}), n AS (SELECT station, max(m) newest, count(*) k FROM f GROUP BY station), h AS (SELECT event_type station, cast(floor(max(epoch_us(ts)) / 1e6) AS bigint) heard FROM events WHERE event_type IS NOT NULL GROUP BY 1),
      t AS (SELECT max(heard) now, timezone('America/Denver', to_timestamp(max(heard))) lts FROM h)
      SELECT station, CASE WHEN month(lts) * 100 + day(lts) >= 1215 OR month(lts) * 100 + day(lts) <= 321 THEN 'suspended' WHEN month(lts) BETWEEN 5 AND 9 AND hour(lts) BETWEEN 8 AND 16 THEN 'paused' WHEN (now - heard) // 60 > 30 THEN 'no_data' ELSE 'watching' END status,
        (now - heard) // 60 lag_min, least(k, 50) fires, CASE WHEN (now - newest * {SPARSE_BINS}) / 3600e0 < 48 THEN round((now - newest * {SPARSE_BINS}) / 3600e0, 1) END hours_ago FROM h LEFT JOIN n USING (station), t"""
    return {
        "stream_singles": "WITH e AS (SELECT event_type AS key, event_id id, cast(floor(epoch_us(ts) / 1000000) AS bigint) epoch FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL) SELECT key, id, epoch FROM e QUALIFY coalesce(epoch - lag(epoch) OVER (PARTITION BY key ORDER BY epoch, id) > 60, true)",
        "stream_detections": fires,
        "batch_detections": fires,
        "watch_status": status,
        "stream_minute_rms": "SELECT cast(floor(epoch_us(ts) / 60000000) AS bigint) m, round(sqrt(avg(value * value)), 6) rms, count(*) n FROM events WHERE ts IS NOT NULL GROUP BY 1",
        "stream_presence": "SELECT event_type AS key, cast(floor(epoch_us(ts) / 300000000) AS bigint) * 300 - 300 * k AS start, count(*) n FROM events, range(9) t(k) WHERE ts IS NOT NULL GROUP BY 1, 2",
        "stream_upsert": "SELECT event_id, event_type, value FROM events",
    }
