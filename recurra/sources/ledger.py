"""The ledger of forecasts as a table: what is added first stays, events take what they find open, old rows expire.

A ledger is a log of Parquet generations below a folder; a generation is written whole under its own number and becomes current by
the rename of a small pointer file's successor, so readers never see half of one and a lost writer leaves the old one current.
"""

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.operators.pieces import carried

OPEN = "source string, key string, forecast_id string, issued long, predicted long, opens long, closes long, inner_opens long, inner_closes long, detail string"
SCORED = "source string, key string, event_id long, actual long, issued long, predicted long, opens long, closes long, inner_opens long, inner_closes long, signed_error_min double, abs_error_min double, lead_minutes double, in_window boolean, in_inner boolean, window_width_min double, superseded long"
EXPIRY, RETENTION, LEAST_HORIZON = 48 * 3600, 180 * 86400, 6 * 3600


def added(held: DataFrame, new: DataFrame) -> DataFrame:
    """held and the rows of new whose (source, forecast_id) it lacks; among new ones of the same identity the first issued stays."""
    first = Window.partitionBy("source", "forecast_id").orderBy("issued", "predicted")
    once = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return held.unionByName(once.join(held.select("source", "forecast_id"), ["source", "forecast_id"], "left_anti").select(held.columns))


def takers(held: DataFrame, events: DataFrame) -> DataFrame:
    """held with event_id and actual of the first event (key, event_id, epoch) after each was issued; null where there is none yet."""
    rows = held.select("key", F.col("issued").alias("t"), F.lit(1).alias("side"), F.struct(*held.columns).alias("f"), F.lit(None).cast("struct<epoch:bigint,event_id:bigint>").alias("e"))
    first = events.groupBy("key", "epoch").agg(F.min("event_id").cast("long").alias("event_id"))
    marks = first.select("key", F.col("epoch").alias("t"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["f"].dataType).alias("f"), F.struct(F.col("epoch").cast("long").alias("epoch"), "event_id").alias("e"))
    # an event of the same second as a forecast came before it
    seen = carried(rows.unionByName(marks), "key", "t", "side", {"next": F.col("e")}, ahead=True, itself=False)
    return seen.where("side = 1").select("f.*", F.col("next.event_id").alias("event_id"), F.col("next.epoch").alias("actual"))


def applied(held: DataFrame, events: DataFrame, scored: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open rows, all scored rows and counts (stat, n) after the events up to now.

    An event takes every forecast issued before it that no earlier event took; the last issued is scored, if within its horizon
    (it comes no later than the prediction and three window widths, six hours at least), the rest are superseded.  An event already scored for a source is not scored again.
    """
    met = takers(held, events)
    waiting = met.where("event_id is null")
    still = waiting.where(F.col("issued") >= now - EXPIRY).select(held.columns)
    best = met.where("event_id is not null").groupBy("source", "key", "event_id", "actual").agg(
        F.max_by(F.struct("issued", "predicted", "opens", "closes", "inner_opens", "inner_closes"), F.struct("issued", "forecast_id")).alias("f"), (F.count(F.lit(1)) - 1).alias("superseded")
    )
    best = best.select("source", "key", "event_id", "actual", "f.*", "superseded").join(scored.select("source", "event_id"), ["source", "event_id"], "left_anti")
    width = F.col("closes") - F.col("opens")
    # only an event that comes late is beyond the horizon: then another was most likely not seen
    far = F.col("actual") > F.col("predicted") + F.coalesce(F.greatest(3 * width, F.lit(LEAST_HORIZON)), F.lit(LEAST_HORIZON))
    # to a tenth of a minute, halves away from 0
    minutes = lambda a, b: F.signum(a - b) * F.floor((F.abs(a - b) + 3) / 6) / 10 + 0.0
    error = minutes(F.col("actual"), F.col("predicted"))
    rows = best.where(~far).select(
        *("source", "key", "event_id", "actual", "issued", "predicted", "opens", "closes", "inner_opens", "inner_closes"),
        error.alias("signed_error_min"),
        F.abs(error).alias("abs_error_min"),
        minutes(F.col("actual"), F.col("issued")).alias("lead_minutes"),
        ((F.col("actual") >= F.col("opens")) & (F.col("actual") <= F.col("closes"))).alias("in_window"),
        ((F.col("actual") >= F.col("inner_opens")) & (F.col("actual") <= F.col("inner_closes"))).alias("in_inner"),
        minutes(F.col("closes"), F.col("opens")).alias("window_width_min"),
        "superseded",
    )
    kept = scored.unionByName(rows).where(F.col("actual") >= now - RETENTION)
    count = lambda name, df, n: df.agg(F.lit(name).alias("stat"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    stats = count("superseded", best, F.sum("superseded")).unionByName(count("expired", waiting.where(F.col("issued") < now - EXPIRY), F.count(F.lit(1)))).unionByName(count("beyond_horizon", best.where(far), F.count(F.lit(1))))
    return still, kept, stats


def calibrated(scored: DataFrame, since: int) -> DataFrame:
    """Scored rows of events from `since` on: forecasts made before the models were calibrated are not shown."""
    return scored.where(F.col("actual") >= since)


def identity(source: str, key: str, regime: str | None, anchor: int | None, predicted: int) -> str:
    """What tells one forecast from its recomputation: the event it starts from, or, where a neighbour's event has changed it, the minute it predicts."""
    if (regime or "base") == "base" and anchor is not None:
        return f"{source}:{key}:{anchor}"
    return f"{source}:{key}:{regime or 'base'}:{predicted // 60}"


def logged(served: DataFrame, source: str, now: int) -> DataFrame:
    """OPEN rows of served forecasts (operators.serving): those that failed, that only give context or that name no time are left out."""
    name = F.udf(lambda key, regime, anchor, predicted: identity(source, key, regime, anchor, predicted))  # a row for each series
    rows = served.where("error is null and predicted is not null and mode = 'live'")
    return rows.select(
        F.lit(source).alias("source"),
        "key",
        name("key", "regime", "anchor", "predicted").alias("forecast_id"),
        F.lit(now).cast("long").alias("issued"),
        "predicted",
        *[F.col(a).alias(b) for a, b in (("lo90", "opens"), ("hi90", "closes"), ("lo50", "inner_opens"), ("hi50", "inner_closes"))],
        F.concat_ws(", ", "model", "regime").alias("detail"),
    )


class Http:
    """A ledger's tables as one JSON document behind GET and PUT; get and put are given, so any client will do.

    get(): the document or None where there is none yet; put(text).  For ledgers of the size of a page: the rows pass the driver.
    """

    def __init__(self, spark: SparkSession, get, put, most: int = 8 << 20):
        self.spark, self.get, self.put, self.most = spark, get, put, most

    def read(self, table: str, schema: str) -> DataFrame:
        rows = json.loads(self.get() or "{}").get(table, [])
        names = [f.split()[0] for f in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    def write(self, **tables: DataFrame) -> None:
        text = json.dumps({name: [r.asDict(True) for r in df.collect()] for name, df in tables.items()})
        if len(text) > self.most:
            raise ValueError(f"a ledger of {len(text)} bytes does not belong in one document; use Store")
        self.put(text)


class Store:
    """Generations of named tables below a folder of any Hadoop file system; the newest complete one is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self.root = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.sub = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))

    def generation(self) -> int:
        """Number of the current generation; 0 if there is none."""
        if not self.fs.exists(self.root):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        return max((int(n[1:]) for n in names if n[0] == "g" and n[1:].isdigit()), default=0)

    def read(self, table: str, schema: str) -> DataFrame:
        g = self.generation()
        return self.spark.read.schema(schema).parquet(self.sub(f"g{g}", table).toString()) if g else self.spark.createDataFrame([], schema)

    def write(self, **tables: DataFrame) -> int:
        """Write a new generation, then rename it into place; the one before it stays for readers, older ones go."""
        g = self.generation() + 1
        part = self.sub(f"part-{g}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.sub(f"part-{g}", name).toString())
        if not self.fs.rename(part, self.sub(f"g{g}")):
            raise OSError(f"generation {g} was written by another")
        if g > 2:
            self.fs.delete(self.sub(f"g{g - 2}"), True)
        return g
