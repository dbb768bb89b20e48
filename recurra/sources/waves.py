"""Amplitudes of recorded waves: the median of each record is taken off, and a minute counts if it has samples enough."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: samples that a minute needs.
LEAST_SAMPLES = 1500


def minute_rms(samples: DataFrame, least: int = LEAST_SAMPLES) -> DataFrame:
    """station, m (epoch minute), rms and n from samples (station, record, ts, sample); decoding a recorder's files is the reader's work.

    A record is a stretch of some seconds, so its median is taken in a small group; null samples do not count.
    """
    there = samples.where("sample IS NOT NULL AND ts IS NOT NULL")
    middle = there.groupBy("station", "record").agg(F.median("sample").alias("middle"))
    level = there.join(middle, ["station", "record"]).withColumn("level", F.col("sample") - F.col("middle"))
    got = level.groupBy("station", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("m")).agg(F.sqrt(F.avg(F.col("level") * F.col("level"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return got.where(F.col("n") >= least)


def queries() -> dict:
    return {"wave_rms": wave_rms}


def wave_rms(spark, sf_dir: str) -> DataFrame:
    """Minutes of ten hours of the table at hand: a record is a day of a station, and three samples are enough."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IS NOT NULL")
    samples = ev.select(F.col("event_type").alias("station"), F.to_date("ts").alias("record"), F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) * 60).alias("ts"), F.col("value").alias("sample"))
    return minute_rms(samples, 2).withColumn("rms", F.round("rms", 6))


def oracle_sql() -> dict[str, str]:
    return {
        "wave_rms": """WITH s AS (SELECT event_type station, cast(ts AS date) record, cast(floor(epoch_us(ts) / 600e6) AS bigint) m, value FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL),
      d AS (SELECT *, value - median(value) OVER (PARTITION BY station, record) x FROM s) SELECT station, m, round(sqrt(avg(x * x)), 6) rms, count(*) n FROM d GROUP BY station, m HAVING count(*) >= 2"""
    }
