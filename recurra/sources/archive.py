"""Readers of raw event archives, feeds of recent entries and feeds of forecasts; what cannot be parsed becomes null, never an error.

Field names are those of the files; pass others where a feed names them otherwise.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the archive's flag columns and what they are called here.
FLAGS = {
    "has_seconds": "has_seconds",
    "exact": "exact",
    "ns": "near_start",
    "ie": "in_eruption",
    "E": "electronic",
    "A": "approximate",
    "wc": "webcam",
    "ini": "initial",
    "maj": "major",
    "min": "minor",
    "q": "questionable",
}
ENTRY = "eruptionID string, geyser string, time string, primaryID string, durationSec string, entrant string, observer string, comment string, q string, exact string, ns string, ie string, E string, A string, wc string, ini string, maj string, min string, hasSeconds string"
FORECAST = "geyserName string, userID string, comment string, prediction string, predictionID string, windowOpen string, windowClose string, expiration string, timeEntered string, intervalNumber string, futureEruptionNumber string, method string"


def known(name: str) -> Column:
    """A raw field; the word NULL and the empty text are null."""
    return F.nullif(F.nullif(F.col(f"`{name}`"), F.lit("NULL")), F.lit(""))


def whole(c: Column) -> Column:
    return c.try_cast("bigint")


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("1", "true"), F.lit(False))


def seconds(c: Column) -> Column:
    """Epoch seconds of a number or an ISO-8601 time; else null."""
    iso = F.regexp_replace(F.regexp_replace(c, "Z$", "+00:00"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.coalesce(whole(c), F.unix_seconds(iso.try_cast("timestamp")))


def tab_separated(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, without quoting; rows of the wrong width are skipped.  A .gz file is one split: repartition what follows."""
    return spark.read.option("columnPruning", False).csv(path, sep="\t", header=True, quote="", escape="", mode="DROPMALFORMED")


def events(raw: DataFrame, zone: str = "UTC") -> DataFrame:
    """Typed primary, unquestioned events with a series and a time; times before 1970 count."""
    rows = raw.select(
        whole(known("eruptionID")).alias("id"),
        F.trim(known("geyser")).alias("key"),
        whole(known("eruption_time_epoch")).alias("epoch"),
        *[F.coalesce(known(k) == "1", F.lit(False)).alias(v) for k, v in FLAGS.items()],
        known("duration").alias("duration_text"),
        known("duration_seconds").try_cast("double").alias("dur"),
        *[known(k).alias(v) for k, v in (("entrant", "entrant"), ("observer", "observer"), ("eruption_comment", "comment"))],
        *[F.timestamp_seconds(whole(known(c))).alias(c) for c in ("time_updated", "time_entered")],
        whole(known("associated_primaryID")).alias("primary_id"),
    )
    rows = rows.where("key <> '' and epoch is not null and not questionable and (primary_id is null or primary_id = id)")
    return rows.withColumn("ts_utc", F.timestamp_seconds("epoch")).withColumn("ts_local", F.from_utc_timestamp("ts_utc", zone))


def unnested(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The structs of a JSON document's list, one row each."""
    return spark.read.json(path, multiLine=True).select(F.inline(field))


def recent_entries(envelopes: DataFrame) -> DataFrame:
    """Typed primary, unquestioned entries of envelopes (entries: a list of ENTRY); works on streams too."""
    e = envelopes.select(F.inline("entries"))
    rows = e.select(
        whole(F.col("eruptionID")).alias("id"),
        F.trim("geyser").alias("key"),
        whole(F.col("time")).alias("epoch"),
        *[flag(F.col(k if k != "has_seconds" else "hasSeconds")).alias(v) for k, v in FLAGS.items()],
        F.when(F.col("durationSec").try_cast("double") > 0, F.col("durationSec").try_cast("double")).alias("dur"),
        "entrant",
        "observer",
        "comment",
        whole(F.col("primaryID")).alias("primary_id"),
    )
    return rows.where("id is not null and key <> '' and epoch is not null and not questionable and (primary_id is null or primary_id = id)")


def forecasts(rows: DataFrame, classes: dict[str, tuple[str, str | None]], series: list[str]) -> DataFrame:
    """source, key, forecast_id, issued, predicted, opens, closes and detail of a feed's forecasts (FORECAST) of next events.

    classes: for each source its user and a word its comments must hold (None: any); forecasts of no class, of no known series
    or of later events are dropped.
    """
    source = F.lit(None).cast("string")
    for name, (user, word) in classes.items():
        ok = F.col("userID") == user
        source = F.coalesce(source, F.when(ok if word is None else ok & F.contains(F.upper(F.coalesce("comment", F.lit(""))), F.lit(word.upper())), name))
    names = F.create_map(*[x for s in series for x in (F.lit(s.lower()), F.lit(s))]) if series else F.lit(None).cast("map<string,string>")
    n = F.coalesce("intervalNumber", F.lit(""))
    text = F.concat(F.coalesce(F.nullif("method", F.lit("")), F.nullif("comment", F.lit("")), F.lit("")), F.when(n.isin("", "1"), "").otherwise(F.concat(F.lit(" (interval x"), n, F.lit(")"))))
    out = rows.where(F.coalesce("futureEruptionNumber", F.lit("")).isin("", "1")).select(
        source.alias("source"),
        F.try_element_at(names, F.lower(F.trim("geyserName"))).alias("key"),
        F.nullif("predictionID", F.lit("")).alias("forecast_id"),
        seconds(F.col("timeEntered")).alias("issued"),
        seconds(F.col("prediction")).alias("predicted"),
        seconds(F.col("windowOpen")).alias("opens"),
        seconds(F.col("windowClose")).alias("closes"),
        F.substring(F.trim(text), 1, 160).alias("detail"),
    )
    return out.where("source is not null and key is not null and forecast_id is not null and issued is not null and predicted is not null")
