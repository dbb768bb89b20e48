"""Weighted samples as tables: quantiles, shares at or below a value, and the ranked probability score of an outcome.

Samples are rows of key, x (above 0) and w.  Equal values are added up first; running sums work in bins of values, an eighth of a
doubling wide, and what a bin needs of those below it is one row of a small table with a row for each bin, so no task holds a key.
Null or negative weights count as 0; keys without weight have no rows.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.plans import catalog

from .intervals import gaps
from .pieces import numbered

PER_DOUBLING, HALF_LIFE = 8, 200


def running(samples: DataFrame) -> DataFrame:
    """key, x, c (the share of the weight at or below x) and the value and share before it (null: it is the first), of distinct values."""
    w = F.greatest(F.coalesce(F.col("w").cast("double"), F.lit(0.0)), F.lit(0.0))
    each = samples.groupBy("key", "x").agg(F.sum(w).alias("w")).where("w > 0").withColumn("bin", F.floor(F.log2("x") * PER_DOUBLING))
    below = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = each.groupBy("key", "bin").agg(F.sum("w").alias("held"), F.max("x").alias("top"))
    bins = bins.select("key", "bin", F.coalesce(F.sum("held").over(below), F.lit(0.0)).alias("under"), F.max("top").over(below).alias("x_under"), F.sum("held").over(Window.partitionBy("key")).alias("total"))
    own = Window.partitionBy("key", "bin").orderBy("x")
    rows = each.join(bins, ["key", "bin"])
    upto = F.col("under") + F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("key", "x", (upto / F.col("total")).alias("c"), F.coalesce(F.lag("x").over(own), F.col("x_under")).alias("x_before"), ((upto - F.col("w")) / F.col("total")).alias("c_before"))
    return rows.withColumn("c_before", F.when(F.col("x_before").isNotNull(), F.col("c_before")))


def quantiles(samples: DataFrame, levels: list[float]) -> DataFrame:
    """key, level and value: between two values by a straight line over their shares; below the first share, the least value."""
    level = F.explode(F.filter(F.array(*[F.lit(float(q)) for q in levels]), lambda q: ((F.col("c_before").isNull()) | (q > F.col("c_before"))) & (q <= F.col("c"))))
    line = F.col("x_before") + (F.col("level") - F.col("c_before")) / (F.col("c") - F.col("c_before")) * (F.col("x") - F.col("x_before"))
    return running(samples).withColumn("level", level).select("key", "level", F.coalesce(line, F.col("x")).alias("value"))


def scores(samples: DataFrame, outcomes: DataFrame) -> DataFrame:
    """key, y, share (of the weight at or below y) and crps (E|X - y| less half of E|X - X'|) of outcomes (key, y: a row for each key)."""
    rows = running(samples).join(outcomes, "key")
    step = F.col("x") - F.col("x_before")
    weight = F.col("c") - F.coalesce("c_before", F.lit(0.0))
    return rows.groupBy("key", "y").agg(
        F.coalesce(F.max(F.when(F.col("x") <= F.col("y"), F.col("c"))), F.lit(0.0)).alias("share"),
        (F.sum(weight * F.abs(F.col("x") - F.col("y"))) - F.sum(F.coalesce(F.col("c_before") * (1 - F.col("c_before")) * step, F.lit(0.0)))).alias("crps"),
    )


def _recent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each series' gaps but the newest, whose weights halve every HALF_LIFE gaps, and the newest as the outcome."""
    rows = numbered(gaps(spark, spark.read.parquet(f"{sf_dir}/events.parquet")).select("key", "id", "epoch", "x"), "key")
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(size, "key").withColumn("back", F.col("size") - 1 - F.col("rn"))
    return rows.where("back > 0").select("key", "x", F.pow(F.lit(0.5), F.col("back") / HALF_LIFE).alias("w")), rows.where("back = 0").select("key", F.col("x").alias("y"))


def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(_recent(spark, sf_dir)[0], [0.05, 0.25, 0.5, 0.75, 0.95]).select("key", "level", F.round("value", 5).alias("value"))


def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, outcomes = _recent(spark, sf_dir)
    return scores(samples, outcomes).select("key", *[F.round(c, 5).alias(c) for c in ("y", "share", "crps")])


def queries() -> dict:
    return {f.__name__: f for f in (weighted_quantiles, sample_scores)}


_SAMPLES = f"""@CHAIN@, r AS (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, id DESC) - 1 back FROM iv), s AS (SELECT key, x, pow(0.5e0, back / {HALF_LIFE}e0) w FROM r WHERE back > 0),
  y AS (SELECT key, x y FROM r WHERE back = 0)"""


def oracle_sql() -> dict[str, str]:
    steps = """, e AS (SELECT key, x, sum(w) w FROM s GROUP BY key, x), c AS (SELECT key, x, sum(w) OVER (PARTITION BY key ORDER BY x) / sum(w) OVER (PARTITION BY key) c FROM e),
  p AS (SELECT *, lag(x) OVER w px, lag(c) OVER w pc FROM c WINDOW w AS (PARTITION BY key ORDER BY x))
  SELECT key, level, round(coalesce(px + (level - pc) / (c - pc) * (x - px), x), 5) AS value FROM p, (VALUES (0.05e0), (0.25e0), (0.5e0), (0.75e0), (0.95e0)) q(level) WHERE (pc IS NULL OR level > pc) AND level <= c"""
    pairs = """, n AS (SELECT key, x, w / sum(w) OVER (PARTITION BY key) w FROM s)
  SELECT y.key, round(y, 5) y, round(sum(CASE WHEN x <= y THEN w ELSE 0 END), 5) AS share, round(sum(w * abs(x - y)) - 0.5e0 * (SELECT sum(a.w * b.w * abs(a.x - b.x)) FROM n a JOIN n b ON a.key = b.key WHERE a.key = y.key), 5) crps
  FROM y JOIN n ON n.key = y.key GROUP BY y.key, y.y"""
    return {name: catalog.filled(_SAMPLES + text, catalog._DUCK) for name, text in (("weighted_quantiles", steps), ("sample_scores", pairs))}
