"""The calibration report in Markdown, and the data of its figures as tables.

What the report shows are aggregates, with a row for a series and model; figures are tables too: histogram, reliability and density.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.functions import dist
from recurra.operators import intervals, nowcasts, roster
from recurra.operators.pieces import kept
from recurra.plans import catalog
from recurra.service import Service


def mark(cover: float, nominal: float) -> str:
    """How far a coverage is from what it claims: a dot beyond 5 points, a sign beyond 10."""
    return " ⚠" if abs(cover - nominal) > 0.10 else " ·" if abs(cover - nominal) > 0.05 else ""


def histogram(service: Service, bins: int = 60, since: int = 0) -> DataFrame:
    """key, bin, lo, hi and n of each series' gaps between their own least and 99th percentile."""
    iv = intervals.gaps(service.spark, service.events).where(F.col("epoch") >= since)
    ends = iv.groupBy("key").agg(F.min("x").alias("a"), F.percentile("x", F.lit(0.99)).alias("b"))
    at = F.least(F.floor((F.col("x") - F.col("a")) / F.nullif((F.col("b") - F.col("a")) / bins, F.lit(0.0))), F.lit(bins - 1))
    rows = iv.join(ends, "key").where("x <= b").withColumn("bin", F.coalesce(at, F.lit(0)).cast("int"))
    width = (F.col("b") - F.col("a")) / bins
    return rows.groupBy("key", "bin", "a", "b").agg(F.count(F.lit(1)).alias("n")).select("key", "bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n")


def reliability(records: DataFrame) -> DataFrame:
    """key, model, level and share: how many outcomes lie below each of 101 levels of their forecast."""
    levels = records.select("key", "model", "pit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: k / 100)).alias("level"))
    return levels.groupBy("key", "model", "level").agg(F.avg((F.col("pit") <= F.col("level")).cast("double")).alias("share"))


def example(service: Service, key: str, points: int = 600) -> list[dict]:
    """The densities of all models for a series' newest gap, and the gap itself."""
    rows = roster.valid_gaps(intervals.gaps(service.spark, service.events)).where(F.col("key") == key)
    h = rows.orderBy(F.desc("rn")).limit(roster.HISTORY + 1).toPandas().sort_values("rn").reset_index(drop=True)
    if len(h) < 400:
        return []
    past, row, out = h.iloc[:-1], h.iloc[-1], []
    for name in roster.models_for(key, service.series):
        d = roster.MODELS[name][0]()(past, row)
        if d is not None:
            if not out:
                lo, hi = (float(d.ppf(q)) for q in (0.001, 0.999))
                grid = dist.np.linspace(max(lo * 0.6, 1.0), hi * 1.25, points)
            out.append({"model": name, "actual": float(row["x"]), "x": grid.tolist(), "density": d.pdf(grid).tolist()})
    return out


def write(service: Service, days: int = 20, nowcast: bool = True) -> str:
    """The report's text."""
    iv = kept(intervals.gaps(service.spark, service.events))
    judged = kept(intervals.labels(iv).select("key", "id", "epoch", "x", "is_valid"))
    records = kept(roster.walk_forward(iv, days, service.now))
    rows = sorted((r.asDict() for r in roster.scores(records).collect()), key=lambda r: (r["key"], r["place"]))
    out = ["# Calibration report", "", f"Walk-forward backtest of the last {days} days. A model sees only gaps before the one it forecasts, and all models of a series are scored on the same gaps.", ""]
    out += ["| series | model | n | CRPS | MAE | 50 % | 90 % |", "|-|-|-|-|-|-|-|"]
    for r in rows:
        name = f"**{r['model']}**" if r["place"] == 1 else r["model"]
        out.append(f"| {r['key']} | {name} | {r['n']:,} | {r['crps']:.1f} | {r['mae']:.1f} | {r['cover50']:.1%}{mark(r['cover50'], 0.5)} | {r['cover90']:.1%}{mark(r['cover90'], 0.9)} |")
    best = [r for r in rows if r["place"] == 1]
    out += ["", "## Which model wins", "", "| series | model | CRPS | gain over the rolling normal |", "|-|-|-|-|"]
    out += [f"| {r['key']} | {r['model']} | {r['crps']:.1f} | {'n/a' if r['gain_pct'] is None else format(r['gain_pct'], '.1f') + ' %'} |" for r in best]
    out += ["", "## Known gaps", ""]
    gaps = [f"- **{r['key']}**: the 50 % interval of {r['model']} covers {r['cover50']:.0%}: {'too wide' if r['cover50'] > 0.5 else 'too sure'}." for r in best if abs(r["cover50"] - 0.5) > 0.10]
    gaps += [f"- **{r['key']}**: the 90 % interval of {r['model']} covers {r['cover90']:.0%}." for r in best if abs(r["cover90"] - 0.9) > 0.07]
    out += gaps or ["- No best model misses its coverage by more than 10 points at 50 % or 7 at 90 %."]
    places = [(r["key"], r["place"], sum(1 for o in rows if o["key"] == r["key"])) for r in rows if r["model"] == "weibull_aft"]
    if places:
        out.append(f"- The model with covariates is in the worse half for {sum(1 for _, p, n in places if p > n / 2)} of {len(places)} series.")
    honest = nowcasts.coverage_over_all(judged.drop("is_valid").join(iv.select("key", "id", "regime"), ["key", "id"])).orderBy("key").collect()
    plain = {r["key"]: r["cover90"] for r in rows if r["model"] == "lognormal"}
    out += ["", "## Coverage over all gaps, also those that are not genuine", "", "| series | n | not genuine | 50 % | 90 % | 90 % of genuine ones |", "|-|-|-|-|-|-|"]
    out += [f"| {r['key']} | {r['n']:,} | {r['filtered_pct']:.1f} % | {r['cover50']:.1%} | {r['cover90']:.1%} | {format(plain[r['key']], '.1%') if r['key'] in plain else 'n/a'} |" for r in honest]
    if nowcast:
        paired = nowcasts.backtest(nowcasts.nowcasts(judged, triggers=(1, 4, 8), least=300)).orderBy("key", F.col("regime") != "overall", "regime").collect()
        out += ["", "## With and without neighbours", "", "| series | regime | n | CRPS without | with | change | 90 % without | with |", "|-|-|-|-|-|-|-|-|"]
        out += [f"| {r['key']} | {r['regime']} | {r['n']:,} | {r['crps_off']:.1f} | {r['crps']:.1f} | {r['crps_delta_pct'] or 0:+.1f} % | {r['cover90_off']:.0%} | {r['cover90']:.0%} |" for r in paired]
    total, valid = judged.agg(F.count(F.lit(1)), F.count_if("is_valid")).first()
    out += ["", "## Data", "", f"- Of {total:,} gaps {valid:,} ({100 * valid / max(total, 1):.1f} %) are genuine."]
    mix = service.spark.sql(catalog.text("entry_mix", catalog._SPARK), events=service.events).orderBy("key").collect()
    out += [f"- {r['key']}: {r['electronic_pct']} % by instruments, {r['minor_pct']} % minor." for r in mix]
    return "\n".join(out) + "\n"
