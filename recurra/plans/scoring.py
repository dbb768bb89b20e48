"""Forecasts matched with the events they were made for, scored, and shown: as SQL for Catalyst, and in another form for the DuckDB check.

Three sources forecast here: `mean` after each event that has gaps enough, with a window and an inner one; `last` after most of
them, without windows; `rare` only after the newest event of a series.  A fourth, `never`, has none.

An event takes every forecast that was issued before it (not at its instant) and that no earlier event took: so a forecast's taker is
the first event after its issue.  The last issued is scored, if the event is no later than its prediction by more than the horizon
(three window widths, HORIZON at least); an early event is always scored.  The rest are superseded.  Open forecasts expire after 48 hours.

The first event after an instant is looked for in the instant's own stretch of time, or else is the first of the next stretch that
has one, so no task holds a series.  Minutes are rounded to a tenth, halves away from 0.
"""

from pyspark.sql import DataFrame, SparkSession

from . import catalog

#: Six hours is the least horizon of daily cycles; those of the tables at hand take minutes.
HORIZON, EXPIRY, DAYS, CALIBRATED = 1800, 172800, 14, 259200
SOURCES = ("mean", "last", "rare", "never")


def tenths(seconds: str, div: str) -> str:
    return f"(sign({seconds}) * ((abs({seconds}) + 3) {div} 6) / 10e0 + 0e0)"


#: Forecasts as the sources make them; `hist` is the running mean and spread of 30 gaps.
MADE = """,
  @HIST@,
  made AS (SELECT 'mean' source, key, id, epoch issued, epoch + cast(floor(m * 60 + 0.123456e0) AS bigint) predicted, epoch + cast(floor((m - s) * 60 + 0.123456e0) AS bigint) opens, epoch + cast(floor((m + s) * 60 + 0.123456e0) AS bigint) closes,
           epoch + cast(floor((m - 0.5e0 * s) * 60 + 0.123456e0) AS bigint) inner_opens, epoch + cast(floor((m + 0.5e0 * s) * 60 + 0.123456e0) AS bigint) inner_closes FROM hist WHERE n >= 8
           UNION ALL SELECT 'last', key, id, epoch, epoch + cast(epoch - prev_epoch AS bigint), cast(NULL AS bigint), cast(NULL AS bigint), cast(NULL AS bigint), cast(NULL AS bigint) FROM hist WHERE n >= 8 AND id % 3 <> 0
           UNION ALL SELECT 'rare', key, id, epoch, epoch + 3600, epoch + 1800, epoch + 5400, cast(NULL AS bigint), cast(NULL AS bigint) FROM @NEWEST@),
  happened AS (SELECT key, id event_id, epoch FROM singles WHERE id % 2 = 0)"""
_WINDOWED = "avg(x) OVER w m, stddev_samp(x) OVER w s, count(x) OVER w n"
_HIST_DUCK = f"hist AS (SELECT key, id, epoch, prev_epoch, {_WINDOWED} FROM iv WINDOW w AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"
_HIST_SPARK = catalog.pieces(29).removeprefix(",") + f""",
  hist AS (SELECT key, id, epoch, prev_epoch, m, s, n FROM (SELECT *, {_WINDOWED} FROM pieces WINDOW w AS (PARTITION BY key, piece ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE rn div {catalog.PIECE} = piece)"""
_FIELDS = "id, predicted, opens, closes, inner_opens, inner_closes"

_SPARK = (
    "@CHAIN@"
    + MADE.replace("@HIST@", _HIST_SPARK).replace("@NEWEST@", "(SELECT key, top.epoch, top.id FROM (SELECT key, max(struct(epoch, id)) top FROM singles GROUP BY key))")
    + f""",
  stretches AS (SELECT key, epoch div {catalog.STRETCH} b, min(struct(epoch, event_id)) f FROM happened GROUP BY 1, 2 UNION ALL SELECT DISTINCT key, issued div {catalog.STRETCH}, cast(NULL AS struct<epoch: bigint, event_id: bigint>) FROM made),
  onward AS (SELECT key, b, min(f) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) f FROM (SELECT key, b, min(f) f FROM stretches GROUP BY key, b)),
  both AS (SELECT key, issued t, 0 side, struct(source, {_FIELDS}) p, cast(NULL AS struct<epoch: bigint, event_id: bigint>) e FROM made
           UNION ALL SELECT key, epoch, 1, NULL, struct(epoch, event_id) FROM happened),
  seen AS (SELECT key, t, t div {catalog.STRETCH} b, side, p, min(e) OVER (PARTITION BY key, t div {catalog.STRETCH} ORDER BY t DESC, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) e FROM both),
  taken AS (SELECT p.source, s.key, t issued, p.id, p.predicted, p.opens, p.closes, p.inner_opens, p.inner_closes, coalesce(s.e, o.f) e FROM seen s JOIN onward o ON s.key = o.key AND s.b = o.b WHERE side = 0),
  best AS (SELECT source, key, e.epoch actual, e.event_id event_id, max(struct(issued, {_FIELDS})) w, count(*) - 1 superseded FROM taken WHERE e IS NOT NULL GROUP BY source, key, e),
  matched AS (SELECT source, key, actual, event_id, w.*, superseded FROM best)"""
)
_DUCK = (
    "@CHAIN@"
    + MADE.replace("@HIST@", _HIST_DUCK).replace("@NEWEST@", "(SELECT * FROM singles s WHERE NOT EXISTS (FROM singles o WHERE o.key = s.key AND (o.epoch > s.epoch OR (o.epoch = s.epoch AND o.id > s.id))))")
    + f""",
  taken AS (SELECT f.*, h.epoch actual, h.event_id FROM made f ASOF LEFT JOIN happened h ON f.key = h.key AND f.issued < h.epoch),
  matched AS (SELECT source, key, actual, event_id, issued, {_FIELDS}, (SELECT count(*) FROM taken u WHERE u.source = t.source AND u.key = t.key AND u.actual = t.actual) - 1 superseded FROM taken t
    WHERE actual IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, key, actual ORDER BY issued DESC, id DESC) = 1)"""
)


def _late(div: str) -> str:
    """The reach of a forecast: whether its event came too late for it."""
    return f"actual > predicted + CASE WHEN opens IS NULL THEN {HORIZON} ELSE greatest(3 * greatest(closes - opens, 0), {HORIZON}) END"


def _scored(div: str) -> str:
    t = lambda s: tenths(s, div)
    return f""",
  scored AS (SELECT source, key, event_id, actual, issued, predicted, opens, closes, inner_opens, inner_closes, {t('(actual - predicted)')} err, abs({t('(actual - predicted)')}) abs_err, {t('(actual - issued)')} lead_min,
    CASE WHEN opens IS NOT NULL AND closes IS NOT NULL THEN actual >= opens AND actual <= closes END in_window, CASE WHEN inner_opens IS NOT NULL AND inner_closes IS NOT NULL THEN actual >= inner_opens AND actual <= inner_closes END in_inner,
    {t('(closes - opens)')} width, superseded FROM matched WHERE NOT ({_late(div)}))"""


#: What is shown of a source's scores for one series; means of tenths may lie halfway between two roundings, hence 1e-9.
_SUMMARY = """count(s.source) n, round(avg(abs_err) + 1e-9, 6) mae_min, round(@MED@(err), 6) median_signed_error_min, round(avg(CASE WHEN in_window THEN 1e0 WHEN NOT in_window THEN 0e0 END) + 1e-9, 6) in_window_rate,
  cast(sum(CASE WHEN in_window THEN 1 WHEN NOT in_window THEN 0 END) AS bigint) n_in_window, nullif(count(in_window), 0) n_windowed, round(@MED@(width), 6) median_window_width_min,
  round(@MED@((predicted - opens) / 60e0), 6) median_window_lo_min, round(@MED@((closes - predicted) / 60e0), 6) median_window_hi_min, round(avg(CASE WHEN in_inner THEN 1e0 WHEN NOT in_inner THEN 0e0 END) + 1e-9, 6) in_50_rate,
  cast(sum(CASE WHEN in_inner THEN 1 WHEN NOT in_inner THEN 0 END) AS bigint) n_in_50, nullif(count(in_inner), 0) n_inner, round(@MED@((inner_closes - inner_opens) / 60e0), 6) median_window_50_width_min"""

_BOARD_SPARK = f""",
  since AS (SELECT s.* FROM scored s JOIN (SELECT max(epoch) - {DAYS} * 86400 cut FROM ev) n ON s.actual >= n.cut),
  events AS (SELECT key, count(DISTINCT event_id) n_events FROM since GROUP BY key),
  open AS (SELECT source, key, true has_open FROM taken WHERE e IS NULL GROUP BY source, key),
  shown AS (SELECT key, explode(array({', '.join(repr(s) for s in SOURCES)})) source FROM (SELECT DISTINCT key FROM singles)),
  sums AS (SELECT d.key, d.source, {_SUMMARY.replace('@MED@', 'median')} FROM shown d LEFT JOIN since s ON d.key = s.key AND d.source = s.source GROUP BY d.key, d.source)
  SELECT sums.*, CASE WHEN n > 0 THEN 'scored' WHEN has_open THEN 'awaiting' ELSE 'none' END state, round(CASE WHEN n > 0 THEN n / (n_events * 1e0) END + 1e-9, 6) coverage, coalesce(n_events, 0) n_events
  FROM sums LEFT JOIN events ON sums.key = events.key LEFT JOIN open ON sums.key = open.key AND sums.source = open.source""".replace("SELECT sums.*, CASE", "SELECT sums.*, CASE")
_BOARD_DUCK = f""",
  since AS (SELECT * FROM scored WHERE actual >= (SELECT max(epoch) FROM ev) - {DAYS} * 86400),
  shown AS (SELECT key, unnest({list(SOURCES)}) source FROM (SELECT DISTINCT key FROM singles)),
  sums AS (SELECT d.key, d.source, {_SUMMARY.replace('@MED@', 'median')} FROM shown d LEFT JOIN since s USING (key, source) GROUP BY d.key, d.source)
  SELECT sums.*, CASE WHEN n > 0 THEN 'scored' WHEN EXISTS (FROM taken t WHERE t.key = sums.key AND t.source = sums.source AND t.actual IS NULL) THEN 'awaiting' ELSE 'none' END state,
    round(CASE WHEN n > 0 THEN n / (SELECT count(DISTINCT event_id) * 1e0 FROM since e WHERE e.key = sums.key) END + 1e-9, 6) coverage, (SELECT count(DISTINCT event_id) FROM since e WHERE e.key = sums.key) n_events FROM sums"""

PAGE, OFFSET = 20, 20
_PAGE_SPARK = f""",
  shown AS (SELECT key, event_id, max(actual) actual, max(CASE WHEN source = 'mean' THEN err END) mean_err, max(CASE WHEN source = 'mean' THEN in_window END) mean_in_window, max(CASE WHEN source = 'mean' THEN lead_min END) mean_lead_min,
    max(CASE WHEN source = 'last' THEN err END) last_err, max(CASE WHEN source = 'last' THEN lead_min END) last_lead_min, count(*) sources FROM scored GROUP BY key, event_id),
  page AS (SELECT * FROM shown ORDER BY actual DESC, event_id DESC LIMIT {PAGE} OFFSET {OFFSET})
  SELECT page.*, total, {OFFSET} + {PAGE} < total has_more FROM page JOIN (SELECT count(*) total FROM shown) t ON total > 0"""
_PAGE_DUCK = f""",
  a AS (SELECT * FROM scored WHERE source = 'mean'), b AS (SELECT * FROM scored WHERE source = 'last'),
  shown AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.event_id, b.event_id) event_id, coalesce(a.actual, b.actual) actual, a.err mean_err, a.in_window mean_in_window, a.lead_min mean_lead_min, b.err last_err, b.lead_min last_lead_min,
    (SELECT count(*) FROM scored s WHERE s.key = coalesce(a.key, b.key) AND s.event_id = coalesce(a.event_id, b.event_id)) sources FROM a FULL JOIN b ON a.key = b.key AND a.event_id = b.event_id)
  SELECT *, (SELECT count(*) FROM shown) total, {OFFSET} + {PAGE} < (SELECT count(*) FROM shown) has_more FROM shown ORDER BY actual DESC, event_id DESC LIMIT {PAGE} OFFSET {OFFSET}"""

#: name -> (Spark's text after the matches, DuckDB's), over matches or scores.
_TEXTS: dict[str, tuple[str, str]] = {
    "prediction_match": (" SELECT source, key, id, issued, actual, event_id, superseded FROM matched", " SELECT source, key, id, issued, actual, event_id, superseded FROM matched"),
    "still_open": (
        f" SELECT source, key, id, issued, predicted, now_epoch - issued > {EXPIRY} expired FROM taken JOIN (SELECT max(epoch) now_epoch FROM ev) ON now_epoch >= issued WHERE e IS NULL",
        f" SELECT source, key, id, issued, predicted, (SELECT max(epoch) FROM ev) - issued > {EXPIRY} expired FROM made f WHERE NOT EXISTS (FROM happened h WHERE h.key = f.key AND h.epoch > f.issued)",
    ),
    "beyond_horizon": (f" SELECT source, key, id, issued, predicted, actual FROM matched WHERE {_late('')}", f" SELECT source, key, id, issued, predicted, actual FROM matched WHERE {_late('')}"),
    "score_rows": ("@SCORED@ SELECT * FROM scored", "@SCORED@ SELECT * FROM scored"),
    "calibrated_scores": (
        f"@SCORED@ SELECT source, s.key, count(*) n, sum(CASE WHEN actual < begun THEN 1 ELSE 0 END) dropped FROM scored s JOIN (SELECT min(epoch) + {CALIBRATED} begun FROM ev) ON s.actual >= 0 GROUP BY source, s.key",
        f"@SCORED@, cut AS (SELECT min(epoch) + {CALIBRATED} c FROM ev) SELECT source, key, count(*) n, count(*) FILTER (WHERE actual < (SELECT c FROM cut))::HUGEINT dropped FROM scored GROUP BY source, key",
    ),
    "scoreboard": ("@SCORED@" + _BOARD_SPARK, "@SCORED@" + _BOARD_DUCK),
    "comparisons_page": ("@SCORED@" + _PAGE_SPARK, "@SCORED@" + _PAGE_DUCK),
    "comparison_days": (
        "@SCORED@ SELECT date_format(from_utc_timestamp(timestamp_seconds(actual), '@ZONE@'), 'yyyy-MM-dd') AS day_local, count(DISTINCT key, event_id) n_events FROM scored GROUP BY 1",
        "@SCORED@ SELECT strftime(timezone('@ZONE@', to_timestamp(actual)), '%Y-%m-%d') AS day_local, count(DISTINCT (key, event_id)) n_events FROM scored GROUP BY 1",
    ),
    "cap_open_per_series": (
        ", r AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY issued DESC, id DESC) k FROM made) SELECT source, key, id, issued FROM r WHERE k <= 12",
        " SELECT source, key, r.id, r.issued FROM (SELECT source, key, unnest(list({'id': id, 'issued': issued} ORDER BY issued DESC, id DESC)[1:12]) r FROM made GROUP BY source, key)",
    ),
    "forecast_identity": (
        " SELECT source, key, id, CASE WHEN source = 'last' THEN concat_ws(':', source, key, 'near', cast(predicted div 60 AS string)) ELSE concat_ws(':', source, key, cast(issued AS string)) END identity FROM made WHERE source <> 'rare'",
        " SELECT source, key, id, CASE WHEN source = 'last' THEN format('{}:{}:near:{}', source, key, predicted // 60) ELSE format('{}:{}:{}', source, key, issued) END identity FROM made WHERE source <> 'rare'",
    ),
}


def text(name: str, engine: str) -> str:
    spark = engine == "spark"
    out = (_SPARK if spark else _DUCK) + _TEXTS[name][0 if spark else 1].replace("@SCORED@", _scored("div" if spark else "//"))
    return catalog.filled(out, catalog._SPARK if spark else catalog._DUCK)


def queries() -> dict:
    def run(name):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text(name, "spark"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))

        return query

    return {name: run(name) for name in _TEXTS}


def oracle_sql() -> dict[str, str]:
    return {name: text(name, "duck") for name in _TEXTS}
