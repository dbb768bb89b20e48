"""Relational operators of the engine as SQL that Catalyst plans, and SQL of another form that checks it elsewhere.

The point process is `ev`: one row an event with id, key, epoch (seconds), dur, minor, electronic, initial and user_id.
Ties on time are broken by id everywhere.  "Now" is always the newest event, never the clock.

Chains, running sums and as-of look-ups work in stretches of STRETCH seconds of a series: what they need of the time before or after a
stretch is one row of a small table with a row for each stretch.  Windows of some minutes get the rows of that many minutes around
their stretch, windows of some rows work in pieces of PIECE rows with those before.  So no task holds a series.
"""

from pyspark.sql import DataFrame, SparkSession

ZONE = "America/Denver"
STRETCH = 86400
_SPARK = {
    "EV": f"""SELECT event_id id, trim(event_type) key, unix_seconds(cast(ts AS timestamp)) epoch, value dur, user_id,
      coalesce(try_cast(get_json_object(props, '$.k') AS int) % 10 < 3, false) minor, coalesce(try_cast(get_json_object(props, '$.k') AS int) % 4 = 0, false) electronic,
      coalesce(try_cast(get_json_object(props, '$.k') AS int) % 5 = 0, false) initial, from_utc_timestamp(cast(ts AS timestamp), '{ZONE}') lts FROM {{events}}
      WHERE event_type IS NOT NULL AND trim(event_type) <> '' AND ts IS NOT NULL""",
    "PCT": "percentile",
    "DAY": "date_format(lts, 'yyyy-MM-dd')",
}
_DUCK = {
    "EV": f"""SELECT event_id id, trim(event_type) AS key, cast(floor(epoch_us(ts) / 1000000) AS bigint) epoch, value dur, user_id,
      coalesce(try_cast(json_extract_string(props, '$.k') AS int) % 10 < 3, false) minor, coalesce(try_cast(json_extract_string(props, '$.k') AS int) % 4 = 0, false) electronic,
      coalesce(try_cast(json_extract_string(props, '$.k') AS int) % 5 = 0, false) initial, timezone('{ZONE}', timezone('UTC', ts)) lts FROM events
      WHERE event_type IS NOT NULL AND trim(event_type) <> '' AND ts IS NOT NULL""",
    "PCT": "quantile_cont",
    "DAY": "strftime(lts, '%Y-%m-%d')",
}

#: Events less than 61 s after the one before them are reports of the same; gaps carry what came before them.
_SPARK["CHAIN"] = f"""WITH ev AS ({_SPARK['EV']}),
  cut AS (SELECT *, epoch div {STRETCH} b FROM ev),
  before_cut AS (SELECT key, b, lag(top) OVER (PARTITION BY key ORDER BY b) carried FROM (SELECT key, b, max(epoch) top FROM cut GROUP BY key, b)),
  near AS (SELECT cut.*, coalesce(lag(epoch) OVER (PARTITION BY cut.key, cut.b ORDER BY epoch, id), carried) before FROM cut JOIN before_cut c ON cut.key = c.key AND cut.b = c.b),
  singles AS (SELECT * FROM near WHERE before IS NULL OR epoch - before > 60),
  before_singles AS (SELECT key, b, lag(top) OVER (PARTITION BY key ORDER BY b) carried FROM (SELECT key, b, max(struct(epoch, id, dur, minor, electronic, initial, lts)) top FROM singles GROUP BY key, b)),
  linked AS (SELECT s.*, coalesce(lag(struct(epoch, id, dur, minor, electronic, initial, lts)) OVER (PARTITION BY s.key, s.b ORDER BY epoch, id), carried) p FROM singles s JOIN before_singles c ON s.key = c.key AND s.b = c.b),
  seq AS (SELECT *, p.epoch prev_epoch, p.dur prev_dur, p.minor prev_minor, p.electronic prev_electronic, p.initial prev_initial, p.lts prev_lts FROM linked),
  iv AS (SELECT *, (epoch - prev_epoch) / 60e0 x FROM seq WHERE prev_epoch IS NOT NULL AND epoch > prev_epoch)"""
_DUCK["CHAIN"] = f"""WITH ev AS ({_DUCK['EV']}),
  singles AS (SELECT * FROM ev QUALIFY coalesce(epoch - lag(epoch) OVER (PARTITION BY key ORDER BY epoch, id) > 60, true)),
  seq AS (SELECT *, lag(epoch) OVER w prev_epoch, lag(dur) OVER w prev_dur, lag(minor) OVER w prev_minor, lag(electronic) OVER w prev_electronic, lag(initial) OVER w prev_initial, lag(lts) OVER w prev_lts
          FROM singles WINDOW w AS (PARTITION BY key ORDER BY epoch, id)),
  iv AS (SELECT *, (epoch - prev_epoch) / 60e0 x FROM seq WHERE prev_epoch IS NOT NULL AND epoch > prev_epoch)"""
_SPARK["ZONE"] = _DUCK["ZONE"] = ZONE
_SPARK["STRETCH"] = str(STRETCH)
CHAIN = "@CHAIN@"
#: Series whose minor events are no part of their cycle: left out before gaps are taken; and series whose phase is lost, after so many cycles.
NOT_CYCLE, PHASE = ("error", "signup"), {"view": 2.5}
for _engine in (_SPARK, _DUCK):
    _engine["CYCLES"] = _engine["CHAIN"].replace(_engine["EV"], f"SELECT * FROM ({_engine['EV']}) e WHERE NOT (key IN {NOT_CYCLE} AND minor)")
MINUTES = """WITH raw AS (@EV@), rms AS (SELECT cast(floor(epoch / 60e0) AS bigint) m, sqrt(avg(dur * dur)) v, count(*) n FROM raw GROUP BY 1)"""


PIECE = 20_000


def pieces(window: int, of: str = "iv") -> str:
    """CTE `pieces` (Spark): the rows of a series numbered (rn) by stretches of time and cut into pieces of PIECE rows, each with the `window` rows before it.

    A piece's own rows have rn div PIECE = piece; windows of up to that many rows before are whole for them.
    """
    return f""", cut_{of} AS (SELECT *, floor(epoch / {STRETCH}) stretch FROM {of}),
  held_{of} AS (SELECT key, stretch, (sum(n) OVER (PARTITION BY key ORDER BY stretch)) - n earlier FROM (SELECT key, stretch, count(*) n FROM cut_{of} GROUP BY key, stretch)),
  placed AS (SELECT i.*, earlier + row_number() OVER (PARTITION BY i.key, i.stretch ORDER BY epoch, id) - 1 rn FROM cut_{of} i JOIN held_{of} h ON i.key = h.key AND i.stretch = h.stretch),
  pieces AS (SELECT *, explode(sequence(rn div {PIECE}, (rn + {window}) div {PIECE})) piece FROM placed)"""


_Z50, _Z90 = "0.674489750196082e0", "1.644853626951473e0"
#: Two models' forecasts of each gap from those before it, and those gaps that both have forecast.
_TWO = (
    CHAIN
    + pieces(100)
    + f""", fit AS (SELECT key, id, x, rn, piece, avg(x) OVER near m, greatest(stddev_samp(x) OVER near, 1e-3) s, count(*) OVER near n, avg(ln(x)) OVER far lm, stddev_samp(ln(x)) OVER far ls, count(*) OVER far ln FROM pieces
    WINDOW near AS (PARTITION BY key, piece ORDER BY rn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), far AS (PARTITION BY key, piece ORDER BY rn ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
  made AS (SELECT key, id, x, filter(array(
    CASE WHEN n >= 8 THEN struct('rolling_normal' AS model, m AS mid, m - {_Z50} * s AS lo50, m + {_Z50} * s AS hi50, m - {_Z90} * s AS lo90, m + {_Z90} * s AS hi90) END,
    CASE WHEN ln >= 12 THEN struct('lognormal' AS model, exp(lm) AS mid, exp(lm - {_Z50} * ls) AS lo50, exp(lm + {_Z50} * ls) AS hi50, exp(lm - {_Z90} * ls) AS lo90, exp(lm + {_Z90} * ls) AS hi90) END), f -> f IS NOT NULL) each
    FROM fit WHERE rn div {PIECE} = piece),
  common AS (SELECT key, id, x, inline(each) FROM made WHERE size(each) = 2)"""
)


def _duck_windowed(window: int, log: bool) -> str:
    v = "ln(x)" if log else "x"
    w = f"PARTITION BY key ORDER BY epoch, id ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING"
    return CHAIN + f", fit AS (SELECT key, id, epoch, x, avg({v}) OVER w mean, stddev_samp({v}) OVER w sd, count(*) OVER w n FROM iv WINDOW w AS ({w})) "


_DUCK_TWO = (
    _duck_windowed(30, False)
    + ", lfit AS (SELECT key, id, x, avg(ln(x)) OVER w mean, stddev_samp(ln(x)) OVER w sd, count(*) OVER w n FROM iv WINDOW w AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),"
    " pred AS (SELECT 'rolling_normal' model, key, id, x, mean mid, mean - 0.674489750196082e0 * greatest(sd, 1e-3) lo50, mean + 0.674489750196082e0 * greatest(sd, 1e-3) hi50, mean - 1.644853626951473e0 * greatest(sd, 1e-3) lo90,"
    " mean + 1.644853626951473e0 * greatest(sd, 1e-3) hi90 FROM fit WHERE n >= 8 UNION ALL SELECT 'lognormal', key, id, x, exp(mean), exp(mean - 0.674489750196082e0 * sd), exp(mean + 0.674489750196082e0 * sd), exp(mean - 1.644853626951473e0 * sd),"
    " exp(mean + 1.644853626951473e0 * sd) FROM lfit WHERE n >= 12),"
    " common AS (SELECT id FROM pred GROUP BY id HAVING count(DISTINCT model) = 2)"
)
_GRID = "grid AS (SELECT DISTINCT key, cast(floor(epoch / 1800e0) AS bigint) * 1800 t FROM ev)"

CATALOG: dict[str, str] = {
    "typed_events": "WITH ev AS (@EV@) SELECT id, key, epoch, dur, user_id, minor, electronic, initial, cast(hour(lts) AS int) hour_local, cast(month(lts) AS int) month_local, cast(year(lts) AS int) year_local FROM ev",
    "dedupe_gaps": CHAIN + " SELECT id, key, epoch FROM singles",
    "lag_chain": CHAIN + " SELECT id, key, epoch, prev_epoch, prev_dur, coalesce(prev_minor, false) prev_minor, coalesce(prev_electronic, false) prev_electronic, coalesce(prev_initial, false) prev_initial, coalesce(cast(hour(prev_lts) AS int), 12) prev_hour, coalesce(cast(dayofyear(prev_lts) AS int), 180) prev_day, coalesce(prev_dur >= 150, false) prev_long FROM seq",
    "cycle_intervals": "@CYCLES@ SELECT key, id, epoch, round(x, 6) x FROM iv",
    "whole_dedupe": """WITH ev AS (@EV@), u AS (SELECT DISTINCT key, epoch FROM (SELECT key, epoch FROM ev UNION ALL SELECT key, epoch + 30 epoch FROM ev WHERE id % 11 = 0)),
      c AS (SELECT key, epoch, floor(epoch / @STRETCH@) d FROM u), l AS (SELECT key, d, lag(top) OVER (PARTITION BY key ORDER BY d) carried FROM (SELECT key, d, max(epoch) top FROM c GROUP BY key, d)),
      s AS (SELECT c.key, epoch, coalesce(lag(epoch) OVER (PARTITION BY c.key, c.d ORDER BY epoch), carried) before FROM c JOIN l ON c.key = l.key AND c.d = l.d) SELECT key, epoch FROM s WHERE before IS NULL OR epoch - before > 60""",
    "already_scored": CHAIN
    + """, again AS (SELECT key, id FROM singles WHERE id % 2 = 0 UNION ALL SELECT key, id FROM singles WHERE id % 3 = 0), held AS (SELECT key, id FROM singles WHERE id % 3 = 0)
      SELECT DISTINCT a.key, a.id FROM again a LEFT ANTI JOIN held h ON a.key = h.key AND a.id = h.id""",
    "source_classes": """WITH ev AS (@EV@), c AS (SELECT id, key, CASE WHEN user_id % 5 = 0 AND upper(concat('by ', key)) LIKE '%CLICK%' THEN 'a' WHEN user_id % 5 = 1 THEN 'b' END source FROM ev)
      SELECT coalesce(source, 'dropped') source, count(*) n FROM c GROUP BY 1""",
    "raw_intervals": CHAIN
    + f""", c AS (SELECT *, floor(epoch / {STRETCH}) d FROM iv), l AS (SELECT key, d, lag(top) OVER (PARTITION BY key ORDER BY d) carried FROM (SELECT key, d, max(struct(epoch, id, x)) top FROM c GROUP BY key, d))
      SELECT id, c.key, epoch, round(x, 6) interval_min, round(coalesce(lag(x) OVER (PARTITION BY c.key, c.d ORDER BY epoch, id), carried.x), 6) prev_interval_min FROM c JOIN l ON c.key = l.key AND c.d = l.d""",
    "interval_stats": CHAIN
    + " SELECT key, count(*) n, round(@PCT@(x, 0.5), 6) median, round(avg(x), 6) mean, round(stddev_samp(x), 6) sd, round(@PCT@(x, 0.05), 6) p05, round(@PCT@(x, 0.95), 6) p95, cast(min(year(lts)) AS int) first_year, cast(max(year(lts)) AS int) last_year FROM iv GROUP BY key",
    "trailing_stats": CHAIN + " SELECT key, count(*) n, round(@PCT@(x, 0.5), 6) median, round(avg(x), 6) mean FROM iv WHERE epoch >= (SELECT max(epoch) FROM ev) - 604800 GROUP BY key",
    "regime_counts": CHAIN + " SELECT key, coalesce(prev_minor, false) regime_minor, count(*) n, round(@PCT@(x, 0.25), 6) p25, round(@PCT@(x, 0.75), 6) p75 FROM iv GROUP BY 1, 2",
    "entry_mix": CHAIN
    + " SELECT key, count(*) n, round(100 * avg(CASE WHEN electronic THEN 1e0 ELSE 0e0 END), 1) electronic_pct, round(100 * avg(CASE WHEN minor THEN 1e0 ELSE 0e0 END), 1) minor_pct FROM iv GROUP BY key",
    "basin_activity_range": f"""WITH ev AS (@EV@), c AS (SELECT epoch, floor(epoch / {STRETCH}) b, count(*) n FROM ev GROUP BY epoch),
      held AS (SELECT epoch, b, n, 0 halo FROM c UNION ALL SELECT epoch, b + 1, n, 1 FROM c WHERE pmod(epoch, {STRETCH}) > {STRETCH} - 2700),
      s AS (SELECT epoch, halo, sum(n) OVER (PARTITION BY b ORDER BY epoch RANGE BETWEEN 2699 PRECEDING AND CURRENT ROW) seen FROM held)
      SELECT id, cast(seen AS bigint) seen FROM ev JOIN s ON ev.epoch = s.epoch AND halo = 0""",
    "latest_two": "WITH ev AS (@EV@), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, id DESC) n FROM ev) SELECT key, id, epoch, cast(n AS bigint) n FROM r WHERE n <= 2",
    "recent_gaps": """WITH ev AS (@EV@), t AS (SELECT DISTINCT key, epoch FROM ev WHERE NOT minor), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC) n FROM t),
      g AS (SELECT key, (lag(epoch) OVER (PARTITION BY key ORDER BY epoch DESC) - epoch) / 60e0 x FROM r WHERE n <= 9)
      SELECT key, count(x) n, round(min(x), 6) least, round(@PCT@(x, 0.5), 6) median, round(max(x), 6) most FROM g GROUP BY key""",
    "union_latest_wins": """WITH ev AS (@EV@), u AS (SELECT id, key, epoch, dur, 0 live FROM ev UNION ALL SELECT id, key, epoch, dur + 1 dur, 1 live FROM ev WHERE id % 7 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY live DESC) n FROM u) SELECT id, key, epoch, round(dur, 6) dur, live FROM r WHERE n = 1""",
    "asof_backward": "WITH ev AS (@EV@), " + _GRID + f""", u AS (SELECT key, t, t div {STRETCH} b, 1 side, cast(NULL AS bigint) e FROM grid UNION ALL SELECT key, epoch, epoch div {STRETCH}, 0, epoch FROM ev),
      c AS (SELECT key, b, max(top) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) carried FROM (SELECT key, b, max(e) top FROM u GROUP BY key, b)),
      a AS (SELECT key, t, b, side, max(e) OVER (PARTITION BY key, b ORDER BY t, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) e FROM u)
      SELECT a.key, t, coalesce(e, carried) last_epoch FROM a JOIN c ON a.key = c.key AND a.b = c.b WHERE side = 1""",
    "asof_forward": "WITH ev AS (@EV@), " + _GRID + f""", u AS (SELECT key, t, t div {STRETCH} b, 0 side, cast(NULL AS bigint) e FROM grid UNION ALL SELECT key, epoch, epoch div {STRETCH}, 1, epoch FROM ev),
      c AS (SELECT key, b, min(top) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) carried FROM (SELECT key, b, min(e) top FROM u GROUP BY key, b)),
      a AS (SELECT key, t, b, side, min(e) OVER (PARTITION BY key, b ORDER BY t DESC, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) e FROM u),
      n AS (SELECT a.key, t, coalesce(e, carried) next_epoch FROM a JOIN c ON a.key = c.key AND a.b = c.b WHERE side = 0)
      SELECT key, t, next_epoch, CASE WHEN next_epoch <= t + 1800 THEN next_epoch END within_half_hour FROM n""",
    "interval_semi": "WITH ev AS (@EV@), " + _GRID + """, u AS (SELECT key, t, 0 side, 0 hit FROM grid UNION ALL SELECT 'click', epoch, 1, 1 FROM ev WHERE key = 'error'),
      held AS (SELECT *, floor(t / @STRETCH@) d FROM u UNION ALL SELECT *, floor(t / @STRETCH@) - 1 FROM u WHERE side = 1 AND pmod(t, @STRETCH@) <= 600),
      a AS (SELECT key, t, side, sum(hit) OVER (PARTITION BY key, d ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 600 FOLLOWING) hits FROM held) SELECT key, t FROM a WHERE side = 0 AND hits > 0""",
    "live_signals": """WITH ev AS (@EV@), rules AS (SELECT 'error' key, 'purchase' target, 3600 lookback UNION ALL SELECT 'signup', 'view', 7200 UNION ALL SELECT 'click', 'purchase', 60),
      latest AS (SELECT key, max(epoch) newest FROM ev GROUP BY key) SELECT r.key, r.target, l.newest, n.now_epoch - l.newest age_s FROM rules r JOIN latest l ON r.key = l.key JOIN (SELECT max(epoch) now_epoch FROM ev) n ON n.now_epoch - l.newest <= r.lookback""",
    "common_eval_set": _TWO + " SELECT model, key, count(*) n FROM common GROUP BY 1, 2",
    "coverage_by_model": _TWO
    + """ SELECT model, key, count(*) n, round(avg(abs(x - mid)), 6) mae, round(avg(CASE WHEN x BETWEEN lo50 AND hi50 THEN 1e0 ELSE 0e0 END), 6) cover50,
      round(avg(CASE WHEN x BETWEEN lo90 AND hi90 THEN 1e0 ELSE 0e0 END), 6) cover90, round(avg(mid), 6) mean_median FROM common GROUP BY 1, 2""",
    "model_rank": _TWO
    + """, m AS (SELECT model, key, avg(abs(x - mid)) mae FROM common GROUP BY 1, 2)
      SELECT a.key, a.model, cast(rank() OVER (PARTITION BY a.key ORDER BY round(a.mae, 9)) AS bigint) place, round(100 * (b.mae - a.mae) / b.mae, 3) gain_pct FROM m a JOIN m b ON a.key = b.key AND b.model = 'rolling_normal'""",
    "day_counts": "WITH ev AS (@EV@) SELECT @DAY@ AS day_local, count(*) n FROM ev GROUP BY 1",
    "gap_histogram": CHAIN + ", b AS (SELECT key, least(59, cast(floor(x / 2e0) AS int)) bin FROM iv) SELECT key, bin, count(*) n FROM b GROUP BY 1, 2",
    "minute_rms": MINUTES + " SELECT m, round(v, 6) rms, n FROM rms",
    "fire_candidates": MINUTES.replace("SELECT cast", "SELECT key station, cast").replace("GROUP BY 1", "GROUP BY 1, 2").replace("/ 60e0", "/ 600e0")
    + """, held AS (SELECT *, floor(m / 1440) d, 0 halo FROM rms UNION ALL SELECT *, floor(m / 1440) + 1, 1 FROM rms WHERE pmod(m, 1440) >= 1080 UNION ALL SELECT *, floor(m / 1440) - 1, 1 FROM rms WHERE pmod(m, 1440) < 2),
      w AS (SELECT station, m, halo, min(v) OVER f least_next, count(*) OVER f n_next, @PCT@(v, 0.5) OVER b base, count(*) OVER b n_base FROM held
      WINDOW f AS (PARTITION BY station, d ORDER BY m RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY station, d ORDER BY m RANGE BETWEEN 360 PRECEDING AND 1 PRECEDING))
      SELECT station, m, round(least_next, 6) least_next, round(base, 6) base FROM w WHERE halo = 0 AND n_next = 3 AND n_base >= 60 AND least_next >= 1.2e0 * base""",
    "regional_veto": """WITH ev AS (@EV@), st AS (SELECT key station, cast(floor(epoch / 60e0) AS bigint) m, sqrt(avg(dur * dur)) v FROM ev WHERE key IN ('view', 'click') GROUP BY 1, 2),
      fires AS (SELECT DISTINCT cast(floor(epoch / 3600e0) AS bigint) * 60 m FROM ev),
      u AS (SELECT station, m, v, 0 fire FROM st UNION ALL SELECT 'view', m, cast(NULL AS double), 1 FROM fires UNION ALL SELECT 'click', m, cast(NULL AS double), 1 FROM fires),
      held AS (SELECT *, floor(m / 1440) d, 0 halo FROM u UNION ALL SELECT *, floor(m / 1440) + 1, 1 FROM u WHERE fire = 0 AND pmod(m, 1440) >= 1260 UNION ALL SELECT *, floor(m / 1440) - 1, 1 FROM u WHERE fire = 0 AND pmod(m, 1440) < 14),
      w AS (SELECT station, m, fire * (1 - halo) fire, @PCT@(v, 0.5) OVER (PARTITION BY station, d ORDER BY m RANGE BETWEEN 180 PRECEDING AND 11 PRECEDING) base, @PCT@(v, 0.5) OVER (PARTITION BY station, d ORDER BY m RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) now FROM held),
      s AS (SELECT m, max(CASE WHEN station = 'view' THEN now / greatest(base, 1e0) END) first_shift, max(CASE WHEN station = 'click' THEN now / greatest(base, 1e0) END) next_shift FROM w WHERE fire = 1 AND base IS NOT NULL AND now IS NOT NULL GROUP BY m)
      SELECT f.m, CASE WHEN first_shift IS NOT NULL THEN 'view' WHEN next_shift IS NOT NULL THEN 'click' END station, round(coalesce(first_shift, next_shift), 6) shift, coalesce(coalesce(first_shift, next_shift) >= 3, false) vetoed
      FROM fires f LEFT JOIN s ON f.m = s.m""",
    "season_gate": "WITH ev AS (@EV@) SELECT id, CASE WHEN month(lts) * 100 + day(lts) >= 1215 OR month(lts) * 100 + day(lts) <= 321 THEN 'suspended' WHEN month(lts) BETWEEN 5 AND 9 AND hour(lts) BETWEEN 8 AND 16 THEN 'paused' ELSE 'watching' END mode FROM ev",
    "feed_parse": """WITH ev AS (@EV@), f AS (SELECT id, key, CASE WHEN id % 3 = 0 THEN cast(epoch AS string) WHEN id % 3 = 1 THEN if(id % 2 = 0, '', 'soon') ELSE concat(date_format(from_utc_timestamp(timestamp_seconds(epoch), 'UTC'), "yyyy-MM-dd'T'HH:mm:ss"), if(id % 2 = 0, 'Z', '-01:00')) END raw, cast(id % 4 AS string) nth, user_id FROM ev)
      SELECT id, key, coalesce(try_cast(nullif(raw, '') AS bigint), unix_seconds(try_to_timestamp(replace(raw, 'Z', '+00:00')))) predicted, CASE WHEN nth IN ('', '1') THEN 'next' ELSE concat('(interval x', nth, ')') END detail, CASE WHEN user_id % 5 = 0 THEN 'a' WHEN user_id % 5 = 1 THEN 'b' END source FROM f WHERE nth <> '2'""",
    "planning_flag": CHAIN
    + """, s AS (SELECT key, max(epoch) newest, @PCT@(x, 0.5) med FROM iv GROUP BY key) SELECT key, round((n.now_epoch - newest) / 60e0, 6) age_min, round(med, 6) median, CASE WHEN key = 'view' THEN CASE WHEN (n.now_epoch - newest) / 60e0 > 2.5e0 * med THEN 'planning' ELSE 'live' END END mode
      FROM s JOIN (SELECT max(epoch) now_epoch FROM ev) n ON now_epoch >= newest""",
    "changepoint_sums": CHAIN
    + f""", c AS (SELECT key, id, epoch, floor(epoch / {STRETCH}) d, epoch - prev_epoch g, (epoch - prev_epoch) * (epoch - prev_epoch) h FROM iv),
      u AS (SELECT key, d, (sum(g) OVER w) - g before_g, (sum(h) OVER w) - h before_h FROM (SELECT key, d, sum(g) g, sum(h) h FROM c GROUP BY key, d) WINDOW w AS (PARTITION BY key ORDER BY d))
      SELECT c.key, id, before_g + (sum(g) OVER w) s1, before_h + (sum(h) OVER w) s2 FROM c JOIN u ON c.key = u.key AND c.d = u.d WINDOW w AS (PARTITION BY c.key, c.d ORDER BY epoch, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}


#: Where the check is written in another form than the query.
ORACLE: dict[str, str] = {
    "common_eval_set": _DUCK_TWO + " SELECT p.model, p.key, count(*) n FROM pred p JOIN common c ON p.id = c.id GROUP BY 1, 2",
    "coverage_by_model": _DUCK_TWO
    + """ SELECT p.model, p.key, count(*) n, round(avg(abs(x - mid)), 6) mae, round(avg(CASE WHEN x BETWEEN lo50 AND hi50 THEN 1e0 ELSE 0e0 END), 6) cover50,
      round(avg(CASE WHEN x BETWEEN lo90 AND hi90 THEN 1e0 ELSE 0e0 END), 6) cover90, round(avg(mid), 6) mean_median FROM pred p JOIN common c ON p.id = c.id GROUP BY 1, 2""",
    "model_rank": _DUCK_TWO
    + """, m AS (SELECT p.model, p.key, avg(abs(x - mid)) mae FROM pred p JOIN common c ON p.id = c.id GROUP BY 1, 2)
      SELECT a.key, a.model, cast(rank() OVER (PARTITION BY a.key ORDER BY round(a.mae, 9)) AS bigint) place, round(100 * (b.mae - a.mae) / b.mae, 3) gain_pct FROM m a JOIN m b ON a.key = b.key AND b.model = 'rolling_normal'""",
    "raw_intervals": CHAIN + " SELECT id, key, epoch, round(x, 6) interval_min, round(lag(x) OVER (PARTITION BY key ORDER BY epoch, id), 6) prev_interval_min FROM iv",
    "changepoint_sums": CHAIN + " SELECT key, id, cast(sum(epoch - prev_epoch) OVER w AS bigint) s1, cast(sum((epoch - prev_epoch) * (epoch - prev_epoch)) OVER w AS bigint) s2 FROM iv WINDOW w AS (PARTITION BY key ORDER BY epoch, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "regional_veto": """WITH ev AS (@EV@), st AS (SELECT key station, cast(floor(epoch / 60e0) AS bigint) m, sqrt(avg(dur * dur)) v FROM ev WHERE key IN ('view', 'click') GROUP BY 1, 2),
      fires AS (SELECT DISTINCT cast(floor(epoch / 3600e0) AS bigint) * 60 m FROM ev),
      u AS (SELECT station, m, v, 0 fire FROM st UNION ALL SELECT 'view', m, cast(NULL AS double), 1 FROM fires UNION ALL SELECT 'click', m, cast(NULL AS double), 1 FROM fires),
      w AS (SELECT station, m, fire, @PCT@(v, 0.5) OVER (PARTITION BY station ORDER BY m RANGE BETWEEN 180 PRECEDING AND 11 PRECEDING) base, @PCT@(v, 0.5) OVER (PARTITION BY station ORDER BY m RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) now FROM u),
      s AS (SELECT m, max(CASE WHEN station = 'view' THEN now / greatest(base, 1e0) END) first_shift, max(CASE WHEN station = 'click' THEN now / greatest(base, 1e0) END) next_shift FROM w WHERE fire = 1 AND base IS NOT NULL AND now IS NOT NULL GROUP BY m)
      SELECT f.m, CASE WHEN first_shift IS NOT NULL THEN 'view' WHEN next_shift IS NOT NULL THEN 'click' END station, round(coalesce(first_shift, next_shift), 6) shift, coalesce(coalesce(first_shift, next_shift) >= 3, false) vetoed
      FROM fires f LEFT JOIN s ON f.m = s.m""",
    "whole_dedupe": "WITH ev AS (@EV@), u AS (SELECT key, epoch FROM ev UNION SELECT key, epoch + 30 FROM ev WHERE id % 11 = 0) SELECT key, epoch FROM u WHERE NOT EXISTS (FROM u o WHERE o.key = u.key AND o.epoch < u.epoch AND o.epoch >= u.epoch - 60)",
    "already_scored": CHAIN + " SELECT key, id FROM singles WHERE id % 2 = 0 AND id % 3 <> 0",
    "source_classes": "WITH ev AS (@EV@) SELECT 'a' source, count(*) n FROM ev WHERE user_id % 5 = 0 AND key = 'click' HAVING n > 0 UNION ALL SELECT 'b', count(*) FROM ev WHERE user_id % 5 = 1 HAVING count(*) > 0 UNION ALL SELECT 'dropped', count(*) FROM ev WHERE NOT coalesce(user_id % 5 = 1 OR (user_id % 5 = 0 AND key = 'click'), false) HAVING count(*) > 0",
    "feed_parse": """WITH ev AS (@EV@) SELECT id, key, CASE id % 3 WHEN 0 THEN epoch WHEN 1 THEN NULL ELSE epoch + 3600 * (id % 2) END predicted, CASE id % 4 WHEN 1 THEN 'next' ELSE '(interval x' || id % 4 || ')' END detail,
      CASE user_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END source FROM ev WHERE id % 4 <> 2""",
    "planning_flag": CHAIN + """, m AS (SELECT key, median(x) med, max(epoch) newest FROM iv GROUP BY key), n AS (SELECT max(epoch) t FROM ev)
      SELECT key, round((t - newest) / 60e0, 6) age_min, round(med, 6) median, CASE key WHEN 'view' THEN CASE WHEN (t - newest) / 60e0 > 2.5e0 * med THEN 'planning' ELSE 'live' END END mode FROM m, n""",
    "asof_backward": "WITH ev AS (@EV@), " + _GRID + " SELECT g.key, g.t, e.epoch last_epoch FROM grid g ASOF LEFT JOIN ev e ON g.key = e.key AND g.t >= e.epoch",
    "asof_forward": "WITH ev AS (@EV@), " + _GRID + " SELECT g.key, g.t, e.epoch next_epoch, CASE WHEN e.epoch <= g.t + 1800 THEN e.epoch END within_half_hour FROM grid g ASOF LEFT JOIN ev e ON g.key = e.key AND g.t < e.epoch",
    "interval_semi": "WITH ev AS (@EV@), " + _GRID + " SELECT key, t FROM grid g WHERE key = 'click' AND EXISTS (FROM ev e WHERE e.key = 'error' AND e.epoch > g.t AND e.epoch <= g.t + 600)",
    "basin_activity_range": "WITH ev AS (@EV@), c AS (SELECT epoch, count(*) n FROM ev GROUP BY epoch), r AS (SELECT epoch, sum(n) OVER (ORDER BY epoch) upto FROM c), l AS (SELECT r.epoch, r.upto - coalesce(o.upto, 0) seen FROM r ASOF LEFT JOIN r o ON r.epoch - 2700 >= o.epoch) SELECT id, cast(seen AS bigint) seen FROM ev JOIN l USING (epoch)",
    "recent_gaps": "WITH ev AS (@EV@), t AS (SELECT DISTINCT key, epoch FROM ev WHERE NOT minor QUALIFY dense_rank() OVER (PARTITION BY key ORDER BY epoch DESC) <= 9), g AS (SELECT key, (epoch - (SELECT max(o.epoch) FROM t o WHERE o.key = t.key AND o.epoch < t.epoch)) / 60e0 x FROM t) SELECT key, count(x) n, round(min(x), 6) least, round(median(x), 6) median, round(max(x), 6) most FROM g GROUP BY key",
    "latest_two": "WITH ev AS (@EV@), l AS (SELECT key, list({'id': id, 'epoch': epoch} ORDER BY epoch DESC, id DESC)[1:2] l FROM ev GROUP BY key) SELECT key, l[i].id id, l[i].epoch epoch, i n FROM l, range(1, 3) t(i) WHERE i <= len(l)",
    "fire_candidates": MINUTES.replace("SELECT cast", "SELECT key station, cast").replace("GROUP BY 1", "GROUP BY 1, 2").replace("/ 60e0", "/ 600e0")
    + """ SELECT a.station, a.m, round(min(b.v), 6) least_next, round((SELECT median(c.v) FROM rms c WHERE c.station = a.station AND c.m BETWEEN a.m - 360 AND a.m - 1), 6) base FROM rms a JOIN rms b ON b.station = a.station AND b.m BETWEEN a.m AND a.m + 2
      GROUP BY a.station, a.m HAVING count(*) = 3 AND (SELECT count(*) FROM rms c WHERE c.station = a.station AND c.m BETWEEN a.m - 360 AND a.m - 1) >= 60 AND min(b.v) >= 1.2e0 * (SELECT median(c.v) FROM rms c WHERE c.station = a.station AND c.m BETWEEN a.m - 360 AND a.m - 1)""",
}


def filled(out: str, engine: dict[str, str]) -> str:
    """out with an engine's own words put in."""
    for k in ("CYCLES", "CHAIN", "EV", "PCT", "DAY", "ZONE", "STRETCH"):
        out = out.replace(f"@{k}@", engine.get(k, ""))
    return out


def text(name: str, engine: dict[str, str]) -> str:
    return filled(ORACLE.get(name, CATALOG[name]) if engine is _DUCK else CATALOG[name], engine)


def plan(name: str, spark: SparkSession, events: DataFrame) -> DataFrame:
    """An operator of the catalogue over a table of events."""
    return spark.sql(text(name, _SPARK), events=events)


def queries() -> dict:
    return {name: (lambda spark, sf_dir, n=name: plan(n, spark, spark.read.parquet(f"{sf_dir}/events.parquet"))) for name in CATALOG}


def oracle_sql() -> dict[str, str]:
    return {name: text(name, _DUCK) for name in CATALOG}
