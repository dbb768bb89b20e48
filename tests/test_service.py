"""Serving, files, HTTP, tools, report and command line, on small tables and by hand."""

import datetime as dt
import gzip
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pandas as pd
import pytest

from recurra import api, cli, report
from recurra.functions import dist
from recurra.operators import roster, serving
from recurra.service import Service, Unknown
from recurra.sources import files, waves

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def service(spark):
    return Service(spark, spark.read.parquet(f"{DATA}/events.parquet"))


def history(n=400, seed=1):
    rng = np.random.default_rng(seed)
    h = pd.DataFrame({"rn": range(n), "x": rng.lognormal(np.log(90), 0.1, n), "prev_dur": 100.0, "prev_electronic": False, "prev_initial": False, "prev_hour": 12, "prev_day": 100})
    h["prev_x"], h["prev_minor"] = h["x"].shift(1), False
    return h


ANCHOR = {"epoch": 1_700_000_000, "id": 7, "dur": 100.0, "minor": False, "electronic": True, "initial": False, "hour": 15, "minute": 13, "day": 318, "x": 90.0}
ALWAYS, NEVER = np.full(24, 0.99), np.full(24, 0.05)


def served(key="signup", minutes=30, hours=ALWAYS, h=None, **kw):
    return serving.serve_one(key, history() if h is None else h, ANCHOR, ANCHOR["epoch"] + 60 * minutes, np.full((2, 24), 0.9), hours, 0, **kw)


def test_fresh_forecast_is_the_plain_one():
    r = served()
    assert r["error"] is None and not r["overdue"] and not r["stale"] and r["mode"] == "live" and r["entry"] == "electronic logger"
    assert abs(r["median_min"] - r["naive_median"]) < 4 and r["lo90"] < r["lo50"] < r["predicted"] < r["hi50"] < r["hi90"]
    assert max(r["density"]) == 1 and r["branch"] == "after a full event" and r["n_branch"] == r["n_window"] == 400


def test_late_and_watched_is_overdue_late_and_unwatched_is_stale():
    late, unseen = served(minutes=110), served(minutes=600, hours=NEVER)
    assert late["overdue"] and not late["stale"] and late["p_current"] > 0.5
    assert unseen["stale"] and not unseen["overdue"] and unseen["missed"] > 4 and 0 < unseen["minutes_until"] < 120


def test_the_hour_of_a_missed_event_counts():
    day = np.where((np.arange(24) >= 17) & (np.arange(24) <= 23), 0.05, 0.99)  # events after about 16:40 would go unseen
    assert served(minutes=110, hours=day)["p_current"] < served(minutes=110)["p_current"]
    with pytest.raises(ValueError):
        dist.renewal(dist.Dist("lognormal", 4.0, 0.1), 10.0, np.full(24, 0.5))


def test_modes_and_failures():
    assert served("view", 1000)["mode"] == "planning" and served("view", 100)["mode"] == "live" and served("error")["mode"] == "context"
    assert served(h=history(40))["error"] == "insufficient data" and "unknown" in served(model="none")["error"]
    assert served("purchase", 30, announced=ANCHOR["epoch"] + 60 * 25)["regime"] == "indicator_active"
    assert served("purchase", 30, announced=ANCHOR["epoch"] - 60)["regime"] == "base"


def test_first_draw_is_the_branch():
    short, rest = dist.Dist("lognormal", np.log(30), 0.05), dist.Dist("lognormal", np.log(200), 0.05)
    s, w, missed, none = dist.renewal(short, 60.0, 0.5, rest=rest)
    assert missed == pytest.approx(1, abs=0.01) and none < 0.01 and abs(dist.weighted_quantile(s, w, 0.5) - 230) < 5


def test_lift():
    assert serving.lifted(0.4, 0) == 0.4 and serving.lifted(0.4, 8) == pytest.approx(0.995) and serving.lifted(0.4, 4) == pytest.approx(0.6475) and serving.lifted(0.99, 1) == 0.99


def test_order_and_recent_events(spark, service):
    got = service.get_predictions()["predictions"]
    rank = [{"live": 0, "planning": 1, "context": 2}[p["mode"]] for p in got]
    assert rank == sorted(rank) and len(got) == 5 and got[-1]["recent_intervals_days"]["n"] == 8
    live = [p["minutes_until"] for p in got if p["mode"] == "live"]
    assert live == sorted(live)
    t = dt.datetime.fromtimestamp(service.now + 600, dt.UTC).replace(tzinfo=None)
    fresh = spark.createDataFrame([(10**9, t, 1, "click", 3.0, None)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events = service.events.withColumn("ts", service.events["ts"].cast("timestamp"))
    assert {r["key"]: r["anchor_id"] for r in serving.serve(events, live=fresh).collect()}["click"] == 10**9
    notes = serving.signals(events, service.now + 600, [("click", "view", 5, "{ago}"), ("click", None, 10**6, "{ago}")], fresh).collect()
    assert [n["minutes"] for n in notes] == [0, 0]


def test_walk_forward_on_the_common_set(spark):
    rows = [(m, "a", i, 5.0, 1.0, 2.0, 5.0, 8.0, 9.0, 1.0 + (m == "q"), 0.5) for m in ("rolling_normal", "q") for i in range(70) if not (m == "q" and i < 10)]
    got = {r["model"]: r for r in roster.scores(spark.createDataFrame(rows, roster.FIELDS)).collect()}
    assert got["rolling_normal"]["n"] == got["q"]["n"] == 60 and got["rolling_normal"]["place"] == 1 and got["q"]["gain_pct"] == -100
    few = [r for r in rows if r[2] < 20]
    assert {r["model"]: r["n"] for r in roster.scores(spark.createDataFrame(few, roster.FIELDS)).collect()} == {"rolling_normal": 20, "q": 10}
    assert roster._evaluated(1000, 300, 2000).tolist() == list(range(300, 1000)) and len(roster._evaluated(90_000, 300, 2000)) == 2000


def test_a_model_of_ones_own():
    roster.register("mine", lambda: lambda h, row: dist.Dist("normal", 5.0, 1.0), lambda s, key: key == "signup")
    try:
        assert served(model="mine")["naive_median"] == 5 and "mine" in roster.models_for("signup") and "mine" not in roster.models_for("view")
    finally:
        del roster.MODELS["mine"]


def test_regression_is_kept_for_its_stretch():
    h = history(600)
    z = roster._columns(h)
    model = dist.Regression(every=3)
    fits = []
    for k in range(500, 507):
        model.predict(h["x"].to_numpy()[:k], z[:k], z[k])
        fits.append(model.fit)
    assert fits[0] is fits[1] is fits[2] and fits[3] is not fits[2] and fits[3] is fits[5]
    assert dist.Regression().predict(h["x"].to_numpy()[:100], z[:100], z[100]) is None


def test_http_and_tools(service):
    server = api.server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda path: json.load(urllib.request.urlopen(url + path))

    def status(path):
        try:
            return urllib.request.urlopen(url + path).status
        except urllib.error.HTTPError as e:
            return e.code

    try:
        assert get("/api/health")["archive_rows"] == 10_000 and len(get("/api/stats")["stats"]) == 5
        assert get("/api/predictions/CLICK?points=16")["prediction"]["key"] == "click"
        assert get("/api/events/recent?hours=2&series=view")["count"] > 0
        assert [status(p) for p in ("/api/predictions?hours=99", "/api/predictions/none", "/api/none", "/api/comparisons/recent?day=x", "/api/stats?series=none", "/api/events/recent?hours=x")] == [422, 404, 404, 422, 404, 422]
        page = get("/api/comparisons/recent?limit=3&offset=2")
        assert page["count"] == 3 and page["has_more"] and page["total"] == sum(d["n_events"] for d in page["available_days"])
        day = page["available_days"][0]["date"]
        assert get(f"/api/comparisons/recent?day={day}&limit=200")["total"] == page["available_days"][0]["n_events"]
        board = {r["key"]: r["by_source"] for r in get("/api/scoreboard")["rows"]}
        assert all(b["never"] is None and b["rare"] == {"n": 0, "awaiting_first_event": True} and b["mean"]["n"] > 0 for b in board.values())
        assert "<table>" in urllib.request.urlopen(url + "/").read().decode()
    finally:
        server.shutdown()
    out = []
    api.tools_over(service, [json.dumps(m) for m in ({"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_recent_comparisons", "arguments": {"limit": 2}}}, {"id": 4, "method": "tools/call", "params": {"name": "get_series_stats", "arguments": {"series": "none"}}}, {"id": 5, "method": "none"})], out.append)
    out = [json.loads(x) for x in out]
    assert len(out) == 5 and len(out[1]["result"]["tools"]) == 5 and json.loads(out[2]["result"]["content"][0]["text"])["count"] == 2 and out[3]["result"]["isError"] and "error" in out[4]
    with pytest.raises(Unknown):
        service.resolve("none")


def test_report_and_command_line(spark, service, tmp_path):
    text = report.write(service, 20)
    assert all(x in text for x in ("# Calibration report", "## Which model wins", "## Known gaps", "| overall |", "genuine"))
    assert report.mark(0.56, 0.5) == " ·" and report.mark(0.7, 0.5) == " ⚠" and report.mark(0.52, 0.5) == ""
    assert {r["key"] for r in report.histogram(service).collect()} == set(service.names())
    shares = report.reliability(spark.createDataFrame([("k", "m", p) for p in (0.1, 0.5)], "key string, model string, pit double")).where("level in (0.0, 0.3, 1.0)").orderBy("level").collect()
    assert [r["share"] for r in shares] == [0, 0.5, 1]
    out = []
    assert cli.main(["predict", f"{DATA}/events.parquet", "--json"], spark, out.append) == 0 and len(json.loads(out[0])["predictions"]) == 5
    columns = ["eruptionID", "geyser", "eruption_time_epoch", "has_seconds", "exact", "ns", "ie", "E", "A", "wc", "ini", "maj", "min", "q", "duration", "entrant", "observer", "eruption_comment", "time_updated", "time_entered", "associated_primaryID", "other_comments", "duration_seconds", "duration_resolution", "duration_modifier"]
    lines = ["\t".join(columns)] + ["\t".join(({"eruptionID": str(i), "geyser": "Old", "eruption_time_epoch": str(10**9 + 5400 * i), "duration_seconds": "90"}.get(c, "NULL")) for c in columns) for i in range(1, 200)]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "a.tsv.gz", "wb") as f:
        f.write((tmp_path / "a.tsv").read_bytes())
    for name in ("a.tsv", "a.tsv.gz"):
        cli.main(["ingest", str(tmp_path / name), str(tmp_path / "db")], spark, out.append)
        assert out[-1] == "199 events\n"
    one = files.read_keyed(spark, str(tmp_path / "db" / "intervals"), "Old", since=10**9 + 5400 * 100, valid=True)
    assert one.count() == 100 and "PartitionFilters: [isnotnull(key" in one._jdf.queryExecution().toString()
    entry = {"eruptionID": "900", "geyser": "Old", "time": str(10**9 + 5400 * 201)}
    (tmp_path / "e.json").write_text(json.dumps({"entries": [entry, entry | {"eruptionID": "901", "q": "1"}]}))
    cli.main(["sync", str(tmp_path / "e.json"), str(tmp_path / "db")], spark, out.append)
    cli.main(["predict", str(tmp_path / "db" / "events.parquet"), "--series", "old"], spark, out.append)
    assert out[-2] == "1 entries\n" and out[-1].startswith("Old")


def test_downloads(tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return (200, "text/html", b"no") if url.endswith("02") else (404, "", b"") if url.endswith("01") else (200, "text/plain", b"rows")

    args = (str(tmp_path), lambda d: f"u{d}", lambda d: f"a_{d}.tsv", get, dt.date(2024, 5, 2))
    path = files.archive(*args)
    assert path.read_bytes() == b"rows" and asked == ["u2024-05-02", "u2024-05-01", "u2024-05-03"] and not list(tmp_path.glob("*.part"))
    assert files.archive(*args) == path and len(asked) == 3
    with pytest.raises(FileNotFoundError):
        files.archive(*args, force=True, version=dt.date(2024, 5, 1))
    assert files.reference(str(tmp_path / "r.json"), "r", lambda u: (200, "", b'{"a": 1}')) == {"a": 1}
    assert files.reference(str(tmp_path / "r.json"), "r", lambda u: (500, "", b"")) == {"a": 1}
    files.parted(str(path), str(tmp_path / "parts"), 3)
    assert files.assembled(str(tmp_path / "parts"), str(tmp_path / "whole")).read_bytes() == b"rows"
    (tmp_path / "parts" / "part-00001").write_bytes(b"xx")
    with pytest.raises(OSError):
        files.assembled(str(tmp_path / "parts"), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    with gzip.open(tmp_path / "z.gz", "wb") as f:
        f.write(b"z")
    assert files.unpacked(str(tmp_path / "z.gz"), str(tmp_path / "z")).read_bytes() == b"z"


def test_state_and_cache(tmp_path, spark):
    s = files.State(str(tmp_path / "s.json"))
    assert s.load({"a": 1}) == {"a": 1} and s.save({"b": 2}) and s.load() == {"b": 2}
    (tmp_path / "s.json").write_text("{")
    assert s.load({"a": 1}) == {"a": 1} and not files.State(get=lambda: None, put=lambda t: 1 / 0 if False else (_ for _ in ()).throw(OSError())).save({})
    now, made = [0.0], []
    c = files.Cache({"/a": 10.0}, 100.0, lambda: now[0], background=False)
    ask = lambda: c.get("/a?x", lambda: made.append(1) or len(made))
    assert ask() == (1, "miss") and ask() == (1, "hit")
    now[0] = 11
    assert ask() == (1, "stale") and ask() == (2, "hit")
    now[0] = 500
    assert ask() == (3, "miss")
    now[0] = 515
    assert c.get("/a?x", lambda: 1 / 0) == (3, "stale") and c.get("/a?x", lambda: 4) == (3, "stale") and ask()[0] == 4
    spark.range(1).createOrReplaceTempView("there")
    assert files.has_table(spark, "there") and not files.has_table(spark, "not_there")


def test_wave_minutes_need_samples(spark):
    rows = [("a", 1, 60.0 + i, 100.0 + (-1) ** i) for i in range(4)] + [("a", 1, 130.0, 100.0), ("a", 2, 200.0, None)]
    df = spark.createDataFrame(rows, "station string, record int, s double, sample double").selectExpr("station", "record", "timestamp_seconds(s) ts", "sample")
    assert [(r["m"], r["rms"], r["n"]) for r in waves.minute_rms(df, 4).collect()] == [(1, 1.0, 4)]
