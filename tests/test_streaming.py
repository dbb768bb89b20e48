"""Streams against the same computed at once; readers against small files."""

import json
from dataclasses import replace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recurra.sources import archive
from recurra.streaming import jobs
from tests.test_engine import DATA, rows


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_oracle(spark, name):
    con, data = duckdb.connect(), "/root/testdata/sf0.01" if "detections" in name else DATA  # too few events fire in the smaller one
    con.sql(f"create view events as select * from read_parquet('{data}/events.parquet')")
    got, want = jobs.queries()[name](spark, data).toPandas(), con.sql(jobs.oracle_sql()[name]).df()
    assert len(got) > 0 and rows(got) == rows(want)


def _minutes():
    v = np.full(700, 900.0)
    v[500:521] = 9000
    v[600:605] = 9000
    return pd.DataFrame({"station": "a", "m": np.arange(700) + 1000, "rms": v})


def test_detector_rules():
    f, d = _minutes(), jobs.Detector()
    m, v = f["m"].to_numpy(), f["rms"].to_numpy()
    assert d.scan(m, v, None, None)[0] == [(1500, 9000.0, 900.0)]
    assert d.scan(m, v, None, 1480)[0] == []  # rests after a fire
    assert d.scan(m, np.full(700, 5000.0), None, None)[0] == []
    assert d.scan(m[:512], v[:512], None, None)[0] == []  # its window has not ended
    assert replace(d, quiet=800.0).scan(m, v, None, None)[0] == []
    assert d.scan(m[:0], v[:0], 5, 6) == ([], 5, 6)


def test_detector_stream_by_pieces(spark, tmp_path):
    f = _minutes()
    both = pd.concat((f, f.assign(station="b", rms=900.0)))
    for k, (lo, hi) in enumerate(((0, 505), (505, 512), (500, 700))):  # the last repeats some minutes
        part = both[(both["m"] >= 1000 + lo) & (both["m"] < 1000 + hi)]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station string, m long, rms double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.log(jobs.detections(stream), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/rows")).select("station", "m", "least_next", "base").collect()
    assert [tuple(r) for r in got] == [("a", 1500, 9000.0, 900.0)]


def test_upsert_takes_the_newest(spark, tmp_path):
    for v in (1, 2):
        spark.createDataFrame([(1, v), (v + 1, 9)], "id int, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.upserted(stream, str(tmp_path / "log"), "id").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 9), (3, 9)]


def test_archive(spark, tmp_path):
    head = ["eruptionID", "geyser", "eruption_time_epoch", "has_seconds", "exact", "ns", "ie", "E", "A", "wc", "ini", "maj", "min", "q", "duration", "duration_seconds", "duration_resolution", "duration_modifier", "entrant", "observer", "eruption_comment", "time_updated", "time_entered", "associated_primaryID", "other_comments"]
    base = dict.fromkeys(head, "NULL") | {"geyser": " x ", "E": "1", "min": "2"}
    kept = [base | {"eruptionID": "1", "eruption_time_epoch": "-60", "associated_primaryID": "1", "eruption_comment": 'an "open quote'}]
    gone = [base | {"eruptionID": "2", "eruption_time_epoch": "soon"}, base | {"eruptionID": "3", "eruption_time_epoch": "5", "associated_primaryID": "1"}, base | {"eruptionID": "4", "eruption_time_epoch": "5", "q": "1"}, base | {"geyser": " ", "eruption_time_epoch": "5"}]
    text = "\n".join(["\t".join(head), *("\t".join(r[c] for c in head) for r in kept + gone), "too\tshort"]) + "\n"
    (tmp_path / "a.tsv").write_text(text)
    got = archive.events(archive.tab_separated(spark, str(tmp_path / "a.tsv"))).collect()
    assert len(got) == 1 and got[0]["id"] == 1 and got[0]["key"] == "x" and got[0]["epoch"] == -60
    assert got[0]["electronic"] and not got[0]["minor"] and got[0]["comment"] == 'an "open quote' and got[0]["dur"] is None


def test_feeds(spark, tmp_path):
    entry = {"eruptionID": "7", "geyser": "x", "time": "100", "primaryID": "7", "durationSec": "-1", "maj": "1"}
    envelope = {"status": "success", "entries": [entry, entry | {"eruptionID": "8"}, entry | {"q": "1"}]}
    (tmp_path / "e.json").write_text(json.dumps(envelope))
    e = archive.recent_entries(spark.read.schema(f"entries array<struct<{archive.ENTRY.replace(' string', ': string')}>>").json(str(tmp_path / "e.json")))
    assert [(r["id"], r["major"], r["dur"]) for r in e.collect()] == [(7, True, None)]
    base = {"geyserName": "X", "userID": "44", "prediction": "1970-01-01T00:10:00+0000", "predictionID": "p", "timeEntered": "50", "windowOpen": "", "method": "m"}
    feed = [base | {"intervalNumber": "2"}, base | {"futureEruptionNumber": "2"}, base | {"geyserName": "y"}, base | {"userID": "9"}, base | {"userID": "208", "comment": "by nps"}, base | {"userID": "208"}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, feed)))
    f = archive.forecasts(spark.read.schema(archive.FORECAST).json(str(tmp_path / "f.json")), {"park": ("208", "NPS"), "other": ("44", None)}, ["x"])
    got = [tuple(r) for r in f.orderBy("source").select("source", "key", "issued", "predicted", "opens", "detail").collect()]
    assert got == [("other", "x", 50, 600, None, "m (interval x2)"), ("park", "x", 50, 600, None, "m")]
    assert f.where(F.lit(False)).count() == 0


def in_batches(spark, path, schema, *batches):
    """A stream that reads each batch as a micro-batch of its own, oldest first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_late_rows_do_not_count(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = in_batches(spark, str(tmp_path / "in"), "ts timestamp, value double", [(at(10), 3.0), (at(20), 5.0)], [(at(7200), 1.0)], [(at(7300), 1.0)], [(at(30), 100.0), (at(7210), 1.0)], [(at(90_000), 1.0)], [(at(90_001), 1.0)])
    jobs.log(jobs.minute_amplitudes(rows), str(tmp_path / "out"), "append").awaitTermination()
    got = {r["m"]: (r["n"], r["rms"]) for r in jobs.logged(spark, str(tmp_path / "out"), jobs.minute_amplitudes(rows).schema).collect()}
    first = min(got)
    assert got[first] == (2, 17**0.5) and got[first + 120] == (2, 1.0)


def test_chains_collapse_across_batches(spark, tmp_path):
    rows = in_batches(spark, str(tmp_path / "in"), "key string, id long, epoch long", [("a", 1, 100), ("a", 2, 150), ("b", 3, 150)], [("a", 4, 205), ("a", 5, 270), ("b", 6, 150)], [("a", 7, 331), ("a", 8, 90)])
    jobs.log(jobs.singles(rows), str(tmp_path / "out")).awaitTermination()
    got = jobs.logged(spark, str(tmp_path / "out"), jobs.singles(rows).schema).collect()
    assert sorted(r["id"] for r in got) == [1, 3, 5, 7]


def test_batch_detections_against_the_rule(spark, tmp_path):
    """Many fires, runs of candidates nearer than the rest, over several blocks of bins, against plain Python."""
    import datetime as dt


    rng = np.random.default_rng(3)
    r, rows, want = jobs.SPARSE_RULE, [], []
    begin = dt.datetime(2024, 1, 1)
    for station in ("a", "b"):
        v = rng.uniform(180, 220, 4000)
        for at in rng.integers(200, 3900, 60):
            v[at : at + int(rng.integers(2, 40))] = rng.uniform(300, 900)
        there = rng.random(4000) < 0.97
        rows += [(len(rows) + i, station, float(v[i]), begin + dt.timedelta(seconds=jobs.SPARSE_BINS * i), 1, "{}") for i in np.flatnonzero(there).tolist()]
        first = int(begin.replace(tzinfo=dt.UTC).timestamp()) // jobs.SPARSE_BINS
        last = None
        for m in range(4000):
            own = [v[k] for k in range(m, min(m + r.sustain, 4000)) if there[k]]
            past = [v[k] for k in range(max(0, m - r.back), m) if there[k]]
            if not there[m] or len(own) < r.sustain or len(past) < r.known or (last is not None and m < last + r.rest):
                continue
            base, low = float(np.median(past)), min(own)
            if base < r.quiet and low >= max(r.least, r.ratio * base):
                want.append((station, first + m, round(low, 4), round(base, 4)))
                last = m
    spark.createDataFrame(rows, "event_id long, event_type string, value double, ts timestamp_ntz, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((x.station, x.m, round(x.least_next, 4), round(x.base, 4)) for x in jobs.batch_detections(spark, str(tmp_path)).collect())
    assert len(want) > 60 and got == sorted(want)
