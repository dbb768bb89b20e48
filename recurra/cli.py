"""python -m recurra.cli ingest | sync | predict | backtest | serve | tools"""

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra import api, report
from recurra.operators import intervals
from recurra.service import Service
from recurra.sources import archive, files


def as_events(typed: DataFrame) -> DataFrame:
    """Typed archive events in the shape of the engine's table."""
    props = F.to_json(F.struct(F.lit(None).cast("int").alias("k")))
    return typed.select(F.col("id").alias("event_id"), F.timestamp_seconds("epoch").alias("ts"), F.lit(None).cast("long").alias("user_id"), F.col("key").alias("event_type"), F.col("dur").alias("value"), props.alias("props"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recurra")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    c = add("ingest", "type an archive of tab-separated events and build the table of judged gaps")
    c.add_argument("archive"), c.add_argument("out")
    c = add("sync", "add envelopes of recent entries (JSON) to the table")
    c.add_argument("entries"), c.add_argument("out")
    for name, text in (("predict", "next events"), ("backtest", "the calibration report"), ("serve", "answer over HTTP"), ("tools", "answer a tool client on standard input")):
        c = add(name, text)
        c.add_argument("events")
        if name == "predict":
            c.add_argument("--series"), c.add_argument("--model"), c.add_argument("--json", action="store_true")
        if name == "backtest":
            c.add_argument("--days", type=int, default=20), c.add_argument("--out"), c.add_argument("--no-nowcast", action="store_true")
        if name == "serve":
            c.add_argument("--host", default="127.0.0.1"), c.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, write=sys.stdout.write) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("recurra").getOrCreate()
    if a.command == "ingest":
        typed = archive.events(archive.tab_separated(spark, a.archive))
        as_events(typed).write.mode("overwrite").parquet(f"{a.out}/events.parquet")
        events = spark.read.parquet(f"{a.out}/events.parquet")
        files.write_keyed(intervals.labels(intervals.gaps(spark, events)), f"{a.out}/intervals")
        write(f"{events.count()} events\n")
        return 0
    if a.command == "sync":
        recent = as_events(archive.recent_entries(spark.read.schema(f"entries array<struct<{archive.ENTRY.replace(' string', ': string')}>>").json(a.entries, multiLine=True)))
        recent.write.mode("append").parquet(f"{a.out}/recent")
        write(f"{recent.count()} entries\n")
        return 0
    events, live = spark.read.parquet(a.events), Path(a.events).parent / "recent"
    service = Service(spark, events, live=spark.read.parquet(str(live)).dropDuplicates(["event_id"]) if live.exists() else None)
    if a.command == "predict":
        got = service.get_predictions([service.resolve(a.series)] if a.series else None, model=a.model, density=False)
        if a.json:
            write(json.dumps(got) + "\n")
        else:
            for p in got["predictions"]:
                write(f"{p['key']:<12} {p.get('error') or p['mode'] + '  ' + p.get('predicted_utc', '') + '  ' + p.get('lo90_utc', '') + ' to ' + p.get('hi90_utc', '')}\n")
    elif a.command == "backtest":
        text = report.write(service, a.days, not a.no_nowcast)
        Path(a.out).write_text(text) if a.out else write(text)
    elif a.command == "tools":
        api.tools_over(service, sys.stdin, write)
    else:
        api.server(service, a.host, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
