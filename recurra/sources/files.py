"""Files around the tables: downloads that are cached and never half there, snapshots in parts, keyed tables, small state, cached answers.

Nothing here opens a connection itself: `get` is given, and takes a URL to (status, content type, bytes).
"""

import datetime as dt
import gzip
import hashlib
import json
import os
import shutil
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Get = Callable[[str], tuple[int, str, bytes]]


def latest_path(folder: str, pattern: str) -> Path | None:
    """The newest file by name (dates in names sort) that is not still being written."""
    found = sorted(p for p in Path(folder).glob(pattern) if p.suffix != ".part")
    return found[-1] if found else None


def _put(path: Path, data: bytes) -> Path:
    """Write beside the file and rename, so that readers see all of it or none."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_bytes(data)
    os.replace(part, path)
    return path


def archive(folder: str, url: Callable[[dt.date], str], name: Callable[[dt.date], str], get: Get, today: dt.date, force: bool = False, version: dt.date | None = None, pattern: str = "*") -> Path:
    """The archive of a day: a cached one unless forced, else that of today, yesterday or tomorrow, whichever there is (or of `version` alone).

    An answer that is no success, or that is a page, is none.
    """
    if not force and version is None and (held := latest_path(folder, pattern)) is not None:
        return held
    for day in [version] if version else [today, today - dt.timedelta(days=1), today + dt.timedelta(days=1)]:
        path = Path(folder) / name(day)
        if path.exists() and not force:
            return path
        status, kind, data = get(url(day))
        if status == 200 and "html" not in kind.lower():
            return _put(path, data)
    raise FileNotFoundError("no archive of these days")


def unpacked(path: str, target: str) -> Path:
    """A .gz file, unpacked once; by streams, so of any size."""
    out = Path(target)
    if not out.exists():
        part = out.with_name(out.name + ".part")
        with gzip.open(path, "rb") as source, open(part, "wb") as sink:
            shutil.copyfileobj(source, sink)
        os.replace(part, out)
    return out


def reference(path: str, url: str, get: Get, force: bool = False):
    """A JSON document, fetched once."""
    file = Path(path)
    if force or not file.exists():
        status, _, data = get(url)
        if status != 200:
            raise FileNotFoundError(url)
        json.loads(data)  # not kept unless it can be read
        _put(file, data)
    return json.loads(file.read_bytes())


def parted(path: str, folder: str, size: int) -> Path:
    """Cut a file into parts with a manifest of their sizes and its hash."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    parts, digest = [], hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(size):
            name = f"part-{len(parts):05d}"
            _put(Path(folder) / name, block)
            digest.update(block)
            parts.append({"name": name, "bytes": len(block)})
    return _put(Path(folder) / "manifest.json", json.dumps({"parts": parts, "bytes": sum(p["bytes"] for p in parts), "sha256": digest.hexdigest()}).encode())


def assembled(folder: str, target: str) -> Path:
    """The file that a manifest's parts make; an error, and no file, if a part or the whole has another size or hash."""
    m = json.loads((Path(folder) / "manifest.json").read_bytes())
    out = Path(target)
    part, total, digest = out.with_name(out.name + ".part"), 0, hashlib.sha256()
    try:
        with open(part, "wb") as sink:
            for p in m["parts"]:
                data = (Path(folder) / p["name"]).read_bytes()
                if len(data) != p["bytes"]:
                    raise OSError(f"{p['name']} has {len(data)} bytes, not {p['bytes']}")
                sink.write(data)
                digest.update(data)
                total += len(data)
        if total != m["bytes"] or digest.hexdigest() != m["sha256"]:
            raise OSError("the parts do not make the file")
        os.replace(part, out)
    finally:
        part.unlink(missing_ok=True)
    return out


def write_keyed(df: DataFrame, path: str, key: str = "key", order: str = "epoch") -> None:
    """A table in folders by series, each file in the order of time, so that a series or a span of time is read alone.  A series is cut by days, so that one task does not write all of it."""
    rows = df.withColumn("day", F.floor(F.col(order) / 86400))
    rows.repartition(key, "day").sortWithinPartitions(key, order).drop("day").write.mode("overwrite").partitionBy(key).parquet(path)


def read_keyed(spark: SparkSession, path: str, key: str, since: int | None = None, valid: bool = False, order: str = "epoch") -> DataFrame:
    """One series of a keyed table in the order of time: the folder, the span and the flag are all pushed to the scan."""
    rows = spark.sql(f"SELECT * FROM {{t}} WHERE key = :key AND {order} >= :since" + (" AND is_valid" if valid else ""), args={"key": key, "since": since if since is not None else -(1 << 62)}, t=spark.read.parquet(path))
    return rows.sortWithinPartitions(order)


def has_table(spark: SparkSession, name: str) -> bool:
    """Whether the catalogue has a table or view of that name."""
    return spark.catalog.tableExists(name)


class State:
    """A small JSON state that never stops its caller: what cannot be read is the default, what cannot be written is dropped and said so."""

    def __init__(self, path: str | None = None, get: Callable[[], str | None] | None = None, put: Callable[[str], None] | None = None):
        self.path, self.get, self.put = path, get, put

    def load(self, default: dict | None = None) -> dict:
        try:
            text = self.get() if self.get else Path(self.path).read_text()
            return json.loads(text) if text else dict(default or {})
        except (OSError, ValueError, TypeError):
            return dict(default or {})

    def save(self, state: dict) -> bool:
        try:
            text = json.dumps(state)
            if self.put:
                self.put(text)
            else:
                _put(Path(self.path), text.encode())
            return True
        except (OSError, ValueError, TypeError):
            return False


class Cache:
    """Answers by path: fresh for their time; for a while after that the old one is given and a new one made in the background; if that fails, the old one stays."""

    def __init__(self, seconds: dict[str, float], most_stale: float = 600.0, clock: Callable[[], float] = time.time, background: bool = True):
        self.seconds, self.most_stale, self.clock, self.background = seconds, most_stale, clock, background
        self.held: dict[str, tuple[float, object]] = {}
        self.busy: set[str] = set()
        self.lock = threading.Lock()

    def _make(self, path: str, make: Callable[[], object]) -> object:
        try:
            got = make()
            with self.lock:
                self.held[path] = self.clock(), got
            return got
        finally:
            with self.lock:
                self.busy.discard(path)

    def _again(self, path: str, make: Callable[[], object]) -> None:
        try:
            self._make(path, make)
        except Exception:  # noqa: BLE001 - the old answer stays
            return

    def get(self, path: str, make: Callable[[], object]) -> tuple[object, str]:
        """The answer, and whether it was a `hit`, is `stale`, or was a `miss`."""
        keep = next((s for p, s in self.seconds.items() if path.startswith(p)), 0.0)
        with self.lock:
            held = self.held.get(path)
            age = self.clock() - held[0] if held else None
            old = held is not None and keep <= age < keep + self.most_stale
            first = old and path not in self.busy
            if first:
                self.busy.add(path)
        if held is not None and age < keep:
            return held[1], "hit"
        if not old:
            return self._make(path, make), "miss"
        if first:
            if self.background:
                threading.Thread(target=self._again, args=(path, make), daemon=True).start()
            else:
                self._again(path, make)
        return held[1], "stale"
