"""HTTP and tool calls over the service, with the standard library only.

GET /api/health, /api/predictions, /api/predictions/{series}, /api/events/recent, /api/stats, /api/scoreboard, /api/comparisons/recent,
and a plain page at /.  Arguments out of range are answered with 422, unknown series and paths with 404.
"""

import html
import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from recurra.service import Service, Unknown
from recurra.sources.files import Cache

#: How long an answer is fresh, in seconds, by path.
FRESH = {"/api/predictions": 60.0, "/api/scoreboard": 120.0, "/api/comparisons": 120.0, "/api/stats": 3600.0, "/api/health": 30.0, "/api/events": 60.0}


class Bad(ValueError):
    """An argument out of range."""


def number(args: dict, name: str, default, least, most, kind=float):
    try:
        value = kind(args.get(name, default))
    except (TypeError, ValueError):
        raise Bad(f"{name} is no number") from None
    if not least <= value <= most:
        raise Bad(f"{name} is from {least} to {most}")
    return value


def answer(service: Service, path: str, args: dict):
    """What a path and its arguments ask for."""
    key = service.resolve(args["series"]) if args.get("series") else None
    if path == "/api/health":
        return service.get_health()
    if path == "/api/predictions":
        return service.get_predictions(hours=number(args, "hours", 12, 1, 48), points=number(args, "points", 96, 8, 512, int))
    if m := re.fullmatch(r"/api/predictions/([^/]+)", path):
        one = service.resolve(unquote(m[1]))
        got = service.get_predictions([one], number(args, "hours", 12, 1, 48), number(args, "points", 240, 8, 1024, int))
        return {k: v for k, v in got.items() if k != "predictions"} | {"prediction": got["predictions"][0]}
    if path == "/api/events/recent":
        only = [key] if key else [k for k in service.names() if k not in service.series.context] if args.get("targets_only", "").lower() in ("1", "true") else None
        return service.get_recent(number(args, "hours", 24, 1, 168, int), only)
    if path == "/api/stats":
        return service.get_stats(key)
    if path == "/api/scoreboard":
        return service.get_scoreboard(key)
    if path == "/api/comparisons/recent":
        day = args.get("day")
        if day is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
            raise Bad("day is YYYY-MM-DD")
        return service.get_comparisons(number(args, "limit", 20, 1, 200, int), number(args, "offset", 0, 0, 1 << 40, int), day, key)
    raise Unknown(path)


def page(service: Service) -> str:
    """The forecasts as a plain page."""
    rows = service.get_predictions(density=False)["predictions"]
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    body = "".join("<tr>" + "".join(cell(r.get(c)) for c in ("key", "mode", "model", "predicted_utc", "lo90_utc", "hi90_utc", "minutes_until", "error")) + "</tr>" for r in rows)
    return f"<!doctype html><title>Next events</title><table><tr><th>series<th>mode<th>model<th>predicted<th>from<th>to<th>minutes<th></tr>{body}</table>"


def respond(service: Service, cache: Cache, target: str) -> tuple[int, str, str]:
    """Status, content type and text of an answer."""
    url = urlsplit(target)
    args = {k: v[-1] for k, v in parse_qs(url.query).items()}
    try:
        if url.path == "/":
            return 200, "text/html", page(service)
        got, _ = cache.get(url.path + "?" + url.query, lambda: answer(service, url.path, args))
        return 200, "application/json", json.dumps(got)
    except Bad as e:
        return 422, "application/json", json.dumps({"detail": str(e)})
    except Unknown as e:
        return 404, "application/json", json.dumps({"detail": str(e.args[0])})


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    cache = Cache(FRESH)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, kind, text = respond(service, cache, self.path)
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind + "; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


#: name -> (what it tells, its arguments as JSON schema, call)
_SERIES = {"series": {"type": "string"}}
TOOLS: dict[str, tuple[str, dict, Callable]] = {
    "get_predictions": ("Next events as distributions, soonest first.", _SERIES | {"include_density": {"type": "boolean"}}, lambda s, a: s.get_predictions([s.resolve(a["series"])] if a.get("series") else None, points=48, density=bool(a.get("include_density")))),
    "get_recent_events": ("Events of the last hours, newest first.", _SERIES | {"hours": {"type": "integer", "minimum": 1, "maximum": 168}}, lambda s, a: answer(s, "/api/events/recent", a)),
    "get_series_stats": ("Statistics of genuine gaps, of all time and of the last year.", _SERIES, lambda s, a: answer(s, "/api/stats", a)),
    "get_scoreboard": ("How well each source has forecast each series; n may be small, so say it.", _SERIES, lambda s, a: answer(s, "/api/scoreboard", a)),
    "get_recent_comparisons": ("Recent events with what each source had said.", _SERIES | {"limit": {"type": "integer", "minimum": 1, "maximum": 200}}, lambda s, a: answer(s, "/api/comparisons/recent", a)),
}


def tool_message(service: Service, message: dict) -> dict | None:
    """The answer to one JSON-RPC message of a tool client (initialize, tools/list, tools/call); None to a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "recurra", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p, _) in TOOLS.items()]}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            got, failed = json.dumps(TOOLS[params["name"]][2](service, params.get("arguments") or {})), False
        except (Bad, Unknown) as e:
            got, failed = str(e.args[0]), True
        return reply | {"result": {"content": [{"type": "text", "text": got}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no method {method} {params.get('name', '')}".strip()}}


def tools_over(service: Service, lines, write: Callable[[str], None]) -> None:
    """Serve a tool client over lines of JSON, such as standard input."""
    for line in lines:
        if line.strip():
            reply = tool_message(service, json.loads(line))
            if reply is not None:
                write(json.dumps(reply) + "\n")
