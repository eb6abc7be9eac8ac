"""An HTTP front end: /d/<command>.<type>?parameter=value runs a command of a database.

GET takes parameters from the address, POST also the body: the values of load, or a form. Types: json, xml,
tsv, msgpack. The answer has a header (code, start, seconds) and the body of the command; records come a
page at a time (LIMIT unless limit says otherwise), so what is gathered for an answer stays small.
"""

from __future__ import annotations

import json
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame

from .operators.select import Result
from .plans.syntax import SyntaxProblem
from .sources import io
from .sources.database import Database, Loaded

LIMIT = 10
_LABEL = re.compile(r"(columns|drilldowns?|slices)\[(\w+)\]\.(.+)")
_WHOLE = {"offset", "limit", "max_n_target_records", "match_escalation_threshold", "most"}
_OF_COLUMNS = {"stage", "value", "type", "flags"}


def nested(pairs: list[tuple[str, str]]) -> dict:
    """Parameters with labels as nested dicts: columns[a].stage, drilldowns[f].columns[b].value, columns[a].window.sort_keys."""
    out: dict = {}
    for k, v in pairs:
        at, rest = out, k
        while m := _LABEL.fullmatch(rest):
            group = "drilldowns" if m[1] == "drilldown" else m[1]
            at = at.setdefault(group, {}).setdefault(m[2], {})
            rest = m[3]
        rest = rest.replace("window.", "window_").replace("sortby", "sort_keys")
        at[rest] = int(v) if rest in _WHOLE else v
    return out


def _page(df: DataFrame) -> list:
    """[columns with their types, one list a record]."""
    return [[[f.name, f.dataType.simpleString()] for f in df.schema], *[list(r) for r in df.collect()]]


def answer(database: Database, command: str, parameters: dict, body: str = ""):
    """The body of an answer; DataFrames as pages."""
    parameters = dict(parameters)
    if command == "select":
        parameters.setdefault("limit", LIMIT)
        for spec in parameters.get("drilldowns", {}).values():
            spec.setdefault("limit", LIMIT)
    if command == "load" and body:
        parameters["values"] = json.loads(body)
    got = database.command(command, **parameters)
    if isinstance(got, Result):
        return {"records": _page(got.records), "drilldowns": {k: _page(v) for k, v in got.drilldowns.items()}, "slices": {k: _page(v.records) for k, v in got.slices.items()}}
    if isinstance(got, Loaded):
        return {"loaded": got.count()} | {k: _page(v) for k, v in (("ids", got.ids), ("errors", got.errors)) if v is not None}
    return _page(got) if isinstance(got, DataFrame) else True if got is None else got


def _xml(x, name: str = "VALUE") -> str:
    clean = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    if isinstance(x, dict):
        return f"<{name}>" + "".join(f'<FIELD NAME="{clean(k)}">{_xml(v)}</FIELD>' for k, v in x.items()) + f"</{name}>"
    if isinstance(x, (list, tuple)):
        return f"<{name}>" + "".join(_xml(v, "ELEMENT") for v in x) + f"</{name}>"
    return f"<{name}>{'' if x is None else clean(x)}</{name}>"


def _tsv(x) -> str:
    cell = lambda v: str("" if v is None else v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
    rows = x["records"] if isinstance(x, dict) and "records" in x else x if isinstance(x, list) else [[[("value", "")]], [x]]
    head = [c[0] for c in rows[0]] if rows and rows[0] and isinstance(rows[0][0], (list, tuple)) else ["value"]
    return "\n".join("\t".join(map(cell, r)) for r in [head, *rows[1:]]) + "\n"


FORMS = {
    "json": ("application/json", lambda head, x: json.dumps([head, x], default=str).encode()), "xml": ("text/xml", lambda head, x: f'<?xml version="1.0" encoding="utf-8"?><RESULT CODE="{head[0]}" UP="{head[1]}" ELAPSED="{head[2]}">{_xml(x)}</RESULT>'.encode()),
    "tsv": ("text/tab-separated-values", lambda head, x: _tsv(x).encode()), "msgpack": ("application/x-msgpack", lambda head, x: io.pack_message([head, x])),
}


def handler(database: Database):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self, body: str = "") -> None:
            began, said = time.time(), urlsplit(self.path)
            m = re.fullmatch(r"/d/([a-z_]+)(?:\.(\w+))?", said.path)
            kind, form = FORMS.get(m[2] or "json", FORMS["json"]) if m else FORMS["json"]
            pairs = parse_qsl(said.query, keep_blank_values=True)
            if body and body.lstrip()[:1] not in ("[", "{") and "form" in self.headers.get("Content-Type", ""):
                pairs, body = pairs + parse_qsl(body, keep_blank_values=True), ""
            try:
                if not m:
                    raise SyntaxProblem("an address is /d/<command>")
                code, status, x = 0, 200, answer(database, m[1], nested(pairs), body)
            except (SyntaxProblem, TypeError, ValueError, KeyError) as e:
                code, status, x = -22, 400, str(e)
            except Exception as e:  # noqa: BLE001  (what Spark says goes to the client, the server stays)
                code, status, x = -1, 500, str(e).split("\n")[0]
            raw = form([code, began, time.time() - began], x)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self) -> None:
            self.do_GET(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode())

        def log_message(self, *_) -> None:
            pass

    return Handler


def serve(database: Database, host: str = "127.0.0.1", port: int = 10041) -> ThreadingHTTPServer:
    """A server that is ready; serve_forever() runs it, shutdown() ends it."""
    return ThreadingHTTPServer((host, port), handler(database))
