"""The engine over HTTP, with the standard library's server.

Requests and answers are JSON; field names are accepted in camel or snake case.  Unknown routes and
missing items give 404, missing fields and refused paths 400, failures 500, each with ``error``.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from folioscope.api import Engine
from folioscope.operators import read, search
from folioscope.operators.filters import PathRefused, check_path

HOST, PORT = "127.0.0.1", 5080
#: Documents of a page unless asked otherwise, and the largest body that is read.
PAGE, MAX_BODY = 50, 1 << 20


class Refused(ValueError):
    """A request that can't be answered, with its status."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


class Fields:
    """A request's fields; names are compared without case and underscores."""

    def __init__(self, values: dict) -> None:
        self._held = {self._flat(k): v for k, v in values.items() if v is not None}

    @staticmethod
    def _flat(name: str) -> str:
        return name.replace("_", "").lower()

    def get(self, *names: str, default=None):
        return next((self._held[self._flat(n)] for n in names if self._flat(n) in self._held), default)

    def text(self, *names: str) -> str:
        """A field that must be there and not blank."""
        value = self.get(*names)
        if not isinstance(value, str) or not value.strip():
            raise Refused(400, f"'{names[0]}' is required")
        return value

    def number(self, *names: str, default: int | None = None) -> int | None:
        value = self.get(*names, default=default)
        try:
            return None if value is None else int(value)
        except (TypeError, ValueError):
            raise Refused(400, f"'{names[0]}' must be a number") from None


class Routes:
    """What each route answers; independent of any server."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self._table: list[tuple[str, re.Pattern, Callable]] = [
            (method, re.compile(pattern + "/?$"), answer)
            for method, pattern, answer in (
                ("GET", "/api/status", self._status),
                ("POST", "/api/search", lambda f: self._search(f, str(f.get("mode", default="hybrid")).lower())),
                ("POST", "/api/semantic-search", lambda f: self._search(f, "semantic")),
                ("POST", "/api/hybrid-search", lambda f: self._search(f, "hybrid")),
                ("GET", "/api/documents", self._documents),
                ("GET", r"/api/documents/(-?\d+)", self._document),
                ("GET", r"/api/documents/(-?\d+)/outline", self._outline),
                ("POST", "/api/read", self._read),
                ("POST", "/api/find", self._find),
                ("POST", "/api/related", lambda f: self.engine.related(f.text("target"))),
                ("POST", "/api/references", lambda f: self.engine.references(f.text("symbol"))),
                ("POST", "/api/index", self._index),
            )
        ]

    def handle(self, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
        """Status and answer of a request."""
        url = urlsplit(target)
        hits = [(m, p.match(url.path), f) for m, p, f in self._table if p.match(url.path)]
        if not hits:
            return 404, {"error": f"no route {url.path}"}
        hit = next(((m, f) for verb, m, f in hits if verb == method), None)
        if hit is None:
            return 405, {"error": f"{method} is not allowed here"}
        began, ok = time.perf_counter(), True
        try:
            given = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if body:
                sent = json.loads(body)
                if not isinstance(sent, dict):
                    raise Refused(400, "the body must be an object")
                given |= sent
            return 200, hit[1](Fields(given), *hit[0].groups())
        except Refused as e:
            return e.status, {"error": str(e)}
        except (PathRefused, json.JSONDecodeError, UnicodeDecodeError, NotADirectoryError) as e:
            return 400, {"error": str(e)}
        except Exception as e:  # noqa: BLE001 - the server must outlive a request
            ok = False
            return 500, {"error": str(e).split("\n")[0]}
        finally:
            self.engine.metrics.record_call(f"{method} {url.path}", (time.perf_counter() - began) * 1000, ok)

    def _status(self, f: Fields) -> dict:
        status = self.engine.status()
        return {"stats": {k: v for k, v in status.items() if k != "metrics"}, "observability": status["metrics"]}

    def _search(self, f: Fields, mode: str) -> list:
        limit = f.number("limit", default=self.engine.config.search.default_limit)
        return self.engine.results(search.SearchQuery(str(f.get("query", default="")), limit, f.get("documentType"), f.get("extension"), f.get("pathPrefix")), mode)

    def _documents(self, f: Fields) -> list:
        return self.engine.list(document_type=f.get("docType"), extension=f.get("ext"), limit=max(f.number("limit", default=PAGE), 0), offset=max(f.number("offset", default=0), 0))

    def _document(self, f: Fields, key: str) -> dict:
        found = self.engine.document(int(key))
        if found is None:
            raise Refused(404, f"no document {key}")
        return found

    def _outline(self, f: Fields, key: str) -> list:
        return self.engine.outline(self._document(f, key)["path"])

    def _read(self, f: Fields) -> dict:
        name = f.text("pathOrFilename", "document", "file")
        check_path(name, self.engine.config.security)
        found = self.engine.read(read.ReadRequest(name, f.number("page"), f.number("slide"), f.get("sheet"), f.get("section"), f.get("symbol"), f.number("lineStart"), f.number("lineEnd")))
        if found is None:
            raise Refused(404, f"no document '{name}'")
        return found

    def _find(self, f: Fields) -> list:
        return self.engine.find(f.text("name"), f.get("symbolType", "type"), f.number("limit", default=20))

    def _index(self, f: Fields) -> dict:
        path = str(f.get("path", default="") or ".").strip() or "."
        if "://" not in path and not os.path.exists(path):
            raise Refused(400, f"path '{path}' does not exist")
        if "://" not in path and os.path.isfile(path):
            whole = os.path.abspath(path)
            return vars(self.engine.index(os.path.dirname(whole), only=whole))
        return vars(self.engine.index(path))


def server(engine: Engine, host: str = HOST, port: int = PORT) -> ThreadingHTTPServer:
    """A server that isn't started yet; port 0 takes a free one."""
    routes = Routes(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                status, found = 413, {"error": "the body is too large"}
            else:
                status, found = routes.handle(self.command, self.path, self.rfile.read(size) if size else b"")
            data = json.dumps(found, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
