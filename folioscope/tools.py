"""The tool server: JSON-RPC over standard input and output, one request at a time."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from typing import BinaryIO

from folioscope.api import Engine
from folioscope.functions.text import CUT_NOTICE
from folioscope.operators import read, search
from folioscope.operators.filters import check_path

PROTOCOL = "2024-11-05"
PARSE_ERROR, BAD_PARAMETERS, NO_METHOD = -32700, -32602, -32601


class BadArguments(ValueError):
    pass


def _need(args: dict, name: str) -> str:
    value = args.get(name)
    if not isinstance(value, str) or not value.strip():
        raise BadArguments(f"'{name}' is required")
    return value


def _search(engine: Engine, args: dict) -> object:
    q = search.SearchQuery(_need(args, "query"), min(int(args.get("limit") or engine.config.search.default_limit), 50), args.get("doc_type"), args.get("extension"), args.get("path_filter"))
    rows = engine.results(q, args.get("mode") or "hybrid")
    return [{**r, "score": round(r["score"], 4), "score_components": {k: round(v, 4) for k, v in r["score_components"].items()}} for r in rows]


def _open(engine: Engine, args: dict) -> object:
    most = int(args.get("max_chars") or 12_000)
    if args.get("id") is not None:
        found = engine.open(int(args["id"]), most)
    else:
        name = _need(args, "file")
        check_path(name, engine.config.security)
        found = engine.read(read.ReadRequest(name, args.get("page"), args.get("slide"), args.get("sheet"), args.get("section"), args.get("symbol"), args.get("line_start"), args.get("line_end")))
        if found and len(found["content"]) > most:
            found["content"] = found["content"][:most] + CUT_NOTICE
    if found is None:
        raise LookupError("not found")
    return found


def _outline(engine: Engine, args: dict) -> object:
    if args.get("id") is not None:
        document = engine.document(int(args["id"]))
        if document is None:
            raise LookupError("not found")
        name = document["path"]
    else:
        name = _need(args, "file")
        check_path(name, engine.config.security)
    rows = engine.outline(name)
    return "\n".join("  " * max(r["depth"] or 0, 0) + (r["label"] or "") + (f" ({r['line_start']}-{r['line_end']})" if r["line_start"] else "") for r in rows)


def _find(engine: Engine, args: dict) -> object:
    return engine.find(_need(args, "name"), args.get("type"), min(int(args.get("limit") or 20), 100))


def _context(engine: Engine, args: dict) -> object:
    return engine.context(_need(args, "query"), int(args.get("max_tokens") or 4000), args.get("mode") or "hybrid", args.get("extension"), bool(args.get("include_relationships", True)))["text"]


_TEXT, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
Tool = Callable[[Engine, dict], object]
#: name -> (description, arguments, required arguments, function)
TOOLS: dict[str, tuple[str, dict, list[str], Tool]] = {
    "search": ("Search the indexed documents.", {"query": _TEXT, "mode": _TEXT, "limit": _NUMBER, "extension": _TEXT, "doc_type": _TEXT, "path_filter": _TEXT}, ["query"], _search),
    "open": ("Read a chunk, a document or a part of it.", {"id": _NUMBER, "file": _TEXT, "page": _NUMBER, "slide": _NUMBER, "sheet": _TEXT, "section": _TEXT, "symbol": _TEXT, "line_start": _NUMBER, "line_end": _NUMBER, "max_chars": _NUMBER}, [], _open),
    "outline": ("Sections and symbols of a document.", {"file": _TEXT, "id": _NUMBER}, [], _outline),
    "find": ("Find symbols by name.", {"name": _TEXT, "type": _TEXT, "limit": _NUMBER}, ["name"], _find),
    "references": ("Where a symbol is used.", {"symbol": _TEXT}, ["symbol"], lambda e, a: e.references(_need(a, "symbol"))),
    "related": ("Neighbours of a symbol or document.", {"target": _TEXT}, ["target"], lambda e, a: e.related(_need(a, "target"))),
    "context": ("Excerpts for a question within a token budget.", {"query": _TEXT, "max_tokens": _NUMBER, "mode": _TEXT, "extension": _TEXT, "include_relationships": _FLAG}, ["query"], _context),
}


class Server:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def handle(self, text: str) -> dict | None:
        """The answer to one request; None for a notification."""
        try:
            request = json.loads(text)
            method, key = request["method"], request.get("id")
        except (ValueError, KeyError, TypeError, AttributeError):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "parse error"}}
        answer = lambda **x: {"jsonrpc": "2.0", "id": key, **x}
        if method == "initialize":
            return answer(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "folioscope", "version": "0.1.0"}})
        if method.startswith("notifications/") or method == "initialized":
            return None
        if method == "ping":
            return answer(result={})
        if method == "tools/list":
            return answer(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r, _) in TOOLS.items()]})
        if method == "tools/call":
            return answer(**self._call(request.get("params") or {}))
        return answer(error={"code": NO_METHOD, "message": f"no method {method}"})

    def _call(self, params: dict) -> dict:
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            return {"error": {"code": BAD_PARAMETERS, "message": f"no tool {name}"}}
        started, ok = time.perf_counter(), True
        try:
            result = TOOLS[name][3](self.engine, args)
            text = result if isinstance(result, str) else json.dumps(result, indent=2, ensure_ascii=False, default=str)
        except Exception as e:  # noqa: BLE001 - a tool's failure is a result, not a protocol error
            text, ok = f"Error: {e}", False
        self.engine.metrics.record_call(name, (time.perf_counter() - started) * 1000, ok)
        return {"result": {"content": [{"type": "text", "text": text}], "isError": not ok}}

    def serve(self, source: BinaryIO | None = None, sink: BinaryIO | None = None) -> None:
        """Requests a line, or framed by a Content-Length header; answered in kind."""
        source, sink = source or sys.stdin.buffer, sink or sys.stdout.buffer
        while line := source.readline():
            framed = line.lower().startswith(b"content-length:")
            if framed:
                size = int(line.split(b":")[1])
                while source.readline().strip():
                    pass
                line = source.read(size)
            if not line.strip():
                continue
            answer = self.handle(line.decode("utf-8", errors="replace"))
            if answer is not None:
                body = json.dumps(answer, ensure_ascii=False).encode()
                sink.write(b"Content-Length: %d\r\n\r\n%s" % (len(body), body) if framed else body + b"\n")
                sink.flush()
