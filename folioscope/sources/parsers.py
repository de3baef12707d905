"""File-format parsers: bytes of a file become sections and symbols.

``parse(path, data)`` never raises: what goes wrong is returned in ``error``.  Parsers are found
by extension in ``PARSERS``; further ones can be registered (D1).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from folioscope.sources import csharp, office, pdf


def section(title: str, content: str, depth: int = 0, **more) -> dict:
    base = {"title": title, "content": content, "depth": depth, "page_number": None, "slide_number": None, "sheet_name": None, "line_start": None, "line_end": None, "metadata": {}}
    return base | more


def symbol(name: str, kind: str, start: int, end: int, content: str, namespace: str | None = None, signature: str | None = None, parent: int | None = None) -> dict:
    return {"name": name, "kind": kind, "namespace": namespace, "signature": signature, "line_start": start, "line_end": end, "parent": parent, "content": content}


def decode(data: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16 with mark; bytes that are no UTF-8 become U+FFFD."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, errors="replace")
    return data.decode("utf-8", errors="replace")


def _names(path: str) -> tuple[str, str]:
    name = os.path.basename(path.replace("\\", "/"))
    return name, os.path.splitext(name)[0]


def _lines(text: str) -> list[str]:
    return [x.removesuffix("\r") for x in text.split("\n")]


def _whole(path: str, text: str, kind: str, language: str | None = None) -> dict:
    name, stem = _names(path)
    return {"document_type": kind, "language": language, "title": stem, "metadata": {}, "sections": [section(name, text, line_start=1, line_end=len(text.split("\n")))], "symbols": []}


def parse_text(path: str, data: bytes) -> dict:
    return _whole(path, decode(data), "document")


def parse_data(path: str, data: bytes) -> dict:
    return _whole(path, decode(data), "data")


HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def parse_markdown(path: str, data: bytes) -> dict:
    """Sections by headings, code fences included.  A first heading without content is dropped;
    later ones are kept; text before any heading is '(preamble)', a file without any '(document)'."""
    lines = _lines(decode(data))
    _, stem = _names(path)
    title = next((x.strip()[2:].strip() for x in lines if x.strip().startswith("# ")), stem)
    out: list[dict] = []
    head, depth, start, body = "", 0, 1, []

    def flush(end: int) -> None:
        content = "\n".join(body).strip()
        if content or head:
            out.append(section(head or "(preamble)", content, depth, line_start=start, line_end=end))

    for number, line in enumerate(lines, 1):
        if m := HEADING.match(line):
            if body or out:
                flush(number - 1)
            head, depth, start, body = m[2].strip(), len(m[1]), number, []
        else:
            body.append(line)
    flush(len(lines))
    if not out:
        out.append(section("(document)", "\n".join(lines).strip(), 0, line_start=1, line_end=len(lines)))
    return {"document_type": "document", "language": None, "title": title, "metadata": {}, "sections": out, "symbols": []}


CSV_GROUP = 50


def parse_csv(path: str, data: bytes) -> dict:
    _, stem = _names(path)
    lines = _lines(decode(data))
    if lines and lines[-1] == "":
        lines.pop()
    base = {"document_type": "data", "language": None, "title": stem, "metadata": {}, "sections": [], "symbols": []}
    if not lines:
        return base
    header, rows = lines[0], lines[1:]
    base["metadata"] = {"column_count": str(len(header.split(","))), "row_count": str(len(rows)), "headers": header}
    base["sections"].append(section("Headers", header, 0, line_start=1, line_end=1))
    for at in range(0, len(rows), CSV_GROUP):
        part = rows[at : at + CSV_GROUP]
        base["sections"].append(section(f"Rows {at + 1}-{at + len(part)}", "\n".join([header, *part]), 1, line_start=at + 2, line_end=at + len(part) + 1))
    return base


def _code(path: str, text: str, language: str, symbols: list[dict], metadata: dict | None = None) -> dict:
    name, stem = _names(path)
    if symbols:
        parts = [section(s["name"], s["content"], 1, line_start=s["line_start"], line_end=s["line_end"]) for s in symbols]
    else:
        parts = [section(name, text, 0, line_start=1, line_end=len(text.split("\n")))]
    return {"document_type": "code", "language": language, "title": stem, "metadata": metadata or {}, "sections": parts, "symbols": symbols}


# Declarations that are recognised line by line, with the kind of symbol they make.
_EXPORT = r"^\s*(?:export\s+)?(?:default\s+)?"
SCRIPT_DECLARATIONS = (
    ("Class", re.compile(_EXPORT + r"(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)")),
    ("Interface", re.compile(_EXPORT + r"interface\s+([A-Za-z_$][\w$]*)")),
    ("Type", re.compile(_EXPORT + r"type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=")),
    ("Function", re.compile(_EXPORT + r"(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)")),
    ("Function", re.compile(_EXPORT + r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>")),
)
NAME = r"(?:\[?(?P<schema>\w+)\]?\.)?\[?(?P<name>\w+)\]?"
SQL_DECLARATIONS = tuple(
    (kind, re.compile(rf"\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?{word}\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}", re.I))
    for kind, word in (("Class", r"(?:TEMP(?:ORARY)?\s+)?TABLE"), ("Type", r"(?:MATERIALIZED\s+)?VIEW"), ("Method", r"PROC(?:EDURE)?"), ("Function", "FUNCTION"))
)


def _scope_end(lines: list[str], at: int) -> int:
    """Last line number of a declaration: where its braces balance, or a line that ends in ';'
    before any brace; else 20 lines on."""
    depth, opened = 0, False
    for k in range(at, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        opened = opened or "{" in lines[k]
        if opened and depth <= 0 or not opened and lines[k].rstrip().endswith(";"):
            return k + 1
    return min(at + 20, len(lines))


def parse_script(path: str, data: bytes) -> dict:
    text = decode(data)
    lines = _lines(text)
    found = []
    for at, line in enumerate(lines):
        for kind, pattern in SCRIPT_DECLARATIONS:
            if m := pattern.match(line):
                end = _scope_end(lines, at)
                found.append(symbol(m[1], kind, at + 1, end, "\n".join(lines[at:end]), signature=line.strip()))
                break
    language = "typescript" if path.lower().endswith((".ts", ".tsx")) else "javascript"
    return _code(path, text, language, found)


def parse_sql(path: str, data: bytes) -> dict:
    text = decode(data)
    lines = _lines(text)
    found = []
    for at, line in enumerate(lines):
        for kind, pattern in SQL_DECLARATIONS:
            if m := pattern.search(line):
                end = next((k + 1 for k in range(at, len(lines)) if lines[k].rstrip().endswith(";") or lines[k].strip().upper() == "GO"), min(at + 50, len(lines)))
                schema = m["schema"] or ""
                found.append(symbol(f"{schema}.{m['name']}" if schema else m["name"], kind, at + 1, end, "\n".join(lines[at:end]), namespace=schema, signature=line.strip()))
                break
    return _code(path, text, "sql", found)


def parse_razor(path: str, data: bytes) -> dict:
    text = decode(data)
    _, stem = _names(path)
    page = re.search(r"^\s*@page(?:[ \t]+\"([^\"]*)\")?", text, re.M)
    model = re.search(r"^\s*@model[ \t]+([\w.<>\[\], ?]+)", text, re.M)
    metadata, symbols = {}, []
    if page:
        metadata["route"] = page[1] or "/"
    if model:
        name = model[1].strip()
        metadata["model"] = name
        symbols.append(symbol(name, "Class", 1, 1, model[0].strip(), signature=model[0].strip()))
    whole = section("Template View", text, 0, line_start=1, line_end=len(text.split("\n")), metadata={"hasCodeBlock": str(bool(re.search(r"@(?:code|functions)\s*\{", text))).lower()})
    return {"document_type": "code", "language": "cshtml", "title": stem, "metadata": metadata, "sections": [whole], "symbols": symbols}


def parse_csharp(path: str, data: bytes) -> dict:
    text = decode(data)
    found = csharp.symbols(text)
    base = _code(path, text, "csharp", found)
    if found:
        types = ("Class", "Interface", "Struct", "Enum")
        parts = []
        for s in found:
            top = s["parent"] is None
            if s["kind"] in types and top:
                parts.append(section(s["name"], s["content"], 1, line_start=s["line_start"], line_end=s["line_end"]))
            elif s["kind"] not in types and s["parent"] is not None and found[s["parent"]]["parent"] is None:
                parts.append(section(f"{found[s['parent']]['name']}.{s['name']}", s["content"], 2, line_start=s["line_start"], line_end=s["line_end"]))
        base["sections"] = parts
    return base


Parser = Callable[[str, bytes], dict]
PARSERS: dict[str, Parser] = {}


def register(parser: Parser, *extensions: str) -> None:
    """A parser for extensions (with dot); the first one registered for an extension wins."""
    for e in extensions:
        PARSERS.setdefault(e.lower(), parser)


register(parse_markdown, ".md")
register(parse_text, ".txt")
register(parse_csv, ".csv")
register(parse_data, ".json", ".xml")
register(pdf.parse_pdf, ".pdf")
register(office.parse_docx, ".docx", ".doc")
register(office.parse_xlsx, ".xlsx", ".xls")
register(office.parse_pptx, ".pptx", ".ppt")
register(parse_csharp, ".cs")
register(parse_script, ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
register(parse_sql, ".sql")
register(parse_razor, ".cshtml", ".razor")


def parse(path: str, data: bytes) -> dict:
    """A parsed file; ``error`` is null unless it has no parser or can't be read."""
    empty = {"document_type": None, "language": None, "title": None, "metadata": {}, "sections": [], "symbols": []}
    parser = PARSERS.get(os.path.splitext(path)[1].lower())
    if parser is None:
        return {"path": path, **empty, "error": "no parser"}
    try:
        return {"path": path, **parser(path, data), "error": None}
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job
        return {"path": path, **empty, "error": f"{type(e).__name__}: {e}"[:500]}
