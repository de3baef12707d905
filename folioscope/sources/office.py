"""Office formats from their ZIP and XML parts (P7 to P9), and text in legacy binaries (P10)."""

from __future__ import annotations

import io
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

#: Limit on one unpacked part, so that a crafted archive can't fill a worker's memory.
MAX_PART = 256 * 1024 * 1024


def _section(title: str, content: str, depth: int = 0, **more) -> dict:
    base = {"title": title, "content": content, "depth": depth, "page_number": None, "slide_number": None, "sheet_name": None, "line_start": None, "line_end": None, "metadata": {}}
    return base | more


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path.replace("\\", "/")))[0]


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(e: ET.Element, *tags: str) -> list[ET.Element]:
    return [x for x in e.iter() if _tag(x) in tags]


def _attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


class Package:
    """An Office Open XML archive."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MAX_PART:
            raise ValueError(f"part {name} is too large")
        return ET.fromstring(self.zip.read(name))

    def links(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationships of a part: id -> (type, name of the target part)."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for e in [] if root is None else root:
            target = e.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[e.get("Id", "")] = (e.get("Type", "").rsplit("/", 1)[-1], full)
        return out

    def properties(self) -> dict[str, str]:
        root = self.xml("docProps/core.xml")
        held = {} if root is None else {_tag(e): (e.text or "").strip() for e in root}
        return {k: held[k] for k in ("title", "creator", "subject", "keywords", "description") if held.get(k)}


def _paragraph(e: ET.Element) -> str:
    """Text of a paragraph; tabs and breaks as such."""
    out = []
    for x in e.iter():
        tag = _tag(x)
        if tag == "t":
            out.append(x.text or "")
        elif tag == "tab" and x is not e:
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _table(e: ET.Element) -> str:
    rows = []
    for row in _find(e, "tr"):
        cells = [" ".join(filter(None, (_paragraph(p).strip() for p in _find(c, "p")))) for c in row if _tag(c) == "tc"]
        rows.append(" | ".join(cells))
    return "\n".join(rows)


def parse_docx(path: str, data: bytes) -> dict:
    """Sections by heading styles; a heading without content before the next one is dropped."""
    kind = "doc" if path.lower().endswith(".doc") else "docx"
    try:
        package = Package(data)
        body = _find(package.xml("word/document.xml"), "body")[0]
    except Exception:
        if kind == "docx":
            raise
        text = "\n\n".join(text_strings(data))
        return {"document_type": kind, "language": None, "title": _stem(path), "metadata": {"legacy_format": "true"}, "sections": [_section(_stem(path), text)] if text else [], "symbols": []}
    out: list[dict] = []
    title, depth, lines = "Overview", 0, []

    def flush() -> None:
        content = "\n".join(lines).strip()
        if content:
            out.append(_section(title, content, depth))

    for e in body:
        if _tag(e) == "tbl":
            lines.append(_table(e))
            continue
        if _tag(e) != "p":
            continue
        style = next((_attribute(s, "val") or "" for s in _find(e, "pStyle")), "")
        heading = re.fullmatch(r"heading(\d+)", style.replace(" ", "").lower())
        text = _paragraph(e)
        if heading and text.strip():
            flush()
            title, depth, lines = text.strip(), int(heading[1]), []
        elif text.strip():
            lines.append(text)
    flush()
    meta = package.properties()
    return {"document_type": kind, "language": None, "title": meta.get("title") or _stem(path), "metadata": meta, "sections": out, "symbols": []}


def _cell(c: ET.Element, shared: list[str]) -> str:
    kind = c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _find(c, "t"))
    value = next((v.text or "" for v in c if _tag(v) == "v"), "")
    if kind == "s" and value.strip().isdigit():
        at = int(value)
        return shared[at] if at < len(shared) else ""
    return value


def parse_xlsx(path: str, data: bytes) -> dict:
    """A section for each sheet with content; cells that are empty collapse."""
    kind = "xls" if path.lower().endswith(".xls") else "xlsx"
    try:
        package = Package(data)
        book = package.xml("xl/workbook.xml")
        links = package.links("xl/workbook.xml")
        sheets = [(s.get("name") or "", links[_attribute(s, "id") or ""][1]) for s in _find(book, "sheet")]
    except Exception:
        if kind == "xlsx":
            raise
        text = "\n".join(text_strings(data))
        return {"document_type": kind, "language": None, "title": _stem(path), "metadata": {"legacy_format": "true"}, "sections": [_section("Sheet1", text, sheet_name="Sheet1")] if text else [], "symbols": []}
    root = package.xml("xl/sharedStrings.xml")
    shared = [] if root is None else ["".join(t.text or "" for t in _find(x, "t")) for x in root if _tag(x) == "si"]
    out = []
    for name, part in sheets:
        sheet = package.xml(part)
        rows = [] if sheet is None else [[v for c in r if _tag(c) == "c" and (v := _cell(c, shared)).strip()] for r in _find(sheet, "row")]
        lines = [" | ".join(r) for r in rows if r]
        if lines:
            out.append(_section(name, "\n".join(lines), sheet_name=name, metadata={"rowCount": str(len(lines))}))
    meta = package.properties()
    return {"document_type": kind, "language": None, "title": meta.get("title") or _stem(path), "metadata": meta, "sections": out, "symbols": []}


def _slide(root: ET.Element) -> tuple[str | None, list[str]]:
    """Title and lines of a slide's shapes in order."""
    title, lines = None, []
    for shape in _find(root, "sp", "graphicFrame"):
        if _tag(shape) == "graphicFrame":
            lines += [_table(t) for t in _find(shape, "tbl")]
            continue
        place = next((_attribute(p, "type") for p in _find(shape, "ph")), None)
        text = [t for p in _find(shape, "p") if (t := _paragraph(p).strip())]
        if title is None and place in ("title", "ctrTitle") and text:
            title = " ".join(text)
        else:
            lines += text
    return title, lines


def parse_pptx(path: str, data: bytes) -> dict:
    """A section for each slide with text, in the order of the presentation; empty slides keep
    their number.  Notes follow as ``[Notes: ...]``."""
    kind = "ppt" if path.lower().endswith(".ppt") else "pptx"
    try:
        package = Package(data)
        show = package.xml("ppt/presentation.xml")
        links = package.links("ppt/presentation.xml")
        slides = [links[_rel(s)][1] for s in _find(show, "sldId") if _rel(s) in links]
    except Exception:
        if kind == "pptx":
            raise
        found = text_strings(data)
        parts = [found[i : i + 3] for i in range(0, len(found), 3)]
        return {
            "document_type": kind, "language": None, "title": _stem(path), "metadata": {"legacy_format": "true"},
            "sections": [_section(f"Slide {k}", "\n".join(x), slide_number=k) for k, x in enumerate(parts, 1)], "symbols": [],
        }
    out = []
    for number, part in enumerate(slides, 1):
        root = package.xml(part)
        if root is None:
            continue
        title, lines = _slide(root)
        for type_, target in package.links(part).values():
            notes = package.xml(target) if type_ == "notesSlide" else None
            if notes is not None:
                body = [t for s in _find(notes, "sp") if next((_attribute(p, "type") for p in _find(s, "ph")), None) in (None, "body") for p in _find(s, "p") if (t := _paragraph(p).strip())]
                if body:
                    lines.append(f"[Notes: {' '.join(body)}]")
        if title or lines:
            out.append(_section(title or f"Slide {number}", "\n".join(([title] if title else []) + lines), slide_number=number))
    meta = package.properties() | {"slideCount": str(len(slides))}
    return {"document_type": kind, "language": None, "title": meta.get("title") or _stem(path), "metadata": meta, "sections": out, "symbols": []}


def _rel(e: ET.Element) -> str:
    """The relationship id of an element that also has an id of its own."""
    return next((v for k, v in e.attrib.items() if k.startswith("{") and k.endswith("}id")), "")


def text_strings(data: bytes, least: int = 4) -> list[str]:
    """P10: runs of printable text in a binary, UTF-16LE at even offsets first, then ASCII; with
    three letters or digits and these being 40 % or more; once each, in order."""
    out: list[str] = []
    for m in re.finditer(rb"(?:[\t\n\r\x20-\x7e]\x00)+", data):
        # Runs begin at even offsets; one found at an odd offset is high and low bytes swapped.
        text = m.group()[::2].decode("ascii") if m.start() % 2 == 0 else ""
        if len(text) >= least:
            out.append(text)
    for m in re.finditer(rb"[\t\n\r\x20-\x7e]{%d,}" % least, data):
        out.append(m.group().decode("ascii"))
    kept = []
    for s in (x.strip() for x in out):
        n = sum(c.isalnum() for c in s)
        if len(s) >= least and n >= 3 and n >= 0.4 * len(s) and not (s.startswith("Microsoft") and s.endswith("Document")):
            kept.append(s)
    return list(dict.fromkeys(kept))
