"""Symbols of C# files without a grammar (P11): a tokenizer that knows strings and comments, and
a scan of declarations by brace depth.

Types may nest; methods, constructors and properties belong to the innermost type.  Namespaces are
an attribute.  Fields, events, delegates and local functions are no symbols.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# Comments and literals, which may hold braces and words of any kind: raw, verbatim, interpolated,
# plain strings; characters; preprocessor lines.
_SKIP = re.compile(
    r'//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#[^\n]*|\$*"""+.*?"""+|(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)|\$?"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])+\'',
    re.S | re.M,
)
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|ref|unsafe|new|file|virtual|override|async|extern|required|volatile)\s+)*"
_ATTRIBUTES = r"(?:\[[^\]]*\]\s*)*"
_TYPE = re.compile(rf"\s*{_ATTRIBUTES}{_MODIFIERS}(?P<kind>class|interface|struct|record\s+struct|record\s+class|record|enum)\s+(?P<name>@?[A-Za-z_]\w*)")
_NAMESPACE = re.compile(r"\s*namespace\s+(?P<name>[\w.]+)\s*$")
_PARAMETERS = r"\((?P<params>(?:[^()]|\([^()]*\))*)\)"
_METHOD = re.compile(rf"\s*{_ATTRIBUTES}{_MODIFIERS}(?P<ret>[A-Za-z_@][\w.]*(?:\s*<.*?>)?(?:\s*\?)?(?:\s*\[[,\s]*\])*|\([^()]*\))\s+(?:[\w.<>]+\.)?(?P<name>@?[A-Za-z_]\w*)\s*(?:<[^<>()]*(?:<[^<>]*>)?[^<>()]*>)?\s*{_PARAMETERS}\s*(?:where\b.*)?$", re.S)
_CONSTRUCTOR = re.compile(rf"\s*{_ATTRIBUTES}{_MODIFIERS}(?P<name>@?[A-Za-z_]\w*)\s*{_PARAMETERS}\s*(?::\s*(?:base|this)\s*\(.*\))?\s*$", re.S)
_PROPERTY = re.compile(rf"\s*{_ATTRIBUTES}{_MODIFIERS}(?P<ret>[A-Za-z_@][\w.]*(?:\s*<.*?>)?(?:\s*\?)?(?:\s*\[[,\s]*\])*)\s+(?:[\w.<>]+\.)?(?P<name>@?[A-Za-z_]\w*)\s*$", re.S)
_NO_RETURN = frozenset("return new await throw yield else using namespace goto case in is as var out where if while for foreach switch lock catch event delegate const".split())
_KINDS = {"class": "Class", "interface": "Interface", "struct": "Struct", "enum": "Enum"}


def _blank(text: str) -> str:
    """The text with comments and literals as blanks, offsets and line breaks kept."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(text: str, at: int) -> int:
    """Offset of the brace that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


def symbols(source: str) -> list[dict]:
    """Symbols in pre-order, each with the position of its enclosing type as ``parent``."""
    text = _blank(source)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    out: list[dict] = []

    def add(name: str, kind: str, begin: int, end: int, namespace: str | None, signature: str | None, parent: int | None) -> int:
        begin += len(text[begin:end]) - len(text[begin:end].lstrip())
        content = "\n".join(x.removesuffix("\r") for x in source.split("\n")[line(begin) - 1 : line(end)])
        out.append({"name": name.lstrip("@"), "kind": kind, "namespace": namespace, "signature": signature, "line_start": line(begin), "line_end": line(end), "parent": parent, "content": content})
        return len(out) - 1

    def walk(at: int, end: int, namespace: str | None, parent: int | None) -> None:
        """Members between two offsets; ``parent`` is None outside types."""
        begin = at
        while at < end:
            m = re.compile(r"[;{}]").search(text, at, end)
            if not m:
                return
            head, mark = text[begin : m.start()], m.group()
            if mark == "}":
                begin = at = m.end()
                continue
            stop = _close(text, m.start()) if mark == "{" else m.start()
            if t := _TYPE.match(head):
                kind = _KINDS.get(t["kind"].split()[-1] if t["kind"] != "record" else "class", "Class")
                kind = "Class" if t["kind"].startswith("record") else kind
                own = add(t["name"], kind, begin, stop, namespace, None, parent)
                if mark == "{" and kind != "Enum":
                    walk(m.end(), stop, namespace, own)
            elif n := _NAMESPACE.match(head):
                if mark == ";":
                    namespace = n["name"]
                else:
                    walk(m.end(), stop, ".".join(x for x in (namespace, n["name"]) if x), parent)
            elif parent is not None:
                _member(head, mark, begin, m.start(), stop, namespace, parent)
                if mark == "{":  # a property's initialiser belongs to it
                    rest = re.compile(r"\s*=[^;]*;").match(text, stop + 1)
                    stop = rest.end() - 1 if rest and not head.rstrip().endswith(")") else stop
            begin = at = stop + 1

    def _member(head: str, mark: str, begin: int, at: int, stop: int, namespace: str | None, parent: int) -> None:
        body = re.search(r"=>", head)
        plain = head[: body.start()] if body else head
        if "=" in re.sub(r"\([^()]*\)|==|<=|>=", "", plain):  # a field with a value
            return
        squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
        owner = out[parent]["name"]
        if (c := _CONSTRUCTOR.match(plain)) and c["name"].lstrip("@") == owner:
            add(owner, "Constructor", begin, stop, namespace, f"{owner}({squeeze(c['params'])})", parent)
        elif (c := _METHOD.match(plain)) and re.split(r"[\s<\[?(]", c["ret"].strip())[0] not in _NO_RETURN:
            add(c["name"], "Method", begin, stop, namespace, f"{squeeze(c['ret'])} {c['name'].lstrip('@')}({squeeze(c['params'])})", parent)
        elif (mark == "{" or body) and (c := _PROPERTY.match(plain)) and re.split(r"[\s<\[?]", c["ret"].strip())[0] not in _NO_RETURN:
            add(c["name"], "Property", begin, stop, namespace, f"{squeeze(c['ret'])} {c['name'].lstrip('@')}", parent)

    walk(0, len(text), None, None)
    return out
