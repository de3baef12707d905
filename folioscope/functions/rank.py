"""Matching, cover-density ranking and headlines."""

from __future__ import annotations

import re

from folioscope.functions.analyze import STOP_WORDS, WebQuery, _TOKEN, stem

#: Weight of a term position without a label.
WEIGHT = 0.1


def _phrase_hits(phrase: list[tuple[str, int]], held: dict[str, list[int]]) -> list[tuple[int, int]]:
    """Spans at which a phrase occurs."""
    first, *rest = phrase
    sets = [(set(held.get(t, ())), d) for t, d in rest]
    last = phrase[-1][1]
    return [(p, p + last) for p in held.get(first[0], ()) if all(p + d in s for s, d in sets)]


def matches(query: WebQuery, held: dict[str, list[int]]) -> bool:
    return any(all(bool(_phrase_hits(p.terms, held)) != p.negated for p in group) for group in query.groups)


def cover_density(query: WebQuery, held: dict[str, list[int]]) -> float:
    """Sum over all minimal covers of 0.1 / (1 + noise); noise: positions of a cover that hold no
    query term.  A cover is a shortest span that satisfies one of the query's alternatives."""
    covers: set[tuple[int, int]] = set()
    for group in query.groups:
        wanted = [p.terms for p in group if not p.negated]
        if not wanted or any(p.negated and _phrase_hits(p.terms, held) for p in group):
            continue
        spans = [_phrase_hits(p, held) for p in wanted]
        if not all(spans):
            continue
        events = sorted((end, start, k) for k, x in enumerate(spans) for start, end in x)
        latest: dict[int, int] = {}
        for end, start, k in events:
            latest[k] = max(latest.get(k, -1), start)
            if len(latest) == len(spans):
                covers.add((min(latest.values()), end))
    known = {p for t in query.words for p in held.get(t, ())}
    score = 0.0
    for a, b in sorted(_minimal(covers)):
        n = sum(p in known for p in range(a, b + 1)) if b - a < 64 else sum(a <= p <= b for p in known)
        score += WEIGHT / (1 + max(0, (b - a) - (max(n, 1) - 1)))
    return score


def _minimal(covers: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that hold no other one."""
    out, end = [], None
    for a, b in sorted(covers, key=lambda c: (-c[0], c[1])):
        if end is None or b < end:
            out.append((a, b))
            end = b
    return out


def headline(query: WebQuery, text: str | None, analyzer: str = "english", most: int = 35, least: int = 15, short: int = 3) -> str:
    """The earliest window of ``least`` to ``most`` words with the most distinct query terms,
    those in ``<b>``; it doesn't end with a word of ``short`` characters or fewer if it can."""
    text = text or ""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    wanted = set(query.words)
    marks = []
    for a, b in spans:
        w = text[a:b].lower()
        term = w if analyzer == "simple" else (None if w in STOP_WORDS else stem(w))
        marks.append(term if term in wanted else None)
    if not spans:
        return ""
    best, at = -1, 0
    for i, mark in enumerate(marks):
        n = len({t for t in marks[i : i + most] if t}) if mark or not i else -1
        if n > best:
            best, at = n, max(0, min(i, len(spans) - least))
    end = min(at + most, len(spans))
    while end - at > least and spans[end - 1][1] - spans[end - 1][0] <= short and marks[end - 1] is None:
        end -= 1
    out, last = [], spans[at][0]
    for k in range(at, end):
        a, b = spans[k]
        out += [text[last:a], f"<b>{text[a:b]}</b>" if marks[k] else text[a:b]]
        last = b
    return re.sub(r"\s+", " ", "".join(out)).strip()
