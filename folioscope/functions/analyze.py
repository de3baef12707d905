"""Text analysis for full-text search: tokens, stop words, stemming, query syntax.

Two analysers: ``simple`` (runs of letters and digits in lower case, as an expression) and
``english`` (the same tokens without stop words, stemmed by Porter's second algorithm; stop words
still take up positions).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
_TOKEN = regex.compile(TOKEN)
#: Positions beyond this are clamped to it; more positions of one term are dropped.
LAST_POSITION = 16_383
POSITIONS_PER_TERM = 256

# The usual English stop words of a full-text index.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, as ``array<string>``."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


# --- stemming ------------------------------------------------------------------------------

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words that the algorithm treats apart, and its suffix tables.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Starts of the regions R1 and R2."""

    def after(at: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, at)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    return bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter's second English stemmer; other scripts and numbers come back unchanged."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _INVARIANT:
        return word
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for suffix in ("'s'", "'s", "'"):
        if w.endswith(suffix):
            w = w[: -len(suffix)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # past tenses and gerunds
    if w.endswith(("eedly", "eed")):
        suffix = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(suffix) >= r1:
            w = w[: -len(suffix)] + "ee"
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suffix):
                rest = w[: -len(suffix)]
                if re.search(r"[aeiouy]", rest):
                    if rest.endswith(("at", "bl", "iz")):
                        rest += "e"
                    elif rest.endswith(_DOUBLE):
                        rest = rest[:-1]
                    elif _short_syllable(rest) and r1 >= len(rest):
                        rest += "e"
                    w = rest
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for suffix in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if len(head) >= r1:
                if suffix == "ogi":
                    w = head + "og" if head.endswith("l") else w
                elif suffix == "li":
                    w = head if head[-1:] in tuple("cdeghkmnrt") else w
                else:
                    w = head + _STEP2[suffix]
            break
    for suffix in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if len(head) >= r1:
                if suffix == "ative":
                    w = head if len(head) >= r2 else w
                else:
                    w = head + _STEP3[suffix]
            break
    for suffix in (*_STEP4, "ion"):
        if w.endswith(suffix) and not (suffix in ("ent", "ment") and w.endswith("ement")) and not (suffix == "ent" and w.endswith("ment")):
            head = w[: -len(suffix)]
            if len(head) >= r2 and (suffix != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):
        head = w[:-1]
        if len(head) >= r2 or len(head) >= r1 and not _short_syllable(head):
            w = head
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def word_parts(term: str, analyzer: str = "english") -> list[str]:
    """Strings of which each word with that term contains one.

    Stemming changes at most the last two letters of what it keeps of a word, apart from the words
    that the algorithm treats by themselves, which are listed whole.
    """
    if analyzer == "simple":
        return [term]
    return [term[: max(2, len(term) - 2)], *(w for w, t in _SPECIAL.items() if t == term)]


def terms(text: str | None, analyzer: str = "english") -> list[tuple[str, int]]:
    """Terms of a text with their 1-based positions."""
    out = []
    for at, token in enumerate(_TOKEN.findall((text or "").lower()), 1):
        if analyzer == "simple":
            out.append((token, min(at, LAST_POSITION)))
        elif token not in STOP_WORDS:
            out.append((stem(token), min(at, LAST_POSITION)))
    return out


_POSTINGS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def positions(text: str | None, analyzer: str = "english") -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for term, at in terms(text, analyzer):
        held = found.setdefault(term, [])
        if len(held) < POSITIONS_PER_TERM and (not held or held[-1] != at):
            held.append(at)
    return found


@F.pandas_udf(_POSTINGS)
def english_postings(text: pd.Series) -> pd.Series:
    """Postings of a text under the english analyser."""
    return text.map(lambda t: [{"term": k, "positions": v} for k, v in positions(t).items()])


# --- queries ---------------------------------------------------------------------------------


@dataclass
class Phrase:
    """Terms at fixed distances: (term, offset from the first)."""

    terms: list[tuple[str, int]]
    negated: bool = False


@dataclass
class WebQuery:
    """A disjunction of conjunctions of phrases (a word is a phrase of one term)."""

    groups: list[list[Phrase]] = field(default_factory=list)

    @property
    def words(self) -> list[str]:
        """Positive terms, once each, in order."""
        return list(dict.fromkeys(t for g in self.groups for p in g if not p.negated for t, _ in p.terms))

    @property
    def all_words(self) -> list[str]:
        return list(dict.fromkeys(t for g in self.groups for p in g for t, _ in p.terms))


def parse_web_query(text: str | None, analyzer: str = "english") -> WebQuery:
    """Web-search syntax: words are joined by and, ``"..."`` is a phrase, ``or`` separates
    alternatives, a leading ``-`` excludes.  Never raises; a query of stop words only is empty."""
    groups: list[list[Phrase]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', text or ""):
        word = m.group(3)
        if word and word.lower() == "or":
            groups.append([])
            continue
        negated = bool(m.group(1)) if word is None else word.startswith("-")
        inner = m.group(2) if word is None else word.lstrip("-")
        found = terms(inner, analyzer)
        if found:
            first = found[0][1]
            groups[-1].append(Phrase([(t, p - first) for t, p in found], negated))
    return WebQuery([g for g in groups if g])
