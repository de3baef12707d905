"""Problem 3: credentials in source code and configuration, found and redacted in place.

Natural text has four or more characters a subword of a public tokenizer, random keys one or two.
First all runs of characters of every content are counted in subwords (:class:`Naturalness`), and
those with few characters a subword are unnatural.  Contents without such a run hold nothing.  In
the others context rules decide: the name that an unnatural string is assigned to, how it is written
(quoted, bare, in a URL, a header, a comment, a cell, a key block), and the kind of file, taken
from the path.  Whatever the rules find must hold an unnatural run.  Redaction replaces each
character of a value by ``*``, so offsets, line breaks, quotes and all other code stay as they were.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import checked_broadcast, materialise, spread
from folioscope.llm.bpe import DEFAULT_VOCABULARY, Encoder, encoder_of, vocabulary_bytes

#: Characters per subword below which a run of characters is unnatural at all, below which a
#: password may be one (people choose them), a key must be, and a string without digits must be.
RUN_RATIO = 5.2
PASSWORD_RATIO = 4.2
KEY_RATIO = 2.6
DENSE_RATIO = 2.2
#: Shortest value of a key or token, and of a password.
KEY_LENGTH = 12
PASSWORD_LENGTH = 6
#: Runs of which a worker keeps whether they are natural, and the longest that is kept beyond its
#: batch; a full memo is emptied.
MEMO_RUNS = 500_000
MEMO_LONGEST = 128

# Names of credentials, and file kinds in which a bare word is an expression.
PASSWORD_NAMES = r"passw(?:or)?[dt]|passphrase|pass_?word|pwd|pass|kennwort|contrase(?:ñ|n)a|mot de passe|senha|パスワード|密码|identified\s+by"
KEY_NAMES = (
    r"(?:api|access|secret|signing|encryption|subscription|private|account|shared|auth|master|storage|service|license|app|admin|client|webhook|deploy|session|hmac|aes|jwt)[_\- ]?keys?"
    r"|(?:old|new|current|live|prod|real|temporary|temp)[ _\-]keys?"
    r"|secrets?|tokens?|credentials?|pat|authorization"
)
CODE_EXTENSIONS = ("cs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "sql", "cshtml", "razor", "py", "java", "go", "cpp", "c", "h", "php", "rb")
PUBLIC_NAMES = re.compile(r"(?:public|verify|cancellation|csrf|xsrf|antiforgery|page|continuation|next|design|syntax)[_\- ]?(?:key[_\- ]?)?$", re.I)

NAME = re.compile(rf"(?:(?P<password>{PASSWORD_NAMES})|(?P<key>{KEY_NAMES}))(?P<count>\d{{0,2}})(?![A-Za-z0-9_]|-[A-Za-z])", re.I)
#: What every rule below needs somewhere in a content; tested where unnatural runs were found.
CONTEXT = re.compile(r"pass|pwd|kennwort|contrase|senha|パスワード|密码|identified|secret|token|key|credential|pat(?![a-z])|authorization|://|eyJ|(?-i:Bearer|Basic)[ \t]|[?&](?:auth|sig|signature|code)=", re.I)
#: Names whose values are credentials whatever they look like; plain "token" and the like aren't.
FULL_NAME = re.compile(r".+[_\- ](?:keys?|secrets?)|.*[a-z](?:Key|Secret)s?|apikeys?", re.S)
RUN = re.compile(r"[^\s\"'`<>,;|(){}\[\]]{6,}")

QUOTED = r"(?P<prefix>[@$NnbfruR]{0,2})(?P<quote>[\"'`])"
ASSIGN = re.compile(r"[\"'`]?\s?\]?\s*(?:=>|:=|=(?!=)|:(?!:))")
#: In a connection string, a value that itself begins with the sign.
VALUE_OF_EQUALS = re.compile(r"=(?==[^=\s\"'])")
GAP = re.compile(r"[ \t]*(?:(?:[|>][-+]?)?[ \t]*\r?\n[ \t]*(?:-[ \t]+)?)?")
ENV_OR = re.compile(r"[\w.$?\[\]'\"()]+?\s*(?:\|\||\?\?|\bor\b)\s*")
STRING = re.compile(r"[@$NnbfruR]{0,2}(?P<quote>[\"'`])(?P<value>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)")
JOINED = re.compile(r"\s*[+.&]?\s*(?=[\"'`])|\s*\\?\r?\n\s*(?=[\"'`])")
PLUS = re.compile(r"\s*\+\s*|\s*\.\.?\s*(?=[\"'])|\s*&\s*")
BARE = re.compile(r"[^\s\"'`<>;,(){}\[\]]+[^\s\"'`<>,;]*")
ELEMENT = re.compile(r">\s*(?P<value>[^<>\n]*?)\s*</")
ATTRIBUTE = re.compile(r"[\"']\s+(?:\w+\s*=\s*[\"'][^\"'\n]*[\"']\s+)?value\s*=\s*(?P<quote>[\"'])(?P<value>[^\"'\n]*)(?P=quote)", re.I)
SQL_WORD = re.compile(r"\s+(?:=\s*)?N?'(?P<value>[^'\n]*)'")
CELL = re.compile(r"[\"'`]?[ \t]{0,3}(?:,|\t|\||;)[ \t]{0,3}(?P<quote>[\"'`]?)(?P<value>[^\"'`,;|\t\n]+)(?P=quote)(?=[ \t]*(?:[,;|\t)\]\n]|\r|$))")
OF_WHOM = re.compile(r"\s+(?:for|of|to|in|on)\s+[^\s:=]+\s*(?:[:=]|is|was)\s*(?P<value>[^\s\"'`<>]+)")
ONE_WORD = re.compile(r"\s+(?:(?:is|was|to)\s+)?[\"'`]?(?P<value>[^\s\"'`<>,;]+)")
LINE_BEGIN = re.compile(r"[\W_]*")
LINE_END = re.compile(r"[ \t.]*(?:\r?\n|$)")
SCHEME = re.compile(r"(?:Bearer|Basic|Token|ApiKey|Digest)[ \t]+", re.I)

URL_PASSWORD = re.compile(r"\b[a-z][a-z0-9+.\-]{1,20}://(?:[^\s:/@\"'<>]*):(?P<value>[^\s/@\"'<>]{3,})@", re.I)
URL_PARAMETER = re.compile(r"[?&](?:api_?key|access_?token|auth_?token|auth|key|token|secret|sig|signature|code|pwd|password|client_secret|subscription-key)=(?P<value>[^\s&\"'`<>)#]{6,})", re.I)
BEARER = re.compile(r"\b(?P<scheme>Bearer|Basic|Token)[ \t]+(?P<value>[A-Za-z0-9+/=_.\-~:]{12,})")
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_\-])(?P<value>eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})")
#: Begins at the beginning of a word only, so that a very long word is read once.
AS_THE = re.compile(r"(?<![^\s\"'`<>])(?P<value>[^\s\"'`<>]{8,})[\"'`]?\s+(?:as|is|=)\s+(?:the|our|its|an?|your)?\s*(?:\w+\s+){0,2}?(?:" + PASSWORD_NAMES + "|" + KEY_NAMES + r"|key)\b", re.I)
COMMENT = re.compile(r"//|--|#|/\*|<!--|^\s*(?:\*|'|;|REM\b)")
SETTING = ";\"'`?&"
BLOCK_REST = re.compile(r"\A(?P<value>(?:[ \t]*[A-Za-z0-9+/=]+[ \t]*\r?\n)*[A-Za-z0-9+/= \t]*)-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?P<value>.*?)(?:-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)

PLACEHOLDER = re.compile(
    r"""^(?:
        \W*$ | .*\$\{.* | (?-i:\$\(?(?:[A-Z_][A-Z0-9_]*|[a-z_]+)\)?$) | .*\{\{.* | \{[\w.\- ]*\}$ | %[\w.\-]+%$ | %\(?\w+\)?s?$ | <.*>$ | <[a-z][\w\-. ]*$ | \[.*\]$ | \(.*\)$ | \#\{.* | (?-i:\@(?:[A-Z_]+|[a-z_]+)$)
        | [xX*•.\-_\#?]{3,}.{0,4}$ | (.)\1{4,}$
        | (?:.*[_\-\s.])?(?:replace|change|insert|enter|redacted|placeholder|dummy|sample|example|todo|tbd|fixme|masked|hidden|removed|omitted|yours?)(?:[_\-\s.]?(?:me|it|this|here|with|your|by|in|value|password|secret|token|key))*(?:[_\-\s.].*)?$
        | (?:none|null|nil|undefined|true|false|empty|string|str|required|optional|unset|n/?a|set[_\-]in[_\-].*|from[_\-].*|see[_\-].*|your[_\-].*|my[_\-].*|not[_\-]set|default|secret|password|token|key)$
        | (?:process\.env|os\.environ|env|environment|config|configuration|settings|vault|secrets?|keyvault|ssm|arn|op|ref\+\w+|kv|aws|azure|gcp|file)(?:[.:\[(/]|://).*
        | !(?-i:[A-Za-z_.]+)(?:\s.*)?$
    )""",
    re.X | re.I | re.S,
)
REFERENCE = re.compile(r"^(?:[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*|\[[^\]]*\]|\(.*\)?|::\w+|->\w+)+;?|[\w.]+\(.*|(?:/|\./|~/|[A-Za-z]:\\)[\w./\\\-]+|https?://[^@]*)$")
DIGEST_BEFORE = re.compile(r"(?:sha-?(?:1|256|384|512)|md5|checksum|digest|integrity|commit|etag|thumbprint|fingerprint|hash)[\"'\s:=\-]{1,4}$", re.I)


#: Chunks whose spans may be broadcast when contents are redacted.
SPANS_BROADCAST = 200_000
#: Kind of a key block that began before the text: redacted, but no place where a value begins.
REST = "private_key_rest"


def ratio(value: str, encoder: Encoder) -> float:
    """Characters per subword; values of no subword count as natural."""
    n = encoder.subwords(value) if len(value) <= 64 else encoder.count_batch([value])[0]
    return len(value) / n if n else 99.0


class Naturalness:
    """Which runs of characters of texts are unnatural: few characters a subword."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.known, self.long = encoder, {}, []

    def learn(self, texts: list[str]) -> list[bool]:
        """Count the runs of the texts in subwords, and tell which texts hold an unnatural one."""
        runs = [set(RUN.findall(t)) for t in texts]
        known = self.known
        for r in self.long:
            known.pop(r, None)
        if len(known) > MEMO_RUNS:
            known.clear()
        new = list(set().union(*runs).difference(known))
        # Behind a space, as words mostly are in text: there a natural word is one subword.
        known.update((r, len(r) < RUN_RATIO * n) for r, n in zip(new, self.encoder.count_batch([f" {r}" for r in new])))
        self.long = [r for r in new if len(r) > MEMO_LONGEST]
        return [any(map(known.__getitem__, x)) for x in runs]

    def unnatural(self, text: str) -> list[tuple[int, int]]:
        """Begin and end of the unnatural runs of a text that was learned last."""
        known = self.known
        return [m.span() for m in RUN.finditer(text) if known[m.group()]]


def _kinds(value: str) -> int:
    return sum(bool(re.search(x, value)) for x in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))


#: A capital among the last letters of what begins in small ones, unlike the words of an identifier.
ODD_TAIL = re.compile(r"[a-z][A-Z][a-z]{0,3}$|[a-z][A-Z]{2}")


def suspicious(value: str, name: str, bare: bool, encoder) -> bool:
    """Whether a literal under a credential's name is a credential.

    name: "password" or "key"; bare: not quoted, so that plain words need more evidence.
    """
    if PLACEHOLDER.match(value) or REFERENCE.match(value) and not re.search(r"\d.*\d", value) and ratio(value, encoder) > 2.2:
        return False
    if re.fullmatch(r"[\d.,:\-/ ]+", value) or re.search(r"\s", value):
        return False
    if value.startswith(("${", "$(", "{{", "<")) or value.lower().startswith(("sha256", "sha512", "sha1", "md5")):
        return False
    if name == "password":
        if len(value) < PASSWORD_LENGTH:
            return False
        mixed = _kinds(value)
        if bare:
            return mixed >= 2 and (ratio(value, encoder) < PASSWORD_RATIO and bool(re.search(r"\d|[A-Z].*[A-Z]|[^\w.\-]", value)) or ratio(value, encoder) < KEY_RATIO and bool(ODD_TAIL.search(value)))
        return mixed >= 2 and ratio(value, encoder) < RUN_RATIO and bool(re.search(r"\d|[A-Z][a-z]*[A-Z]|[^\w.\-/ ]", value) or ODD_TAIL.search(value)) or ratio(value, encoder) < DENSE_RATIO
    if len(value) < KEY_LENGTH or not re.search(r"[A-Za-z]", value):
        return False
    dense = ratio(value, encoder) < DENSE_RATIO
    return ratio(value, encoder) < KEY_RATIO and bool(re.search(r"\d", value) or dense and (_kinds(value) >= 3 or len(value) >= 20 and re.search(r"[A-Z].*[a-z].*[A-Z].*[a-z].*[A-Z]", value)))


class Finding:
    """A value's spans (several where string literals are joined) and whether it was written bare."""

    __slots__ = ("bare", "kind", "spans")

    def __init__(self, spans: list[tuple[int, int]], kind: str, bare: bool = False) -> None:
        self.spans, self.kind, self.bare = spans, kind, bare


def _literal(text: str, at: int) -> tuple[str, list[tuple[int, int]], int] | None:
    """A string literal at ``at`` with those joined to it by ``+``."""
    value, spans = "", []
    while m := STRING.match(text, at):
        value += m["value"]
        spans.append(m.span("value"))
        at = m.end()
        plus = PLUS.match(text, at) or re.compile(r"\s*\n\s*\+\s*").match(text, at)
        if not plus or not STRING.match(text, plus.end()):
            break
        at = plus.end()
    return (value, spans, at) if spans else None


def _strip_scheme(text: str, value: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], bool]:
    if m := SCHEME.match(value):
        start, end = spans[0]
        return value[m.end() :], [(start + m.end(), end), *spans[1:]], True
    return value, spans, False


def _whole_name(text: str, begin: int, end: int) -> str:
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_-"):
        begin -= 1
    return text[begin:end]


def _after_name(text: str, at: int, name: str, encoder, begin: int = 0) -> Finding | None:
    """The credential that follows a name which begins at ``begin`` and ends at ``at``."""
    ok = lambda value, bare=False: suspicious(value, name, bare, encoder)
    if m := ASSIGN.match(text, at) or (begin and text[begin - 1] in SETTING and VALUE_OF_EQUALS.match(text, at)):
        gap = GAP.match(text, m.end())
        at_value = gap.end()
        if (env := ENV_OR.match(text, at_value)) and STRING.match(text, env.end()):
            at_value = env.end()
        if got := _literal(text, at_value):
            value, spans, _ = got
            if value[:1] in "\"'" and len(value) > 2 and value[:1] == value[-1:]:  # quoted twice
                value, spans = value[1:-1], [(spans[0][0] + 1, spans[0][1] - 1)]
            if m := re.match(r"\\\\?[\"']", value):
                value, spans = value[m.end() :].rstrip("\"'\\"), [(spans[0][0] + m.end(), spans[0][1])]
            value, spans, scheme = _strip_scheme(text, value, spans)
            if scheme and _header(value, encoder) or ok(value):
                return Finding(spans, name)
            return None
        start = at_value
        if s := SCHEME.match(text, start):
            start = s.end()
        if m := BARE.match(text, start):
            value = m.group()
            value = value.rstrip(".;,:") if not value.endswith("==") else value
            setting = text[at : at + 1] == "=" and text[m.end() : m.end() + 1] in (";", '"', "'", "`")
            # Alone in its line behind the name, a password may lack capitals and digits.
            alone = name == "password" and len(value) >= 8 and not PLACEHOLDER.match(value) and LINE_BEGIN.fullmatch(text, text.rfind("\n", 0, begin) + 1, begin) and LINE_END.match(text, m.end())
            if ok(value, True) or alone and re.fullmatch(r"[A-Za-z]+", value) and ratio(value, encoder) < DENSE_RATIO or setting and name == "password" and len(value) >= PASSWORD_LENGTH and not PLACEHOLDER.match(value) and ratio(value, encoder) < 3.6 or start != at_value and _header(value, encoder):
                return Finding([(start, start + len(value))], name, bare=True)
        return None
    for pattern, bare in ((ATTRIBUTE, False), (ELEMENT, False), (SQL_WORD, False), (CELL, False), (OF_WHOM, True)):
        if m := pattern.match(text, at):
            value, spans, scheme = _strip_scheme(text, m["value"].rstrip(), [m.span("value")])
            spans = [(spans[0][0], spans[0][0] + len(value))]
            full = pattern is CELL and FULL_NAME.fullmatch(_whole_name(text, begin, at)) and suspicious(value, "password", False, encoder)
            if (scheme and _header(value, encoder)) or ok(value, bare) or full:
                return Finding(spans, name)
            if pattern is not OF_WHOM:
                return None
    if name == "password" and (m := ONE_WORD.match(text, at)):
        value = m["value"].rstrip(".,;:")
        if suspicious(value, name, True, encoder) and (re.search(r"[A-Za-z].*\d|\d.*[A-Za-z]", value) or ratio(value, encoder) < KEY_RATIO and ODD_TAIL.search(value)):
            return Finding([(m.start("value"), m.start("value") + len(value))], name)
    return None


def _header(value: str, encoder) -> bool:
    """Whether what follows an authorisation scheme is a credential."""
    if PLACEHOLDER.match(value) or len(value) < 8 or re.search(r"\s", value):
        return False
    try:  # user:password
        if re.match(rb"[\x21-\x7e]+:[\x21-\x7e]+$", base64.b64decode(value + "=" * (-len(value) % 4), validate=True)):
            return True
    except ValueError:
        pass
    return suspicious(value, "key", False, encoder)


def find_secrets(text: str, encoder: Encoder, runs: list[tuple[int, int]] | None = None) -> list[Finding]:
    """All credentials of a text in the order in which they begin, none inside another.

    ``runs``: the text's unnatural runs in order, by default counted here; no finding is without
    one (a run may be longer than the value, or shorter).
    """
    if runs is None:
        own = Naturalness(encoder)
        own.learn([text])
        runs = own.unnatural(text)
    if not runs or not CONTEXT.search(text):
        return []
    begins = [a for a, _ in runs]

    def odd(a: int, b: int) -> bool:
        k = bisect_left(begins, b) - 1
        return k >= 0 and runs[k][1] > a

    found: list[Finding] = []
    for m in BLOCK.finditer(text):
        body = re.sub(r"\\[nr]|\s|Proc-Type:.*|DEK-Info:.*", "", m["value"])
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 32 and not re.search(r"\.{3}|[*xX]{8}|redacted|\$\{|\{\{", body, re.I) and odd(*m.span("value")):
            found.append(Finding([m.span()], "private_key"))
    if (m := BLOCK_REST.match(text)) and m["value"].strip() and odd(*m.span("value")):
        found.append(Finding([m.span("value")], REST))
    taken = [(f.spans[0][0], f.spans[-1][1]) for f in found]

    def add(new: Finding | None) -> None:
        if new is None or new.spans[0][0] >= new.spans[-1][1] or not any(odd(*x) for x in new.spans):
            return
        a, b = new.spans[0][0], new.spans[-1][1]
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            found.append(new)

    for m in URL_PASSWORD.finditer(text):
        v = m["value"]
        if not PLACEHOLDER.match(v) and len(v) >= 5 and (ratio(v, encoder) < PASSWORD_RATIO or _kinds(v) >= 3):
            add(Finding([m.span("value")], "password"))
    line_begin, mark = 0, None
    for m in NAME.finditer(text):
        name = "password" if m["password"] else "key"
        before = text[max(0, m.start() - 24) : m.start()]
        if PUBLIC_NAMES.search(before) or m.group().lower() in ("pass", "pat") and before[-1:].isalpha() and not (before[-1:].islower() and m.group()[:1].isupper()):
            continue
        new = _after_name(text, m.end(), name, encoder, m.start())
        if new and new.bare:
            begin = text.rfind("\n", line_begin, m.start()) + 1
            if begin > line_begin or mark is None:  # the first mark of each line is sought once
                line_begin = max(begin, line_begin)
                end = text.find("\n", m.start())
                first = COMMENT.search(text[line_begin : end if end >= 0 else len(text)])
                mark = line_begin + first.end() if first else len(text) + 1
            at = m.start()
            while at > line_begin and text[at - 1] in " \t":
                at -= 1
            # A setting of a connection string or URL, or a comment, is no expression.
            new.bare = not (at > line_begin and text[at - 1] in SETTING and text[m.end() : m.end() + 1] == "=" or mark <= m.start())
        add(new)
    for m in URL_PARAMETER.finditer(text):
        if suspicious(m["value"], "key", False, encoder):
            add(Finding([m.span("value")], "key"))
    for m in BEARER.finditer(text):
        if _header(m["value"], encoder) and not DIGEST_BEFORE.search(text[max(0, m.start() - 20) : m.start()]):
            add(Finding([m.span("value")], "key"))
    for m in WEB_TOKEN.finditer(text):
        add(Finding([m.span("value")], "key"))
    for m in AS_THE.finditer(text):
        v = m["value"]
        if suspicious(v, "key", False, encoder) and not DIGEST_BEFORE.search(text[max(0, m.start() - 20) : m.start()]):
            add(Finding([m.span("value")], "key"))
    return sorted(found, key=lambda f: f.spans[0])


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each character of the spans replaced by ``*``; line breaks, also escaped ones,
    and the first and last line of a key block stay."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        out.append(re.sub(r"-----(?:BEGIN|END)[A-Z0-9 ]*-----|\\[nr]|[^\r\n]", lambda m: m.group() if len(m.group()) > 1 else "*", text[a:b]))
        at = b
    return "".join(out) + text[at:]


def is_code(path):
    """Column: whether the path's extension names a programming language; false for null."""
    return F.coalesce(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*CODE_EXTENSIONS), F.lit(False))


def secret_places(chunks: DataFrame, documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(chunk_id, line_no, start, end, kind)`` for each span of each credential in ``content``.

    ``line_no`` is 1-based by ``\\n`` and the same for all spans of one joined value, namely that of
    its begin; ``start`` and ``end`` are 0-based code points.  A value that is not quoted counts
    only where the path of the chunk's document isn't that of a programming language; chunks
    without a document or path count as text.  Rows delivered twice give one row.  Null and empty
    contents give none.  Contents aren't shuffled: only findings are joined with the paths.
    """
    held = chunks.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    rows = chunks.where("content <> ''").select(F.col("id").cast("bigint"), F.col("document_id").cast("bigint"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        natural = Naturalness(encoder)
        for batch in batches:
            out: list[tuple] = []
            keys, documents, texts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(texts), 1000):
                part = slice(at, at + 1000)
                for key, document, text, some in zip(keys[part], documents[part], texts[part], natural.learn(texts[part])):
                    if not some or not CONTEXT.search(text):
                        continue
                    for f in find_secrets(text, encoder, natural.unnatural(text)):
                        line = text.count("\n", 0, f.spans[0][0]) + 1
                        out += [(key, document, line, a, b, f.kind, f.bare) for a, b in f.spans]
            columns = zip(*out) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = ["chunk_id", "document_id", "line_no", "start", "end", "kind", "bare"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = materialise(spread(rows, "id").mapInArrow(run, "chunk_id bigint, document_id bigint, line_no bigint, start bigint, end bigint, kind string, bare boolean"), "places")
    # Bare values need their document's path; each document is looked up once, however many it has.
    asked = checked_broadcast(materialise(found.where("bare").select("document_id").distinct(), "asked"))
    code = documents.where(is_code(F.col("path"))).select(F.col("doc_id").cast("bigint").alias("document_id")).join(asked, "document_id", "left_semi")
    barely = found.where("bare").join(checked_broadcast(materialise(code, "code")), "document_id", "left_anti")
    columns = ["chunk_id", "line_no", "start", "end", "kind"]
    return found.where("not bare").select(columns).unionByName(barely.select(columns)).distinct()


def redacted_chunks(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """``(chunk_id, content, n_secrets)``: every distinct chunk, its credentials replaced.

    The number of code points and all line breaks stay as they were.  Null contents stay null.
    """
    spans = materialise(places.groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    rows = chunks.select(F.col("id").cast("bigint").alias("chunk_id"), "content")
    # Contents delivered twice are told by their ids, so that only theirs are shuffled.
    again = checked_broadcast(materialise(rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"), "again"))
    once = rows.join(again, "chunk_id", "left_anti").unionByName(rows.join(again, "chunk_id", "left_semi").dropDuplicates(["chunk_id"]))
    rows = once.join(checked_broadcast(spans, SPANS_BROADCAST), "chunk_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, all_spans = (batch.column(i).to_pylist() for i in range(3))
            done = [redact(t, [(s["start"], s["end"]) for s in x]) if x and t is not None else t for t, x in zip(texts, all_spans)]
            counts = [len(x or ()) for x in all_spans]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(done, pa.string()), pa.array(counts, pa.int32())], names=["chunk_id", "content", "n_secrets"])

    return rows.mapInArrow(run, "chunk_id bigint, content string, n_secrets int")


def secret_lines(places: DataFrame) -> DataFrame:
    """``(chunk_id, line_no)`` of :func:`secret_places`, once each, where a value begins."""
    return places.where(F.col("kind") != REST).select("chunk_id", "line_no").distinct()
