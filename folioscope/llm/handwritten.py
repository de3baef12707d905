"""Problem 5: generated, minified, vendored and data files among source code.

Each file is lexed and re-emitted in a canonical layout (one statement or block edge a line), and
the original layout is compared with it.  Extreme expansion, few original lines against many
canonical ones, marks minified files.  Perfect uniformity, the same line skeleton again and again
once names and literals are blanked, marks the output of a tool.  Dominance of literals marks data
saved as code.  Vendored copies look hand-written; they are told by the known package that the
path or the banner names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import spread

#: Canonical lines a line of code, and characters a line, from which a file counts as minified.
EXPANSION = 4.0
MINIFIED_LINE = 200
#: Share of code lines under the few commonest skeletons from which a file counts as generated,
#: the number of such skeletons, and the fewest lines for which the share means something.
UNIFORM_SHARE = 0.985
UNIFORM_SKELETONS = 3
UNIFORM_LINES = 6
#: Share of a file's characters in literals from which it counts as data, and the fewest characters
#: for which the share means something.
LITERAL_SHARE = 0.72
DATA_CHARACTERS = 400

LEX = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|@\*.*?(?:\*@|\Z)|<!--.*?(?:-->|\Z)|//[^\n]*|--[^\n]*)
    |(?P<string>@"(?:[^"]|"")*(?:"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z))
    |(?P<number>\b\d[\w.]*)
    |(?P<word>[^\W\d]\w*|[@\$\#]\w+)
    |(?P<line>\n)
    |(?P<space>[^\S\n]+)
    |(?P<other>.)""",
    re.X | re.S,
)

# How tools announce their output, and where copies of packages are kept.
MARKER = re.compile(
    r"(?:auto[-\s]?generated|@generated|<auto-generated|generated (?:file|code|by|from|automatically)|machine[- ]made|do not (?:edit|modify)|"
    r"code emitted by|(?:is|was) produced by|created by .{1,40} tool|automatisch .{0,60}erzeugt|automatisch generiert|généré par|généré automatiquement|"
    r"generado (?:por|autom)|no (?:editar|modificar)|gerado (?:por|autom)|não (?:editar|modificar)|ne pas modifier|nicht (?:bearbeiten|ändern)|hand edits are lost|自動生成|自动生成|编辑)",
    re.I,
)
PACKAGE_FOLDERS = r"(?:node_modules|bower_components|jspm_packages|vendor|vendors|third[_\-]?party|thirdparty|3rd[_\-]?party|external|externals|deps|packages|lib|libs|contrib|submodules|bundled)"
BANNER = re.compile(r"licen[cs]e|copyright|copied from|upstream|contributors|vendored|\(c\)|released under|^/\*!", re.I)


class Layout:
    """What the comparison of a file with its canonical form measures."""

    __slots__ = ("canonical", "characters", "code_lines", "comment_share", "literal_share", "longest", "skeletons", "uniform", "banner")

    def __init__(self, text: str) -> None:
        text = text.lstrip("﻿")
        counts, skeleton, skeletons, banner = Counter(), [], Counter(), []
        canonical = code_lines = 0
        open_line = started = False
        for m in LEX.finditer(text):
            kind = m.lastgroup
            size = m.end() - m.start()
            if kind == "line":
                if skeleton:
                    skeletons["".join(skeleton)] += 1
                    code_lines += 1
                    skeleton = []
                continue
            counts[kind] += size
            if kind == "space":
                continue
            if kind == "comment":
                if not started:
                    banner.append(m.group())
                continue
            started = True
            if kind == "other":
                mark = m.group()
                skeleton.append(mark)
                if mark in ";{}":
                    canonical += 1
                    open_line = False
                    continue
            else:
                skeleton.append({"word": "I", "number": "N", "string": "S"}[kind])
                if kind == "string":
                    code_lines += m.group().count("\n")
            open_line = True
        if skeleton:
            skeletons["".join(skeleton)] += 1
            code_lines += 1
        self.canonical = canonical + open_line
        self.code_lines = code_lines
        self.skeletons = skeletons
        self.longest = max(map(len, text.split("\n")), default=0)
        ink = sum(v for k, v in counts.items() if k not in ("space", "comment"))
        self.characters = ink
        self.literal_share = (counts["string"] + counts["number"]) / ink if ink else 0.0
        self.comment_share = counts["comment"] / (ink + counts["comment"]) if ink else 1.0
        lines = sum(skeletons.values())
        self.uniform = sum(n for _, n in skeletons.most_common(UNIFORM_SKELETONS)) / lines if lines else 0.0
        self.banner = "\n".join(banner)

    @property
    def expansion(self) -> float:
        return self.canonical / self.code_lines if self.code_lines else 0.0


def package_pattern(names: list[str]) -> re.Pattern | None:
    """Matches any of the package names as a whole word."""
    words = sorted({n.strip().lower() for n in names if n and n.strip()}, key=len, reverse=True)
    return re.compile(r"(?<![a-z0-9_\-])(?:" + "|".join(map(re.escape, words)) + r")(?![a-z0-9_]|-[a-z])", re.I) if words else None


def reason(path: str | None, text: str | None, packages: re.Pattern | None) -> str | None:
    """Why a file is not hand-written: vendored, minified, data, generated; None if it is."""
    if packages and path:
        folders = path.replace("\\", "/").split("/")[:-1]
        for parent, folder in zip(folders, folders[1:]):
            if re.fullmatch(PACKAGE_FOLDERS, parent, re.I) and packages.match(folder):
                return "vendored"
    if not text or not text.strip():
        return None
    x = Layout(text)
    if packages and any(packages.search(part) and BANNER.search(part) for part in x.banner.split("\n\n")):
        return "vendored"
    if x.literal_share >= LITERAL_SHARE and x.characters >= DATA_CHARACTERS:
        return "data"
    if x.longest >= MINIFIED_LINE and x.expansion >= EXPANSION and x.characters / max(x.code_lines, 1) >= MINIFIED_LINE:
        return "minified"
    lines = sum(x.skeletons.values())
    if lines >= UNIFORM_LINES and x.uniform >= UNIFORM_SHARE:
        return "generated"
    if x.banner and MARKER.search(x.banner) and x.uniform >= 0.5:
        return "generated"
    return None


def unwritten_files(documents: DataFrame, packages: DataFrame, max_packages: int = 100_000) -> DataFrame:
    """``(doc_id, reason)`` of the documents of type code that nobody wrote by hand.

    ``packages`` is a fixed list of outside packages; it is read to the driver and refused beyond
    ``max_packages`` names.  Files below ``DATA_CHARACTERS`` are no data and below ``UNIFORM_LINES`` no
    output by uniformity alone: that little text proves neither.  Null and empty texts are judged by their path alone; null paths by
    their text alone.  Repeated rows give one row.  Each file is lexed whole.  No shuffle of texts.
    """
    names = [r[0] for r in packages.select("package_name").where(F.col("package_name").isNotNull()).distinct().limit(max_packages + 1).collect()]
    if len(names) > max_packages:
        raise ValueError(f"more than {max_packages} package names")
    rows = documents.where(F.col("document_type") == "code").select(F.col("doc_id").cast("bigint"), F.col("path"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = package_pattern(names)
        for batch in batches:
            keys, paths, texts = (c.to_pylist() for c in batch.columns)
            out = [(k, why) for k, p, t in zip(keys, paths, texts) if (why := reason(p, t, pattern))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "reason"])

    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, reason string").distinct()
