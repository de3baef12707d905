"""An outside call-graph program as a source of edges.

The program is any command that takes ``explore TEXT`` and ``sync`` and keeps its index in a marked
folder of the workspace.  What it prints is searched for headings, which name files, and for type
declarations below them.  Without the folder, or where the program fails, there are no edges.
"""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: The folder that marks a workspace, and the confidence of edges from outside.
MARKER = ".codegraph"
CONFIDENCE = 0.9
_HEADING = re.compile(r"^(?:## |=== )")
_DECLARED = re.compile(r"\b(class|interface|record|struct)\s+(\w+)")


@dataclass
class Explored:
    query: str
    available: bool
    output: str = ""
    #: (kind, name, file) of each declaration.
    symbols: list[tuple[str, str, str]] = field(default_factory=list)


def declarations(output: str) -> list[tuple[str, str, str]]:
    """``(kind, name, file)`` of the type declarations in a program's output."""
    found, file = [], ""
    for line in map(str.strip, output.split("\n")):
        if _HEADING.match(line):
            file = line.lstrip("#= ")
        elif m := _DECLARED.search(line):
            found.append((m[1], m[2], file))
    return found


class CallGraphProgram:
    def __init__(self, command: list[str], workspace: str | None = None, marker: str = MARKER, timeout: float = 60.0) -> None:
        self.command, self.marker, self.timeout = list(command), marker, timeout
        self.workspace = os.path.abspath(workspace or os.getcwd())

    def root(self) -> str | None:
        """The nearest folder upwards that holds the marker; the search ends at a repository's root
        and below the home folder."""
        at, home = self.workspace, os.path.expanduser("~")
        if os.path.isdir(os.path.join(at, self.marker)):
            return at
        while os.path.normcase(at) != os.path.normcase(home):
            if os.path.isdir(os.path.join(at, self.marker)):
                return at
            above = os.path.dirname(at)
            if above == at or os.path.exists(os.path.join(at, ".git")):
                return None
            at = above
        return None

    def available(self) -> bool:
        return self.root() is not None

    def _run(self, *args: str) -> subprocess.CompletedProcess | None:
        try:
            return subprocess.run([*self.command, *args], cwd=self.root() or self.workspace, capture_output=True, text=True, timeout=self.timeout, check=False)
        except (OSError, subprocess.SubprocessError):
            return None

    def explore(self, text: str) -> Explored:
        result = Explored(text, self.available())
        done = self._run("explore", text) if result.available else None
        if done is not None and done.returncode == 0 and done.stdout.strip():
            result.output = done.stdout.strip()
            result.symbols = declarations(result.output)
        return result

    def sync(self) -> bool:
        """Whether the program brought its index up to date."""
        done = self._run("sync")
        return done is not None and done.returncode == 0

    def related(self, spark: SparkSession, name: str) -> DataFrame:
        """Outgoing CALLS edges in the columns of ``graph.related``."""
        rows = [("outgoing", "CALLS", 0, "CodeSymbol", f"{kind} {symbol}", CONFIDENCE) for kind, symbol, _ in self.explore(name).symbols]
        return spark.createDataFrame(rows, "direction string, relationship_type string, neighbour_id bigint, neighbour_type string, neighbour string, confidence double")

    def references(self, spark: SparkSession, name: str) -> DataFrame:
        """REFERENCES edges into the symbol in the columns of ``graph.references``; the source's
        path is the file under whose heading it was printed."""
        rows = [(0, "REFERENCES", 0, name, f"{kind} {symbol}", 0, "CodeSymbol", file, CONFIDENCE) for kind, symbol, file in self.explore(name).symbols]
        return spark.createDataFrame(rows, "edge_id bigint, relationship_type string, target_id bigint, target string, target_kind string, source_id bigint, source_type string, source_path string, confidence double")
