"""Configuration: defaults are part of the semantics."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class EmbeddingConfig:
    provider: str = "none"
    model: str = "nomic-embed-text"
    dimension: int = 768
    endpoint: str = "http://localhost:11434"
    api_key: str | None = None
    batch_size: int = 32


@dataclass
class IndexingConfig:
    roots: list[str] = field(default_factory=lambda: ["./"])
    # Directories that are never entered.
    ignore: list[str] = field(default_factory=lambda: ["node_modules", "bin", "obj", ".git", ".vs", ".idea", "packages", "dist", "build", ".codegraph"])
    max_file_size_bytes: int = 50 * 1024 * 1024
    max_parallelism: int = 4
    include_extensions: list[str] = field(default_factory=list)
    exclude_extensions: list[str] = field(default_factory=list)


@dataclass
class SearchConfig:
    fts_weight: float = 0.4
    semantic_weight: float = 0.6
    default_limit: int = 10
    max_preview_length: int = 300
    rrf_k: int = 60


@dataclass
class SecurityConfig:
    allowed_roots: list[str] = field(default_factory=list)  # empty: the working directory
    enforce_allowed_roots: bool = True
    max_file_size_bytes: int = 50 * 1024 * 1024
    # Extensions that are never opened.
    restricted_extensions: list[str] = field(default_factory=lambda: [".exe", ".dll", ".so", ".dylib", ".bin", ".env", ".pem", ".key", ".pfx", ".p12"])
    sanitize_content: bool = True


@dataclass
class EngineConfig:
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    indexing: IndexingConfig = field(default_factory=IndexingConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    security: SecurityConfig = field(default_factory=SecurityConfig)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        """Unknown keys are ignored; keys may be written in snake or camel case."""
        raw = json.loads(text) or {}
        flat = lambda name: name.replace("_", "").lower()

        def fill(kind: type, values: dict) -> object:
            known = {flat(k): v for k, v in values.items()}
            return kind(**{f.name: known[flat(f.name)] for f in dataclasses.fields(kind) if flat(f.name) in known})

        parts = {flat(k): v for k, v in raw.items() if isinstance(v, dict)}
        return cls(*(fill(kind, parts.get(name, {})) for name, kind in (("embedding", EmbeddingConfig), ("indexing", IndexingConfig), ("search", SearchConfig), ("security", SecurityConfig))))


FILE_NAME = "folioscope.json"


def load_config(explicit: str | None = None, cwd: str | None = None) -> EngineConfig:
    """Named file, else FOLIOSCOPE_CONFIG, else upwards from ``cwd``, else ~/.folioscope, else defaults."""
    here = Path(cwd or os.getcwd()).resolve()
    places = [Path(x) for x in (explicit, os.environ.get("FOLIOSCOPE_CONFIG")) if x]
    places += [d / FILE_NAME for d in (here, *here.parents)] + [Path.home() / ".folioscope" / FILE_NAME]
    for place in places:
        if place.is_file():
            return EngineConfig.from_json(place.read_text(encoding="utf-8"))
    return EngineConfig()
