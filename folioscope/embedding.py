"""Embedding providers (D3 to D6): functions from texts to vectors."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable

from folioscope.config import EmbeddingConfig

Embedder = Callable[[list[str]], list[list[float] | None]]


class HashingEmbedder:
    """A deterministic provider without a model: signed word hashes, normalised."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        return [self.embed(t) for t in texts]

    def embed(self, text: str) -> list[float] | None:
        v = [0.0] * self.dimension
        for w in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else None


def _post(url: str, body: dict, headers: dict | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=60) as response:
        return json.loads(response.read())


class PromptEmbedder:
    """A server that embeds one prompt a request: ``POST /api/embeddings {model, prompt}``."""

    def __init__(self, config: EmbeddingConfig, post: Callable = _post) -> None:
        self.config, self.post, self.dimension = config, post, config.dimension

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        url = self.config.endpoint.rstrip("/") + "/api/embeddings"
        return [self.post(url, {"model": self.config.model, "prompt": t})["embedding"] for t in texts]


class BatchEmbedder:
    """A server that embeds many inputs a request: ``POST /v1/embeddings {model, input}`` with a
    bearer key; the answer is put in order by its index."""

    def __init__(self, config: EmbeddingConfig, post: Callable = _post) -> None:
        self.config, self.post, self.dimension = config, post, config.dimension

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        base = self.config.endpoint.rstrip("/")
        headers = {"Authorization": f"Bearer {self.config.api_key}"} if self.config.api_key else {}
        data = self.post(base + ("/embeddings" if base.endswith("/v1") else "/v1/embeddings"), {"model": self.config.model, "input": texts}, headers)["data"]
        return [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]


def provider(config: EmbeddingConfig) -> Embedder | None:
    """The configured provider; None for text search only."""
    kinds = {"none": None, "hashing": lambda c: HashingEmbedder(c.dimension), "ollama": PromptEmbedder, "openai": BatchEmbedder}
    if config.provider not in kinds:
        raise ValueError(f"no embedding provider {config.provider!r}")
    make = kinds[config.provider]
    return make(config) if make else None
