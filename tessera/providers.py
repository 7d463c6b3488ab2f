"""Pluggable models with deterministic local defaults, and what each caller does when one fails."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.sources.extract import worth_captioning

# Texts a call, tries a call, and seconds of waiting that each try adds.
EMBED_BATCH = 32
TRIES = 3
BACKOFF_SECONDS = 2.0


class ModelProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def complete(self, prompt: str, max_tokens: int) -> str: ...

    def caption(self, image: bytes) -> str | None: ...

    def count_tokens(self, text: str) -> int: ...


class LocalProvider:
    """No network: hashed bags of words for vectors, first sentences for text, a digest for captions."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    def complete(self, prompt: str, max_tokens: int) -> str:
        sentences = re.split(r"(?<=[.!?])\s+", prompt.strip())
        return " ".join(sentences[:2])[: max_tokens * 4]

    def stream(self, prompt: str, max_tokens: int) -> Iterator[str]:
        for word in re.findall(r"\S+\s*", self.complete(prompt, max_tokens)):
            yield word

    def caption(self, image: bytes) -> str | None:
        return f"image of {len(image)} bytes, {hashlib.sha256(image).hexdigest()[:12]}"

    def count_tokens(self, text: str) -> int:
        return int(len(text) / 1.5) + 1


def embed_all(provider: ModelProvider, texts: list[str], allow_zero: bool = False, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in batches, each tried several times after ever longer waits; a vector of zeros is a failure unless allowed. Raises when it stays."""
    out: list[list[float]] = []
    for at in range(0, len(texts), EMBED_BATCH):
        part = texts[at : at + EMBED_BATCH]
        for attempt in range(1, TRIES + 1):
            try:
                found = provider.embed(part)
                if len(found) != len(part) or (not allow_zero and any(not any(v) for v in found)):
                    raise ValueError("the model gave no usable vector")
                break
            except Exception:
                if attempt == TRIES:
                    raise
                wait(BACKOFF_SECONDS * attempt)
        out += found
    return out


def caption_image(provider: ModelProvider, image: bytes, wait: Callable[[float], None] = time.sleep) -> str | None:
    """A caption, tried several times; None for an image that is too small or that the model cannot describe."""
    if not worth_captioning(image):
        return None
    for attempt in range(1, TRIES + 1):
        caption = or_else(lambda: provider.caption(image), None)
        if isinstance(caption, str) and caption.strip():
            return caption.strip()
        if attempt < TRIES:
            wait(BACKOFF_SECONDS * attempt)
    return None


def caption_missing(images: DataFrame, provider: ModelProvider) -> DataFrame:
    """``(sha256, caption)`` of distinct images (sha256, data); those without a caption are left out."""
    distinct = images.filter("sha256 is not null and data is not null").groupBy("sha256").agg(F.first("data").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, caption_image(provider, bytes(d))) for h, d in zip(b.sha256, b["data"])]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["sha256", "caption"])

    return distinct.mapInPandas(run, "sha256 string, caption string")


def count_tokens(provider: ModelProvider, text: str) -> int:
    """The model's own count, or the estimate if it gives none."""
    return or_else(lambda: int(provider.count_tokens(text)), int(len(text) / 1.5) + 1)


def stream_text(provider: ModelProvider, prompt: str, max_tokens: int) -> Iterator[str]:
    """An answer piece by piece; a model that cannot stream gives it in one piece."""
    stream = getattr(provider, "stream", None)
    if stream is None:
        yield provider.complete(prompt, max_tokens)
    else:
        yield from stream(prompt, max_tokens)


def with_embeddings(rows: DataFrame, text: str, provider: ModelProvider, column: str = "embedding") -> DataFrame:
    """Adds vectors of a text column, in Arrow batches; null and blank texts get null."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            use = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
            found = dict(zip(use, embed_all(provider, [s.iloc[i] for i in use], allow_zero=True)))
            yield pd.Series([found.get(i) for i in range(len(s))], dtype=object)

    return rows.withColumn(column, vectors(text))


def or_else(call: Callable, fallback: object) -> object:
    """What a planner does on failure: go on with ``fallback``."""
    try:
        return call()
    except Exception:
        return fallback
