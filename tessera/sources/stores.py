"""Objects in a store, files attached to one message, and the public web."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections import OrderedDict
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import storage_of
from tessera.sources.extract import dispatch_name, read_file

# Limits of attachments and web results.
ATTACHMENT_BYTES, ATTACHMENTS = 25_000_000, 500
WEB_RESULTS, SNIPPET_CHARS = 5, 500


class ObjectStore:
    """Objects below a folder of any file system that Hadoop reaches, by key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):
        parts = [p for p in key.split("/") if p not in ("", ".")]
        if ".." in parts or not parts:
            raise ValueError(f"not a key: {key!r}")
        return storage_of(self.spark, f"{self.root}/{'/'.join(parts)}")

    def put(self, key: str, data: bytes) -> str:
        storage, target = self._at(key)
        out = storage.create(target, True)
        out.write(bytearray(data))
        out.close()
        return key

    def exists(self, key: str) -> bool:
        storage, target = self._at(key)
        return storage.exists(target)

    def get(self, key: str) -> bytes | None:
        """The object, or None if there is none."""
        storage, target = self._at(key)
        if not storage.exists(target):
            return None
        stream = storage.open(target)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def stat(self, key: str) -> dict | None:
        storage, target = self._at(key)
        if not storage.exists(target):
            return None
        found = storage.getFileStatus(target)
        return {"key": key, "size": found.getLen(), "modified_ms": found.getModificationTime()}

    def link(self, key: str) -> str | None:
        """Where the object lies, or None; links that end after a time are for the store's own gateway to make."""
        return f"{self.root}/{quote(key)}" if self.exists(key) else None

    def objects(self, pattern: str = "*") -> DataFrame:
        """``(key, size, modified_at, data)`` of all objects, read by the executors."""
        storage, target = storage_of(self.spark, self.root)
        if not storage.exists(target):
            return self.spark.createDataFrame([], "key string, size long, modified_at timestamp, data binary")
        base = storage.getFileStatus(target).getPath().toString().rstrip("/") + "/"
        plain = base.replace("file:///", "file:/")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(self.root)
        key = F.regexp_replace(F.replace(F.replace("path", F.lit("file:///"), F.lit("file:/")), F.lit(plain), F.lit("")), "^/+", "")
        return found.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.col("content").alias("data"))


def document_key(filename: Column | str) -> Column:
    """The key under which the file that was uploaded as ``filename`` is kept."""
    name = F.col(filename) if isinstance(filename, str) else filename
    return F.concat(F.lit("documents/"), name)


def is_uuid(c: Column | str) -> Column:
    """Whether the text is a uuid as it is written; null is none."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(text).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def made_uuid(*parts: Column | str) -> Column:
    """A uuid made of the parts' text, the same for the same parts."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)))
    return F.concat_ws("-", *(F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


class AttachmentTooLarge(ValueError):
    """An attached file is larger than what may be attached."""


def attachment_text(filename: str, data: bytes, mime: str | None = None) -> str:
    """The text of a file that is attached to one message: its units joined by blank lines. Raises for other formats and sizes."""
    if len(data) > ATTACHMENT_BYTES:
        raise AttachmentTooLarge(f"{len(data)} bytes; at most {ATTACHMENT_BYTES} may be attached")
    kind = dispatch_name(filename, mime)
    if kind is None:
        raise ValueError("unsupported file type")
    return "\n\n".join(text for _, _, text in read_file(kind, data) if text.strip())


class Attachments:
    """A bounded store of attachments; the oldest makes room."""

    def __init__(self, most: int = ATTACHMENTS):
        self.most, self._kept = most, OrderedDict()

    def add(self, filename: str, text: str, tokens: int, owner: str | None = None) -> str:
        while len(self._kept) >= self.most:
            self._kept.popitem(last=False)
        name = str(uuid.uuid4())
        self._kept[name] = {"filename": filename, "text": text, "chars": len(text), "tokens": tokens, "owner": owner}
        return name

    def get(self, name: str) -> dict | None:
        return self._kept.get(name)

    def owned_by(self, name: str, owner: str) -> bool:
        """Somebody else's attachment cannot be told from one that is not there."""
        return (self._kept.get(name) or {"owner": None})["owner"] == owner and name in self._kept

    def tokens(self, names: list[str]) -> int:
        return sum(self._kept[n]["tokens"] for n in names if n in self._kept)

    def with_question(self, question: str, names: list[str]) -> str:
        """The question with the attached texts below it, as a model sees it in this turn."""
        parts = [f"Attached file {posixpath.basename(self._kept[n]['filename'])}:\n{self._kept[n]['text']}" for n in names if n in self._kept]
        return "\n\n".join([question, *parts])


class WebSearch(Protocol):
    """A search engine: dictionaries with title, url and content, best first."""

    def search(self, query: str) -> list[dict]: ...


class PagesSearch:
    """Searches a fixed list of pages by shared words; stands in for an engine where there is no network."""

    def __init__(self, pages: list[dict]):
        self.pages = pages

    def search(self, query: str) -> list[dict]:
        asked = set(query.lower().split())
        scored = [(len(asked & set(f"{p.get('title') or ''} {p.get('content') or ''}".lower().split())), i, p) for i, p in enumerate(self.pages)]
        return [p for n, _, p in sorted(scored, key=lambda x: (-x[0], x[1])) if n]


def search_web(engine: WebSearch | None, query: str) -> list[dict]:
    """The first results with shortened contents; none if the engine fails, as a search must not end the turn."""
    try:
        found = engine.search(query)
    except Exception:
        return []
    return [{"title": r.get("title") or "", "url": r.get("url") or "", "content": (r.get("content") or "")[:SNIPPET_CHARS]} for r in found[:WEB_RESULTS]]


def web_results(queries: DataFrame, engine: WebSearch) -> DataFrame:
    """``(query_id, rank, title, url, content)`` of a set of queries (query_id, text)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(q, i, r["title"], r["url"], r["content"]) for q, text in zip(b.query_id, b.text) if isinstance(text, str) for i, r in enumerate(search_web(engine, text), 1)]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "title", "url", "content"])

    return queries.select("query_id", "text").mapInPandas(run, "query_id long, rank int, title string, url string, content string")


def image_key(data: bytes, kind: str = "png") -> str:
    """The key of an image by its bytes, so that an image that comes again is kept once."""
    return f"images/{hashlib.sha256(data).hexdigest()}.{kind}"

