"""The tools that a model may call in a turn, and what they answer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tessera.plans import ask
from tessera.providers import ModelProvider, caption_image
from tessera.sources.stores import ObjectStore, WebSearch, search_web

# The tools by name, with what they take.
RETRIEVE, LIST_DOCUMENTS, DESCRIBE_IMAGE, WEB_SEARCH = "retrieve", "list_documents", "describe_image", "web_search"
ARGUMENTS = {RETRIEVE: "query", LIST_DOCUMENTS: "filename_contains", DESCRIBE_IMAGE: "image_path", WEB_SEARCH: "query"}
SEPARATOR = "\n---\n"


def tagged_text(kind: Column | str, image_path: Column | str, content: Column | str) -> Column:
    """A result as a model reads it: captions of stored images carry their path."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    path = as_column(image_path)
    tag = F.when((as_column(kind) == "image_caption") & (F.length(path) > 0), F.concat(F.lit("[image_path="), path, F.lit("] "))).otherwise("")
    return F.concat(tag, as_column(content))


@dataclass
class Tools:
    """The tools of one turn; ``sources`` collects what its citations count."""

    chunks: DataFrame
    summaries: DataFrame
    provider: ModelProvider
    store: ObjectStore | None = None
    web: WebSearch | None = None
    limit: int = 15
    room: int = 8_000
    sources: list[dict] = field(default_factory=list)

    def offered(self) -> list[str]:
        """Web search is offered only where the turn has it switched on."""
        return [RETRIEVE, DESCRIBE_IMAGE, LIST_DOCUMENTS, *([WEB_SEARCH] if self.web else [])]

    def forced(self, turn: int) -> str | None:
        """With web search switched on the first turn must call it."""
        return WEB_SEARCH if self.web and turn == 0 else None

    def with_companions(self, calls: list[dict], forced: str | None) -> list[dict]:
        """A forced web search is paired with a retrieval of the same query."""
        asked = [c["arguments"]["query"] for c in calls if c["name"] == forced == WEB_SEARCH and isinstance(c.get("arguments", {}).get("query"), str) and c["arguments"]["query"].strip()]
        return [*calls, *({"name": RETRIEVE, "arguments": {"query": q}} for q in asked)]

    def call(self, name: str, arguments: dict | str | None) -> str:
        """The tool's answer; a call that cannot be carried out is answered with an error, never raised."""
        if name not in self.offered():
            return f"Error: unknown tool {name!r}."
        try:
            given = json.loads(arguments) if isinstance(arguments, str) else arguments or {}
        except ValueError:
            given = {}
        value = given.get(ARGUMENTS[name]) if isinstance(given, dict) else None
        value = value.strip() if isinstance(value, str) else None
        if not value and name != LIST_DOCUMENTS:
            return f"Error: no valid {ARGUMENTS[name]} argument was provided for this call."
        run: dict[str, Callable[[str], str]] = {RETRIEVE: self._retrieve, LIST_DOCUMENTS: lambda v: ask.list_documents_tool(self.chunks, v or None), DESCRIBE_IMAGE: self._describe, WEB_SEARCH: self._search}
        return run[name](value)

    def _numbered(self, found: list[tuple[dict, str]], nothing: str) -> str:
        """Results with their numbers among the turn's sources, as many whole ones as fit; a source seen before is pointed at."""
        if not found:
            return nothing
        seen = {_source_key(s): n for n, s in enumerate(self.sources, 1)}
        out, used, fresh = [], 0, []
        for place, (source, text) in enumerate(found):
            known = seen.get(_source_key(source))
            number = known or len(self.sources) + len(fresh) + 1
            line = f"[{number}] (same passage as [{number}] above)" if known else f"[{number}] {text}"
            cost = self.provider.count_tokens(line) + 3
            if used + cost > self.room:
                out.append(f"({len(found) - place} more results did not fit and were left out.)")
                break
            used += cost
            out.append(line)
            if not known:
                fresh.append(source)
                seen[_source_key(source)] = number
        self.sources += fresh
        return SEPARATOR.join(out)

    def _retrieve(self, query: str) -> str:
        spark = self.chunks.sparkSession
        found = ask.decompose_and_retrieve(spark.createDataFrame([(0, query)], "query_id long, text string"), self.chunks, self.summaries, self.provider, self.limit)
        image = F.col("source_image_path") if "source_image_path" in self.chunks.columns else F.lit(None).cast("string")
        about = self.chunks.select("chunk_id", "source_type", "source_format", "page_number", image.alias("image_path"))
        rows = found.join(about, "chunk_id").select("rank", "filename", "content", "source_type", "source_format", "page_number", tagged_text("source_type", "image_path", "content").alias("text")).orderBy("rank").collect()  # one question's passages
        return self._numbered([({k: r[k] for k in ("content", "source_type", "source_format", "filename", "page_number")}, r.text) for r in rows], "No passages found for this query.")

    def _describe(self, path: str) -> str:
        data = self.store.get(path) if self.store else None
        if data is None:
            return f"Error: no image found at path {path!r}."
        return caption_image(self.provider, data) or f"Error: could not generate a description for {path!r} right now."

    def _search(self, query: str) -> str:
        found = [({"content": r["content"], "source_type": "web", "source_format": "web", "filename": r["title"] or r["url"], "page_number": None, "url": r["url"]}, f"{r['title']}\n{r['url']}\n{r['content']}") for r in search_web(self.web, query)]
        return self._numbered(found, "No web results found for this query.")


def _source_key(source: dict) -> tuple:
    return ("web", source["url"]) if source.get("url") else (source["filename"], " ".join((source["content"] or "").split()))
