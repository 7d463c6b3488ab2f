"""Answers cut into cited segments, and claims checked against their sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import citation_numbers

# Short forms after which a full stop does not end a sentence.
ABBREVIATIONS = frozenset("e.g. i.e. etc. vs. cf. approx. no. fig. mr. mrs. ms. dr. prof. st. jr. sr. inc. ltd. co. corp. dept. est. al. vol. pp. p.".split())
CLAIM_CHARS = 12_000
SOURCE_CHARS = 6_000
_MARKER = re.compile(r"\s*\[(\d{1,6})\]")
_END = re.compile(r"[.!?…。።](?:[\"'”’)\]]+)?(?:\s*\[\d{1,6}\])*(?=\s+\S)")


def _sentences(line: str) -> Iterator[str]:
    start = 0
    for m in _END.finditer(line):
        sentence = line[start : m.end()]
        last = line[start : m.start() + 1].split()
        word = last[-1].lower().lstrip("([\"'") if last else ""
        # a list marker, a short form or an initial goes on
        if word in ABBREVIATIONS or re.fullmatch(r"(?:\d+|[a-z])\.", word):
            continue
        yield sentence
        start = m.end()
    if line[start:].strip():
        yield line[start:]


def segment(answer: str | None) -> list[tuple[str, list[int]]]:
    """(text, source numbers) of each sentence; code, tables and headings stay whole lines.

    Blank lines become one empty segment, none at the end. Markers are taken out and the space that they
    leave before punctuation closed. A null answer has no segments.
    """
    out: list[tuple[str, list[int]]] = []
    fenced = False
    for line in (answer or "").split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            out.append((line, []))
        elif fenced:
            out.append((line, []))
        elif not line.strip():
            if out and out[-1] != ("", []):
                out.append(("", []))
        else:
            whole = line.lstrip().startswith(("|", "#"))
            for part in [line] if whole else _sentences(line):
                found = list(dict.fromkeys(int(n) for n in _MARKER.findall(part)))
                text = re.sub(r"\s+([.,;:!?])", r"\1", _MARKER.sub("", part)) if found else part
                text = text.rstrip() if whole else text.strip()
                if text or found:
                    out.append((text, found))
    while out and out[-1] == ("", []):
        out.pop()
    return out


def segments(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, segment_no, text, source_indices)``."""
    kind = answers.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, t, s) for k, a in zip(b[key], b[text]) for i, (t, s) in enumerate(segment(a if isinstance(a, str) else None), 1)]
            yield pd.DataFrame(rows, columns=[key, "segment_no", "text", "source_indices"])

    return answers.select(key, text).mapInPandas(run, f"{key} {kind}, segment_no int, text string, source_indices array<int>")


def drop_dangling(indices: Column | str, sources: Column | int) -> Column:
    n = F.lit(sources) if isinstance(sources, int) else sources
    return F.filter(F.col(indices) if isinstance(indices, str) else indices, lambda i: (i >= 1) & (i <= n))


def cited(answers: DataFrame, key: str, text: str, sources: int) -> DataFrame:
    """``(key, cited, dangling)``: distinct citation numbers that exist and those that do not."""
    found = F.array_sort(F.array_distinct(citation_numbers(text)))
    return answers.select(key, drop_dangling(found, sources).alias("cited"), F.filter(found, lambda i: (i < 1) | (i > sources)).alias("dangling"))


def verify(claims: DataFrame, sources: DataFrame, supported: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """``(answer_id, segment_no, reason)`` of claims without a source, first, and of those their own sources do not support.

    ``claims`` (answer_id, segment_no, text, source_indices), ``sources`` (answer_id, source_no, content).
    ``supported`` judges (claim, joined sources); where it fails the claim passes.
    """
    spoken = claims.filter(F.length(F.trim("text")) > 0)
    missing = spoken.filter(F.size("source_indices") == 0).select("answer_id", "segment_no", F.lit("no source").alias("reason"))
    each = spoken.select("answer_id", "segment_no", "text", F.size("source_indices").alias("n"), F.explode("source_indices").alias("source_no"))
    room = F.least(F.lit(SOURCE_CHARS), F.floor(F.lit(CLAIM_CHARS) / F.col("n"))).cast("int")
    joined = each.join(sources, ["answer_id", "source_no"]).groupBy("answer_id", "segment_no", "text").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_no", F.substr("content", F.lit(1), room).alias("c")))), lambda x: x["c"]), "\n\n").alias("evidence")
    )
    verdict = F.pandas_udf(supported, "boolean")
    bad = joined.filter(~F.coalesce(verdict("text", "evidence"), F.lit(True))).select("answer_id", "segment_no", F.lit("not supported").alias("reason"))
    return missing.unionByName(bad)
