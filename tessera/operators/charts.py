"""Chart specifications in answers: parsing, repair, fitting, grounding and the filter that a stream passes through."""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import numbers

# Kinds of chart and their limits.
TYPES = ("bar", "line", "pie", "donut")
MOST_LABELS, MOST_SERIES, MOST_SLICES = 60, 8, 8
TITLE_CHARS, NAME_CHARS, UNIT_CHARS = 200, 80, 40
PROPOSAL_FIGURES, PROPOSAL_SOURCES, PROPOSAL_SOURCE_CHARS = 3, 25, 1_200
_TIME = re.compile(
    r"^(?:(?:19|20)\d{2}(?:[-/.](?:0?[1-9]|1[0-2])(?:[-/.]\d{1,2})?)?|(?:fy|cy)\s?'?\d{2,4}|q[1-4](?:[ '/-]*\d{2,4})?|(?:19|20)\d{2}[ -]?q[1-4]|h[12](?:[ '/-]*\d{2,4})?|"
    r"(?:week|wk|w|month|day|year)\s?\d{1,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?(?:[ ,'/-]*\d{2,4})?|(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*|\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?)$",
    re.I,
)
_FENCE, _WORD = "```", "chart"
_OPEN = re.compile(r"([ \t]*)```[ \t]*chart[ \t]*\r?", re.I)
#: What a line that opens a block may look like before it has come in whole.
_MAY_OPEN = re.compile(r"[ \t]*(?:`{0,2}|```[ \t]*(?:" + "|".join(_WORD[:i] for i in range(1, len(_WORD))) + r"|chart[ \t]*\r?)?)", re.I)
_BLOCK = re.compile(r"(?ims)^[ \t]*```[ \t]*chart[ \t]*\r?\n.*?\n[ \t]*```")


def is_time_series(labels: list[str]) -> bool:
    """At least two labels of which two in three look like a time."""
    hits = sum(bool(_TIME.match(str(x).strip())) for x in labels)
    return len(labels) >= 2 and hits * 3 >= len(labels) * 2


def _number(x: object) -> float | None:
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    try:
        value = float(x)
    except (ValueError, OverflowError):
        return None
    return value if math.isfinite(value) else None


def _text(x: object, least: int, most: int) -> str | None:
    return x if isinstance(x, str) and least <= len(x) <= most else None


def _label(x: object) -> str | None:
    return x if isinstance(x, str) else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _listed(x: object, most: int) -> list | None:
    return x if isinstance(x, list) and 1 <= len(x) <= most else None


def _loads(body: str) -> object:
    """JSON, or what it is after a trailing comma and glued source lists are mended."""
    try:
        return json.loads(body)
    except ValueError:
        pass
    mended = re.sub(r"(\"sources\"\s*:\s*)((?:\[\s*\d+\s*\]\s*)+)", lambda m: f"{m[1]}[{','.join(re.findall(r'[0-9]+', m[2]))}]", body)
    try:
        return json.loads(re.sub(r",(?=\s*[\]}])", "", mended))
    except ValueError:
        return None


def parse_chart(body: str) -> dict | None:
    """The validated specification, or None; its kind is not fitted yet. Keys that it does not know are left out."""
    spec = _loads(body)
    if not isinstance(spec, dict):
        return None
    kind = spec.get("type").strip().lower() if isinstance(spec.get("type"), str) else None
    title = _text(spec.get("title"), 1, TITLE_CHARS)
    labels, series = _listed(spec.get("labels"), MOST_LABELS), _listed(spec.get("series"), MOST_SERIES)
    if kind not in TYPES or title is None or labels is None or series is None:
        return None
    names = [_label(x) for x in labels]
    made = []
    for s in series:
        values = [_number(v) for v in _listed(s.get("values"), MOST_LABELS) or []] if isinstance(s, dict) else []
        if len(values) != len(labels) or None in values or _text(s.get("name"), 1, NAME_CHARS) is None:
            return None
        made.append({"name": s["name"], "values": values})
    unit, sources = spec.get("unit"), spec.get("sources", [])
    whole = [_number(n) for n in sources] if isinstance(sources, list) else [None]
    if None in names or (unit is not None and _text(unit, 0, UNIT_CHARS) is None) or any(n is None or n != int(n) for n in whole) or (kind in ("pie", "donut") and len(made) > 1):
        return None
    out = {"type": kind, "title": title, "labels": names, "series": made}
    if unit:
        out["unit"] = unit
    return {**out, "sources": [int(n) for n in whole]}


def fit_type(spec: dict) -> dict:
    """A pie or donut over time, with a negative value or with fewer than two or too many slices becomes bars."""
    if spec["type"] in ("pie", "donut"):
        n = len(spec["labels"])
        if is_time_series(spec["labels"]) or not 2 <= n <= MOST_SLICES or any(v < 0 for s in spec["series"] for v in s["values"]):
            return {**spec, "type": "bar"}
    return spec


_FIGURE = re.compile(r"-?\d[\d,]*(?:\.\d+)?|-?\.\d+")  # fixed value: what counts as a figure


def _whole(value: float) -> int | float:
    return int(value) if value == int(value) else value


def ungrounded(spec: dict, sources: list[str | None]) -> list[float]:
    """Distinct values, in order, that no cited source states; where no citation is valid all sources count."""
    cited = [sources[n - 1] for n in spec["sources"] if 1 <= n <= len(sources)] or sources
    stated = sorted({float(x.replace(",", "")) for text in cited for x in _FIGURE.findall(text or "")})
    out = []
    for value in dict.fromkeys(v for s in spec["series"] for v in s["values"]):
        at = bisect.bisect_left(stated, value)
        if not any(abs(x - value) <= 1e-9 * max(1.0, abs(x), abs(value)) for x in stated[max(0, at - 1) : at + 1]):
            out.append(value)
    return out


def render(spec: dict, missing: list[float] = ()) -> str:
    plain = {**spec, "series": [{**s, "values": [_whole(v) for v in s["values"]]} for s in spec["series"]]}
    return json.dumps({**plain, "unverified": [_whole(v) for v in missing]} if missing else plain, ensure_ascii=False)


@dataclass
class ChartFilter:
    """Passes an answer's text through, holding back chart blocks until they close; the same for any cut into tokens.

    ``sources`` are the contents of the turn's sources, numbered from 1: citations of others are dropped, and
    values that no cited source states are marked and warned of.
    """

    pending: str = ""
    block: str | None = None
    begun: bool = False
    indent: str = ""
    charts: int = 0
    dropped: int = 0
    sources: list[str | None] = field(default_factory=list)
    specs: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def feed(self, token: str) -> str:
        self.pending += token
        out = []
        while "\n" in self.pending:
            line, self.pending = self.pending.split("\n", 1)
            out.append(self._line(line, "\n"))
        # what cannot become a fence may go out before its line ends
        if self.pending and self.block is None and (self.begun or not _MAY_OPEN.fullmatch(self.pending)):
            out.append(self.pending)
            self.pending, self.begun = "", True
        return "".join(out)

    def _line(self, line: str, end: str) -> str:
        begun, self.begun = self.begun, False
        if self.block is not None:
            if line.strip(" \t\r") == _FENCE:
                body, self.block = self.block, None
                return self._chart(body)
            self.block += line + "\n"
            return ""
        opens = None if begun or not end else _OPEN.fullmatch(line)
        if opens:
            self.block, self.indent = "", opens[1]
            return ""
        return line + end

    def _chart(self, body: str) -> str:
        spec = parse_chart(body)
        if spec is None:
            self.dropped += 1
            return ""
        spec = fit_type({**spec, "sources": sorted({n for n in spec["sources"] if 1 <= n <= len(self.sources)})})
        missing = ungrounded(spec, self.sources)
        if missing:
            self.warnings.append(f"{spec['title']}: chart values not stated in the cited sources: {', '.join(str(_whole(v)) for v in missing)}")
        self.charts += 1
        self.specs.append(spec)
        return "".join(f"{self.indent}{x}\n" for x in (_FENCE + _WORD, render(spec, missing), _FENCE))

    def finish(self) -> str:
        last, self.pending = self.pending, ""
        out = self._line(last, "") if last else ""
        if self.block is not None:
            self.block = None
            self.dropped += 1
        return out

    def state(self) -> tuple[str, str | None, bool, str, int, int]:
        return self.pending, self.block, self.begun, self.indent, self.charts, self.dropped


def filter_answer(answer: str, sources: list[str | None] = ()) -> tuple[str, int, int, list[str]]:
    """(text, charts kept, charts dropped, warnings) of a whole answer."""
    f = ChartFilter(sources=list(sources))
    text = f.feed(answer) + f.finish()
    return text, f.charts, f.dropped, f.warnings


def filter_answers(answers: DataFrame, key: str, text: str, sources: str | None = None) -> DataFrame:
    """``(key, text, charts, dropped, warnings)`` of each answer; a null answer is an empty one.

    ``sources`` names a column with the contents of the answer's sources.
    """
    kind = answers.schema[key].dataType.simpleString()
    picked = answers.select(key, F.col(text).alias("_text"), (F.col(sources) if sources else F.array().cast("array<string>")).alias("_sources"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *filter_answer(a if isinstance(a, str) else "", [] if s is None else list(s))) for k, a, s in zip(b[key], b["_text"], b["_sources"])]
            yield pd.DataFrame(rows, columns=[key, "text", "charts", "dropped", "warnings"])

    return picked.mapInPandas(run, f"{key} {kind}, text string, charts int, dropped int, warnings array<string>")


def unverified(charts: DataFrame, sources: DataFrame) -> DataFrame:
    """``(chart_id, value)``: values of charts (chart_id, values, sources) that none of the cited contents shows.

    ``sources`` (chart_id, source_no, content); where no cited number exists all of a chart's sources count.
    """
    known = sources.select("chart_id", "source_no", F.transform(numbers("content"), lambda x: x.try_cast("double")).alias("found"))
    cited = charts.select("chart_id", F.explode("sources").alias("source_no")).join(known, ["chart_id", "source_no"])
    any_cited = cited.select("chart_id").distinct()
    fallback = known.join(charts.select("chart_id"), "chart_id", "left_semi").join(any_cited, "chart_id", "left_anti")
    shown = cited.select("chart_id", "found").unionByName(fallback.select("chart_id", "found")).groupBy("chart_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    each = charts.join(shown, "chart_id", "left").select("chart_id", F.explode(F.array_distinct("values")).alias("value"), F.coalesce("found", F.array().cast("array<double>")).alias("found"))
    close = F.exists("found", lambda x: F.abs(x - F.col("value")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x), F.abs(F.col("value"))))
    return each.filter(~F.coalesce(close, F.lit(False))).select("chart_id", "value")


def wants_chart(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, figures, wanted)``: no chart yet and at least three distinct figures that are no citations and part of no word."""
    said = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(said, F.lit(r"(?<![\[\p{L}\p{N}_])(-?[0-9][0-9,]*(?:\.[0-9]+)?%?)(?!\])"), F.lit(1))
    figures = F.size(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))))
    return answers.select(key, figures.alias("figures"), ((figures >= PROPOSAL_FIGURES) & ~F.contains(said, F.lit("```chart"))).alias("wanted"))


def proposal_sources(sources: list[str | None]) -> str:
    """The numbered chunks that a model sees when it is asked for the chart an answer lacks."""
    return "\n\n".join(f"[{n}] {' '.join((text or '').split())[:PROPOSAL_SOURCE_CHARS]}" for n, text in enumerate(sources[:PROPOSAL_SOURCES], 1))


def proposed_block(reply: str | None) -> str | None:
    """The chart block in a model's reply, None if it holds none."""
    found = _BLOCK.search(reply or "")
    return found[0] if found else None
