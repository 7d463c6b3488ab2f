"""What models are asked besides the answer itself: each planner is a prompt, a parser of the reply and a fallback.

A planner that fails never ends a job: it falls back to what its caller can go on with.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions import replies
from tessera.operators.charts import proposal_sources, proposed_block
from tessera.providers import ModelProvider, or_else

# Limits of the planners.
MAX_FIGURE_QUERIES, MAX_CORPUS_FILTERS, MAX_WEB_QUERIES, MAX_GAP_QUERIES, MAX_SUB_QUESTIONS, MAX_NOTES = 2, 3, 2, 4, 6, 12
TITLE_CHARS, TITLE_FALLBACK_CHARS = 80, 60
HISTORY_MESSAGES, HISTORY_CHARS = 4, 500


@dataclass(frozen=True)
class Planner:
    """``prompt`` may name fields of the request; ``parse(reply, request)`` gives what JSON can hold."""

    prompt: str
    parse: Callable[[str, dict], object]
    fallback: Callable[[dict], object]
    tokens: int = 256

    def ask(self, provider: ModelProvider, request: dict) -> object:
        fields = {"context": context_block(request.get("question", ""), request.get("history", [])), **{k: v if isinstance(v, str) else _numbered(v) for k, v in request.items()}}
        return or_else(lambda: self.parse(replies.without_thinking(provider.complete(self.prompt.format_map(_Blank(fields)), self.tokens)), request), self.fallback(request))


class _Blank(dict):
    def __missing__(self, key: str) -> str:
        return ""


def _numbered(items: object) -> str:
    return "\n".join(f"{i}. {x}" for i, x in enumerate(items, 1)) if isinstance(items, (list, tuple)) else str(items)


def context_block(question: str, history: list[dict]) -> str:
    """The last messages, shortened, above the question."""
    said = [f"{m.get('role')}: {cut if len(cut := (m.get('content') or '').strip()) <= HISTORY_CHARS else cut[:HISTORY_CHARS] + '...'}" for m in history[-HISTORY_MESSAGES:]]
    return ("Earlier messages:\n" + "\n".join(said) + "\n\n" if said else "") + f"Question now: {question}"


def _title(reply: str, request: dict) -> str:
    title = reply.strip().strip("\"'").strip()
    return title if title and len(title) <= TITLE_CHARS else request["question"].strip()[:TITLE_FALLBACK_CHARS]


def _corpus(reply: str, request: dict) -> list[str]:
    """File-name filters; "" stands for the whole collection, and goes if a filter is named besides."""
    found = ["" if x.upper() == "ALL" else x for x in replies.lines(reply, MAX_CORPUS_FILTERS)]
    return [x for x in found if x] or found[:1]


def _plan(reply: str, request: dict) -> dict:
    found = replies.sections(reply, ("SUB-QUESTIONS", "DOCUMENTS", "WEB"))
    return {"sub_questions": found["SUB-QUESTIONS"][:MAX_SUB_QUESTIONS] or [request["question"]], "documents": found["DOCUMENTS"], "web_queries": found["WEB"][:MAX_WEB_QUERIES]}


def _stated(reply: str, request: dict) -> list[int]:
    """Numbers of the notes that the excerpt states."""
    if reply.strip().lower().startswith("none"):
        return []
    named = {int(x) for x in "".join(c if c.isdigit() else " " for c in reply).split()}
    return [i for i in range(1, len(request["notes"]) + 1) if i in named]


def _gaps(reply: str, request: dict) -> dict:
    """Sub-questions without any note, and new queries; an unclear reply misses nothing."""
    asked = request["sub_questions"]
    found = replies.sections(reply, ("VERDICTS", "QUERIES"), numbered=("VERDICTS",))
    judged = replies.numbered_verdicts(found["VERDICTS"], len(asked), ("ANSWERED", "PARTIAL", "MISSING"))
    missing = [asked[n - 1] for n in sorted(judged) if judged[n] == "MISSING"]
    known = {q.lower() for q in asked}
    more = [q for q in found["QUERIES"] if q.lower() not in known][:MAX_GAP_QUERIES] if any(v != "ANSWERED" for v in judged.values()) else []
    return {"missing": missing, "queries": more}


def _facts(reply: str, request: dict) -> list[int]:
    """Places of the candidate facts that the reply names, each matched to the closest, in the order of the reply."""
    found = replies.json_in(reply)
    named = found.get("fact", []) if isinstance(found, dict) else found if isinstance(found, list) else []
    labels = [str(list(f)) for f in request["facts"]]
    places = [labels.index(replies.closest(str([str(p) for p in f]), labels)) for f in named if isinstance(f, (list, tuple)) and len(f) == 3 and labels]
    return list(dict.fromkeys(places))


def _triples(reply: str, request: dict) -> list[list[str]]:
    found = replies.json_in(reply)
    rows = found.get("triples", []) if isinstance(found, dict) else found if isinstance(found, list) else []
    return [[str(p) for p in t] for t in rows if isinstance(t, (list, tuple)) and len(t) == 3]


def _entities(reply: str, request: dict) -> list[str]:
    found = replies.json_in(reply)
    rows = found.get("named_entities", []) if isinstance(found, dict) else found if isinstance(found, list) else []
    return list(dict.fromkeys(str(x) for x in rows))


def _none(request: dict) -> list:
    return []


PLANNERS: dict[str, Planner] = {
    "decomposition": Planner("{context}\n\nWhich separate searches answer this? One self-contained search a line, NONE if one is enough.", lambda r, q: replies.sub_queries(q["question"], r), lambda q: [q["question"]]),
    "complexity": Planner("{context}\n\nDoes the answer combine several places (COMPLEX) or is it one or two facts (SIMPLE)? One word; SIMPLE if in doubt.", lambda r, q: r.strip().upper().startswith("COMPLEX"), lambda q: False, 8),
    "angles": Planner("{context}\n\nOne search for each of Who, What, When, Where, Why, How, each on a line after its word and a colon; NONE where it does not apply.", lambda r, q: list(replies.angle_questions(r, q.get("angles")).items()), _none),
    "figures": Planner("{context}\n\nIf a chart would show the answer, write searches worded as its description, one a line; else NONE.", lambda r, q: replies.lines(r, MAX_FIGURE_QUERIES), _none),
    "corpus": Planner("{context}\n\nIf this asks which or how many files there are, name the words their names hold, one a line, or ALL; else NONE.", _corpus, _none),
    "web": Planner("{context}\n\nSearches of the public web that help, one a line.", lambda r, q: replies.lines(r, MAX_WEB_QUERIES), _none),
    "research": Planner("{context}\n\nDocuments:\n{documents}\n\nPlan the research under the headings SUB-QUESTIONS:, DOCUMENTS: and WEB:, one item a line.", _plan, lambda q: {"sub_questions": [q["question"]], "documents": [], "web_queries": []}, 1_024),
    "read": Planner("Sub-questions:\n{sub_questions}\n\nExcerpts:\n{excerpts}\n\nWrite each relevant fact on a line as [#excerpt number] fact; NONE if there is none.", lambda r, q: replies.notes(r, len(q["excerpts"]), MAX_NOTES), _none, 1_024),
    "note_check": Planner("Excerpt:\n{excerpt}\n\nNotes:\n{notes}\n\nNumbers of the notes that the excerpt itself states, or NONE.", _stated, lambda q: list(range(1, len(q["notes"]) + 1)), 64),
    "gaps": Planner("{context}\n\nSub-questions:\n{sub_questions}\n\nNotes:\n{notes}\n\nUnder VERDICTS: each sub-question's number with ANSWERED, PARTIAL or MISSING; under QUERIES: a new search for each that is not answered.", _gaps, lambda q: {"missing": [], "queries": []}, 1_024),
    "fact_filter": Planner("{context}\n\nFacts:\n{facts}\n\nAnswer with JSON holding under fact the facts that bear on the question.", _facts, _none, 512),
    "triples": Planner("Passage:\n{passage}\n\nNames in it:\n{entities}\n\nAnswer with JSON holding under triples lists of subject, relation and object.", _triples, _none, 2_048),
    "entities": Planner("Passage:\n{passage}\n\nAnswer with JSON holding under named_entities the names in it.", _entities, _none, 1_024),
    "title": Planner("A title of three to six words for a conversation that opens with: {question}", _title, lambda q: q["question"].strip()[:TITLE_FALLBACK_CHARS], 32),
    "summary": Planner("Summarise this part of {filename}:\n\n{section}", lambda r, q: r.strip() or None, lambda q: None, 512),
    "claim": Planner("Sources:\n{evidence}\n\nClaim: {claim}\n\nDo the sources state it? YES or NO.", lambda r, q: not r.strip().upper().startswith("NO"), lambda q: True, 8),
    "chart": Planner("{context}\n\nAnswer:\n{answer}\n\nChunks:\n{chunks}\n\nIf a chart of figures that the chunks state would help, write only its chart block; else NONE.", lambda r, q: proposed_block(r), lambda q: None, 600),
}


def propose_chart(provider: ModelProvider, question: str, answer: str, sources: list[str]) -> str | None:
    """The chart block that an answer lacks, or None."""
    return PLANNERS["chart"].ask(provider, {"question": question, "answer": answer.strip(), "chunks": proposal_sources(sources)}) if sources else None


def council_plan(provider: ModelProvider, question: str, history: list[dict] | None = None, web: bool = False, angles: int = 6) -> dict:
    """Searches of a council: ``content`` (the question first), ``figures``, ``corpus`` and ``web``; small talk has none."""
    if replies.is_small_talk(question):
        return {"content": [], "figures": [], "corpus": [], "web": []}
    request = {"question": question, "history": history or [], "angles": angles}
    content = [q for _, q in PLANNERS["angles"].ask(provider, request)]
    if content and question.lower() not in {q.lower() for q in content}:
        content = [question, *content]
    corpus = PLANNERS["corpus"].ask(provider, request)
    # which files there are is no matter of figures
    figures = [] if corpus else PLANNERS["figures"].ask(provider, request)
    return {"content": content, "figures": figures, "corpus": corpus, "web": PLANNERS["web"].ask(provider, request) if web else []}


def ask_all(requests: DataFrame, planner: str, provider: ModelProvider, key: str = "query_id") -> DataFrame:
    """``(key, plan)`` with the parsed reply as JSON, for rows of ``key`` and ``request`` (a JSON object)."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plans = [json.dumps(PLANNERS[planner].ask(provider, json.loads(r) if isinstance(r, str) else {"question": ""}), ensure_ascii=False) for r in b.request]
            yield pd.DataFrame({key: b[key], "plan": plans})

    return requests.select(key, "request").mapInPandas(run, f"{key} {kind}, plan string")
