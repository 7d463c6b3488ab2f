"""From questions to passages: decomposition, councils, research rounds and the tools of a conversation."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators import catalog, packing, retrieval
from tessera.plans.planners import PLANNERS
from tessera.providers import ModelProvider, embed_all
from tessera.session import written
from tessera.sources.stores import WebSearch, web_results

# Limits of the callers.
COUNCIL_CHUNKS = 20
LISTED_DOCUMENTS = 50
SECTION_TOKENS = 4_000
#: Names that one plan set may hold.
MAX_NAMES = 10_000


def resolve_documents(named: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(query_id, name, filename)``: files that a plan names: equal apart from case, else the first that ends with or holds the name.

    Names without a match are left out; first is the least filename. A plan's names are a small query set: each
    task holds its files against all of them and keeps one file a name.
    """
    files = summaries.select("filename").filter("filename is not null").distinct()
    low = named.select("query_id", "name", F.lower("name").alias("n")).filter("n != ''")
    exact = low.join(files.select("filename", F.lower("filename").alias("n")), "n").groupBy("query_id", "name").agg(F.min("filename").alias("filename"))
    rest = low.join(exact.select("query_id", "name"), ["query_id", "name"], "left_anti").select("n").distinct()
    wanted = [r.n for r in rest.limit(MAX_NAMES + 1).collect()]
    if len(wanted) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names; resolve them in several calls")

    def first_of(batches):
        best: dict[str, str] = {}
        for b in batches:
            for name in b.filename:
                text = name.lower()
                for n in wanted:
                    if n in text and name < best.get(n, name + "a"):
                        best[n] = name
        yield pd.DataFrame(list(best.items()), columns=["n", "filename"])

    near = files.mapInPandas(first_of, "n string, filename string").groupBy("n").agg(F.min("filename").alias("filename"))
    near = low.join(near, "n").join(exact.select("query_id", "name"), ["query_id", "name"], "left_anti").select("query_id", "name", "filename").distinct()
    return exact.unionByName(near)


def sub_question_set(questions: DataFrame, provider: ModelProvider) -> DataFrame:
    """``(query_id, ask_no, text, vec)``: each question, then its parts; if the model fails the question alone."""

    def run(batches):
        for b in batches:
            rows = []
            for q, text in zip(b.query_id, b.text):
                parts = PLANNERS["decomposition"].ask(provider, {"question": text})
                rows += [(q, i, p, v) for i, (p, v) in enumerate(zip(parts, embed_all(provider, parts, allow_zero=True)))]
            yield pd.DataFrame(rows, columns=["query_id", "ask_no", "text", "vec"])

    return questions.select("query_id", "text").filter("text is not null").mapInPandas(run, "query_id long, ask_no int, text string, vec array<double>")


def _asked_lists(asks: DataFrame, chunks: DataFrame, summaries: DataFrame, limit: int) -> DataFrame:
    """Routed lists (query_id, list_no, rank, chunk_id) of every part, searched as questions of their own."""
    handle = F.xxhash64("query_id", "ask_no")
    asks = written(asks.withColumn("ask_id", handle), "asks")
    as_queries = asks.select(F.col("ask_id").alias("query_id"), "text", "vec")
    found = retrieval.routed_search(as_queries, chunks, summaries, limit).withColumnRenamed("query_id", "ask_id")
    return found.join(asks.select("ask_id", "query_id", F.col("ask_no").alias("list_no")), "ask_id").select("query_id", "list_no", "rank", "chunk_id")


def decompose_and_retrieve(questions: DataFrame, chunks: DataFrame, summaries: DataFrame, provider: ModelProvider, limit: int = 15) -> DataFrame:
    """Passages of a question and its parts, first come first kept, at most ``limit`` a part, with context."""
    asks = sub_question_set(questions, provider)
    asks = written(asks, "parts")
    united = retrieval.first_wins(_asked_lists(asks, chunks, summaries, retrieval.SUB_QUERY_LIMIT), "chunk_id")
    parts = asks.groupBy("query_id").agg(F.count("*").alias("parts"))
    kept = united.join(parts, "query_id").filter(F.col("place") <= F.col("parts") * limit).select("query_id", "chunk_id", F.col("place").alias("rank"))
    return retrieval.expand_context(kept, chunks)


def council(asks: DataFrame, chunks: DataFrame, summaries: DataFrame, budget: int = COUNCIL_CHUNKS, graph_lists: DataFrame | None = None) -> DataFrame:
    """Passages of several angles (query_id, ask_no, text, vec) on each question, fused by rank, with context.

    ``graph_lists`` (query_id, rank, chunk_id), the passages that walks through the graph found, are a list more.
    A question without any list has no passages.
    """
    lists = _asked_lists(asks, chunks, summaries, retrieval.SUB_QUERY_LIMIT)
    if graph_lists is not None:
        lists = lists.unionByName(graph_lists.select("query_id", F.lit(1_000).alias("list_no"), "rank", "chunk_id"))
    fused = retrieval.council_fusion(lists, budget)
    return retrieval.expand_context(fused.select("query_id", "chunk_id", "rank"), chunks)


def web_fan_out(asks: DataFrame, engine: WebSearch, limit: int = 8) -> DataFrame:
    """``(query_id, place, title, url, content)``: results of several searches (query_id, ask_no, text) on each question, taken in turn, each page once."""
    handle = F.xxhash64("query_id", "ask_no")
    keyed = asks.withColumn("ask_id", handle)
    found = written(web_results(keyed.select(F.col("ask_id").alias("query_id"), "text"), engine).withColumnRenamed("query_id", "ask_id"), "pages")
    lists = found.join(keyed.select("ask_id", "query_id", F.col("ask_no").alias("list_no")), "ask_id").drop("ask_id")
    return retrieval.interleave(lists, "url", limit).select("query_id", "place", "title", "url", "content")


def research(rounds: list[DataFrame], chunks: DataFrame, summaries: DataFrame, budget: int) -> DataFrame:
    """``(round, query_id, chunk_id, position)``: several rounds of questions (query_id, ask_no, text, vec), none reading a passage twice."""
    spark = chunks.sparkSession
    spans = spark.createDataFrame([], "filename string, chunk_index int, source_type string")
    whole = spark.createDataFrame([], "filename string")
    out = []
    for number, asks in enumerate(rounds, 1):
        lists = _asked_lists(asks, chunks, summaries, budget).withColumn("weight", F.lit(1.0))
        found = written(retrieval.research_gather(lists, chunks, spans, whole, budget), "round")
        out.append(found.select(F.lit(number).alias("round"), "query_id", "chunk_id", "position"))
        spans = spans.unionByName(found.join(chunks, "chunk_id").select("filename", "chunk_index", "source_type"))
    return reduce(DataFrame.unionByName, out)


def group_sections(chunks: DataFrame, tokens: int = SECTION_TOKENS) -> DataFrame:
    """``(filename, batch_no, section)``: a file's text chunks joined into sections that fit a model's window, in order."""
    order = Window.partitionBy("filename").orderBy("chunk_index", "chunk_id")
    text = chunks.filter("source_type = 'text' and content is not null").select("filename", "content", F.row_number().over(order).alias("place"), (F.floor(F.length("content") / 1.5) + 1).alias("cost"))
    batches = packing.next_fit(text, "filename", "place", F.col("cost"), tokens, separator=0)
    joined = text.join(batches, ["filename", "place"]).groupBy("filename", "batch_no").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("c"))
    return joined.select("filename", "batch_no", F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("section"))


def summarise_documents(chunks: DataFrame, provider: ModelProvider, tokens: int = SECTION_TOKENS, most: int = 20) -> DataFrame:
    """``(filename, summary)``: each section summarised, the summaries joined and summarised again until one section remains.

    A spreadsheet is read by its sample. If the model fails on a section, its file has no summary.
    """
    picked = packing.spread_sample(chunks).select("chunk_id")
    sections = written(group_sections(chunks.join(picked, "chunk_id", "left_semi"), tokens), "sections")
    done = []
    for _ in range(most):
        def run(batches):
            for b in batches:
                rows = [(f, n, PLANNERS["summary"].ask(provider, {"filename": f, "section": t})) for f, n, t in zip(b.filename, b.batch_no, b.section)]
                yield pd.DataFrame(rows, columns=["filename", "batch_no", "summary"])

        told = written(sections.mapInPandas(run, "filename string, batch_no int, summary string"), "told")
        per_file = told.groupBy("filename").agg(F.count("*").alias("n"), F.count("summary").alias("good"))
        whole = per_file.filter("n = good")
        done.append(told.join(whole.filter("n = 1"), "filename", "left_semi").select("filename", "summary"))
        more = told.join(whole.filter("n > 1"), "filename", "left_semi")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        parts = more.select("filename", F.col("batch_no").alias("chunk_index"), F.col("summary").alias("content"), F.lit("text").alias("source_type"), F.format_string("%09d", "batch_no").alias("chunk_id"))
        sections = written(group_sections(parts, tokens), "sections")
    raise ValueError("summaries do not get shorter")


def list_documents_tool(chunks: DataFrame, part: str | None = None) -> str:
    """What the listing tool answers: a header and at most fifty lines."""
    condition = catalog.like_filter("filename", part) if part else None
    total = catalog.count_documents(chunks, condition).first().documents
    if not total:
        return "No documents match that filter." if part else "No documents have been ingested yet."
    page = catalog.list_documents(chunks, condition, LISTED_DOCUMENTS).select("filename", "chunks").collect()
    head = f'{total} document(s) match "{part}".' if part else f"{total} document(s) total."
    return "\n".join([head, f"Filenames (showing {len(page)} of {total}):", *(f"- {r.filename} ({r.chunks} chunks)" for r in page)])


def score_answers(answers: DataFrame) -> DataFrame:
    """``(mode, answers, correct, flagged, seconds)`` of graded answers (mode, correct, warnings, seconds)."""
    return answers.groupBy("mode").agg(F.count("*").alias("answers"), F.count_if("correct").alias("correct"), F.count_if(F.col("warnings") > 0).alias("flagged"), F.round(F.avg("seconds"), 3).alias("seconds"))
