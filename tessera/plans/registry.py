"""All core queries by name, with their SQL.

Query sets are the rows whose id is divisible by 50; everything else runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import alike, of_members
from tessera.operators import catalog, charts, citations, conversations, graph, mutation, packing, retrieval
from tessera.plans import records
from tessera.plans.oracle import statements
from tessera.session import file_stamp, table
from tessera.sources.archives import assemble_calls
from tessera.sources.extract import chunk_text
from tessera.streaming.turns import event_rates

POOL = 40
_POSTINGS: dict[tuple, DataFrame] = {}


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of the chunks, built once a session for the same table; as a corpus keeps its index beside it."""
    key = (spark.sparkContext.applicationId, *file_stamp(spark, f"{d}/chunks.parquet"))
    if key not in _POSTINGS:
        _POSTINGS[key] = retrieval.build_postings(chunks(spark, d))
    return _POSTINGS[key]


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id, text, vec)``: documents divisible by 50 as questions, each with a vector of the embeddings table."""
    docs = table(spark, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return docs.join(vectors, F.col("query_id") % 500 == F.col("vec_id")).select("query_id", "text", "vec")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """``(filename, embedding)``: the vector of each file's first chunk that has one stands for its summary."""
    rows = chunks(spark, d).filter("embedding is not null")
    return rows.groupBy("filename").agg(F.min(F.struct("chunk_index", "chunk_id", "embedding"))["embedding"].alias("embedding"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_facts")


def id_number(c: str) -> F.Column:
    """The number that the first digits of a hexadecimal id write."""
    return F.conv(F.substring(c, 1, 12), 16, 10).cast("long")


def fact_links(spark: SparkSession, d: str) -> DataFrame:
    """``(fact_id, chunk_id)``: the tables hold no links; a fact is taken to be stated where its id falls among as many places as there are chunks."""
    size = chunks(spark, d).agg(F.count("*").alias("size"))  # one row
    place = lambda c: F.pmod(id_number(c), F.col("size")).alias("k")
    f = facts(spark, d).crossJoin(size).select("fact_id", place("fact_id"))
    c = chunks(spark, d).crossJoin(size).select("chunk_id", place("chunk_id"))
    return f.join(c, "k").select("fact_id", "chunk_id").distinct()


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid candidates with their content, for a whole set of questions."""
    found = _fused(spark, d)
    return found.join(chunks(spark, d).select("chunk_id", "filename", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "score", "filename", "content")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_candidates(search_queries(spark, d), chunks(spark, d), POOL, postings(spark, d))


def read_spans(spark: SparkSession, d: str) -> DataFrame:
    """What a research round read before: the first chunk of each file, and all that is no text."""
    return chunks(spark, d).filter("chunk_index = 0 or source_type != 'text'").select("filename", "chunk_index", "source_type")


def read_whole(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("source_format = 'xlsx'").select("filename")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists a question: by vector (list 0) and by words (list 1)."""
    q, c = search_queries(spark, d), chunks(spark, d)
    v = retrieval.vector_ranks(q, c, POOL).select("query_id", F.lit(0).alias("list_no"), "rank", F.lit(1.0).alias("weight"), "chunk_id")
    t = retrieval.text_ranks(q, c, POOL, postings(spark, d)).select("query_id", F.lit(1).alias("list_no"), "rank", F.lit(0.5).alias("weight"), "chunk_id")
    return v.unionByName(t)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages")
    return m.groupBy("message_id").agg(F.min(F.struct("conversation_id", "parent_id", "role", "content", "created_at")).alias("m")).select("message_id", "m.*")


def _synonyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edges")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    return conversations.paths_to_root(m, m.filter("message_id % 50 = 0")).select("leaf_id", "message_id", "depth")


def fact_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``(fact_id, embedding)``: a fact has the vector of its subject."""
    subjects = table(spark, d, "graph_phrases").select(F.col("phrase_id").alias("subject_id"), "embedding")
    return facts(spark, d).join(subjects, "subject_id").select("fact_id", "embedding")


def _pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Walks over the whole graph from the phrases of each question's closest facts; questions of one vector walk once."""
    f, links = facts(spark, d), fact_links(spark, d)
    heads, members = alike(search_queries(spark, d))
    seeds = graph.seed_phrases(heads, f, links, fact_vectors(spark, d))
    reset = seeds.select("query_id", F.concat(F.lit("p:"), F.col("phrase_id")).alias("vertex"), "weight")
    ranks = graph.personalised_pagerank(graph.weighted_edges(f, links, _synonyms(spark, d)), reset)
    return of_members(ranks.select("query_id", "vertex", F.round("score", 6).alias("score")).filter("score > 0"), members)


def _graph_search(spark: SparkSession, d: str) -> DataFrame:
    found = graph.graph_search(search_queries(spark, d), chunks(spark, d), facts(spark, d), fact_links(spark, d), _synonyms(spark, d), fact_vectors(spark, d), 15)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Each ranked passage gives a note: its first 200 characters."""
    kept = _fused(spark, d).join(chunks(spark, d).select("chunk_id", "filename", "content", "chunk_index", "source_type", "page_number"), "chunk_id")
    label = tx.excerpt_label("source_type", "page_number")
    return kept.select("query_id", F.col("rank").alias("note_no"), "filename", F.col("chunk_id").alias("excerpt"), label.alias("label"), F.substring(tx.normalise_text("content"), 1, 200).alias("claim"), F.col("chunk_index").alias("position"))


def _with_content(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).join(chunks(spark, d).select("chunk_id", "filename", "content"), "chunk_id")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Lines numbered by digests and lengths, taken where the chunks lie; texts come last, to what fits."""
    c = chunks(spark, d)
    source = F.sha2(F.concat_ws("\x1f", "filename", tx.normalise_text("content")).cast("binary"), 256)
    slim = c.select("chunk_id", source.alias("source"), F.length("content").alias("chars"))
    found = _fused(spark, d).select("query_id", "chunk_id", "rank").join(slim, "chunk_id")
    placed = packing.place_within(found, "query_id", "rank", F.col("source"), F.col("chars"))
    return packing.fitting_lines(placed, "query_id", 3_000, c.select("chunk_id", F.col("content").alias("text")), "chunk_id")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    return m.filter(F.lower(F.trim("role")).isin("assistant", "bot"))


def _replace(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", "filename", "chunk_index", "content")
    new = c.filter("chunk_index = 0").select(F.concat(F.lit("n-"), "chunk_id").alias("chunk_id"), "filename", "chunk_index", F.upper("content").alias("content"))
    return mutation.replace_documents(c, new)


def _delete(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each table keeps, and how many chunks go, after all spreadsheets are deleted."""
    gone = chunks(spark, d).filter("source_format = 'xlsx'").select("filename").distinct()
    p = table(spark, d, "graph_phrases").select("phrase_id", "phrase")
    f = facts(spark, d)
    e = _synonyms(spark, d)
    none = summaries(spark, d).select("filename")
    out = mutation.delete_documents(gone, chunks(spark, d), none, table(spark, d, "document_files"), p, f, fact_links(spark, d), e)
    count = lambda name: out[name].agg(F.lit(name).alias("kept"), F.count("*").alias("rows"))
    told = out["deleted"].agg(F.lit("deleted").alias("kept"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("rows"))
    return reduce(DataFrame.unionByName, [count(n) for n in ("chunks", "summaries", "files", "facts", "phrases", "links", "edges")], told)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return event_rates(table(spark, d, "events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q, c = search_queries, chunks
    files = lambda s, d: table(s, d, "document_files").select("file_id", "filename", "sha256", "batch_no", "created_at", "captioned_at")
    docs = lambda s, d: table(s, d, "documents")
    phrases = lambda s, d: table(s, d, "graph_phrases")
    return {
        # ranked retrieval
        "vector_topk": lambda s, d: retrieval.vector_ranks(q(s, d), c(s, d), POOL).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank"),
        "text_topk": lambda s, d: retrieval.text_ranks(q(s, d), c(s, d), POOL, postings(s, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
        "hybrid_candidates": lambda s, d: _fused(s, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
        "text_topk_scan": lambda s, d: retrieval.text_ranks(q(s, d), c(s, d), POOL).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
        "text_topk_stems": lambda s, d: retrieval.text_ranks(q(s, d), c(s, d), POOL, stem=True).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
        "hybrid_search": lambda s, d: retrieval.hybrid_search(q(s, d), c(s, d), 10, postings(s, d)),
        "mmr_rerank": lambda s, d: retrieval.mmr(_fused(s, d), c(s, d), 10).withColumn("score", F.round("score", 6)),
        "summary_rank": lambda s, d: retrieval.summary_ranks(q(s, d), summaries(s, d), 60),
        "document_rank": lambda s, d: retrieval.document_ranks(q(s, d), c(s, d), summaries(s, d), postings=postings(s, d)).select("query_id", "filename", F.round("score", 6).alias("score"), "rank"),
        "within_document": lambda s, d: retrieval.search_within(q(s, d), c(s, d), retrieval.document_ranks(q(s, d), c(s, d), summaries(s, d), postings=postings(s, d)), 6, postings(s, d)).select("query_id", "filename", "chunk_id", F.round("score", 6).alias("score"), "rank"),
        "search_within_mmr": lambda s, d: retrieval.mmr(retrieval.search_within(q(s, d), c(s, d), retrieval.document_ranks(q(s, d), c(s, d), summaries(s, d), postings=postings(s, d)), 6, postings(s, d)), c(s, d), 6, ["query_id", "filename"]).withColumn("score", F.round("score", 6)),
        "routed_search": lambda s, d: retrieval.routed_search(q(s, d), c(s, d), summaries(s, d), 15, postings=postings(s, d)).withColumn("score", F.round("score", 6)),
        "collapse_duplicates": lambda s, d: retrieval.collapse_duplicates(_fused(s, d), c(s, d)),
        "expand_context": lambda s, d: retrieval.expand_context(_fused(s, d), c(s, d)),
        "multi_query_union": lambda s, d: retrieval.first_wins(_lists(s, d), "chunk_id", 60).select("query_id", "chunk_id", "list_no", "place"),
        "interleave_lists": lambda s, d: retrieval.interleave(_lists(s, d), "chunk_id", 12).select("query_id", "chunk_id", "place"),
        "council_fusion": lambda s, d: retrieval.council_fusion(_lists(s, d), 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
        "weighted_fusion": lambda s, d: retrieval.fuse(_lists(s, d), ["chunk_id"]).select("query_id", "chunk_id", F.round("score", 6).alias("score")),
        "research_gather": lambda s, d: retrieval.research_gather(_lists(s, d), c(s, d), read_spans(s, d), read_whole(s, d), 20).select("query_id", "chunk_id", "doc_rank", "position"),
        "coverage_antijoin": lambda s, d: retrieval.uncovered(_fused(s, d), c(s, d), read_spans(s, d), read_whole(s, d)).select("query_id", "chunk_id"),
        "document_sizes": lambda s, d: retrieval.document_sizes(c(s, d)),
        "whole_documents": lambda s, d: retrieval.whole_documents(c(s, d)).select("filename", "part", "chunk_index", "content"),
        # budgets
        "budget_cut": lambda s, d: packing.budget_cut(_with_content(s, d), "query_id", "rank", tx.token_estimate("content"), 2_000).select("query_id", "chunk_id", F.col("used").cast("long").alias("used")),
        "pack_batches": lambda s, d: packing.next_fit(_with_content(s, d), "query_id", "rank", tx.token_estimate("content"), 1_000),
        "number_sources": lambda s, d: packing.number_sources(_with_content(s, d), "query_id", "rank", F.concat_ws("\x1f", "filename", tx.normalise_text("content"))).select("query_id", "chunk_id", "number", "pointer"),
        "spreadsheet_sample": lambda s, d: packing.spread_sample(c(s, d)),
        "number_within": _numbered,
        "render_notes": lambda s, d: packing.render_notes(_notes(s, d), 1_500).select("query_id", "filename", "notes", "number", F.col("used").cast("long").alias("used"), "block"),
        # catalogue
        "list_documents": lambda s, d: catalog.list_documents(c(s, d), catalog.folder_filter("filename", "/Projects/") & catalog.type_filter("filename", "pdf")),
        "list_documents_page": lambda s, d: catalog.list_documents(c(s, d), catalog.like_filter("filename", "re_ort%p"), 5, 2),
        "list_documents_literal": lambda s, d: catalog.list_documents(c(s, d), catalog.literal_filter("filename", "team 100%")),
        "include_exclude": lambda s, d: catalog.list_documents(c(s, d), catalog.include_exclude("filename", ["report"], ["draft", "inbox"])),
        "count_documents": lambda s, d: catalog.count_documents(c(s, d)),
        "list_folders": lambda s, d: catalog.list_folders(c(s, d)),
        "list_subfolders": lambda s, d: catalog.list_folders(c(s, d), "Projects/"),
        "first_ingested": lambda s, d: catalog.first_ingested(files(s, d)),
        "filtered_aggregates": lambda s, d: catalog.kinds_by_document(c(s, d)),
        "next_index": lambda s, d: catalog.next_index(c(s, d)),
        "corpus_stamp": lambda s, d: catalog.corpus_stamp({"facts": facts(s, d), "phrases": phrases(s, d), "edges": _synonyms(s, d)}),
        "pending_summaries": lambda s, d: catalog.missing_summaries(c(s, d), c(s, d).filter("source_format = 'pdf'")),
        "pending_captions": lambda s, d: catalog.pending_captions(files(s, d), ["report"], ["inbox"]),
        "format_backfill": lambda s, d: catalog.backfill_format(c(s, d)).select("chunk_id", "source_format"),
        "dedupe_rows": lambda s, d: catalog.exact_rows(c(s, d)).select("chunk_id", "copies"),
        "duplicate_files": lambda s, d: catalog.duplicate_files(files(s, d)),
        "exact_hash": lambda s, d: catalog.identical_document(*(files(s, d).filter(when).groupBy("filename").agg(F.min("sha256").alias("sha256")) for when in ("batch_no >= 6", "batch_no < 6"))),
        "caption_cache": lambda s, d: catalog.cached_captions(files(s, d).select(F.col("file_id").alias("image_id"), "sha256"), files(s, d).filter("captioned_at is not null").select("sha256", F.col("filename").alias("caption")))[0],
        "stage_shares": lambda s, d: catalog.stage_shares(table(s, d, "events"), "event_type", "value"),
        # text
        "chunk_text": lambda s, d: chunk_text(docs(s, d).select("doc_id", "text"), "text").select("doc_id", "chunk_no", "chunk"),
        "normalise_text": lambda s, d: c(s, d).select("chunk_id", tx.normalise_text("content").alias("normal")),
        "normalise_phrase": lambda s, d: phrases(s, d).select("phrase_id", tx.normalise_phrase("phrase").alias("normal"), tx.word_characters("phrase").alias("characters")),
        "passage_text": lambda s, d: c(s, d).select("chunk_id", tx.passage_text("filename", "page_number", "source_type", "content").alias("passage")),
        "token_estimate": lambda s, d: docs(s, d).select("doc_id", tx.token_estimate("text").alias("tokens")),
        "number_extraction": lambda s, d: _answers(s, d).select("message_id", F.size(tx.numbers("content")).alias("figures")).filter("figures > 0"),
        "cited_sources": lambda s, d: citations.cited(_answers(s, d), "message_id", "content", 4).filter("size(cited) + size(dangling) > 0").select("message_id", F.array_join("cited", ",").alias("cited"), F.array_join("dangling", ",").alias("dangling")),
        "citation_segments": lambda s, d: citations.segments(_answers(s, d), "message_id", "content"),
        "chart_filter": lambda s, d: charts.filter_answers(_answers(s, d), "message_id", "content"),
        "chart_proposals": lambda s, d: charts.wants_chart(_answers(s, d), "message_id", "content"),
        # graph
        "fact_edges": lambda s, d: graph.fact_edges(facts(s, d), fact_links(s, d)),
        "passage_edges": lambda s, d: graph.passage_edges(fact_links(s, d), facts(s, d)),
        "graph_edges_weighted": lambda s, d: graph.weighted_edges(facts(s, d), fact_links(s, d), _synonyms(s, d)).select("a", "b", F.round("weight", 4).alias("weight")),
        "phrase_facts": lambda s, d: graph.phrase_facts(phrases(s, d).select("phrase_id"), facts(s, d).select("fact_id", "subject_id", "object_id")),
        "orphan_phrases": lambda s, d: graph.orphan_phrases(phrases(s, d), facts(s, d)),
        "usable_phrases": lambda s, d: catalog.usable_phrases(phrases(s, d)).select("phrase_id"),
        "graph_totals": lambda s, d: graph.graph_totals(phrases(s, d), facts(s, d), fact_links(s, d), _synonyms(s, d), c(s, d)),
        "synonym_edges": lambda s, d: graph.synonym_edges(phrases(s, d).filter(id_number("phrase_id") % 50 == 0), phrases(s, d)),
        "closest_facts": lambda s, d: graph.closest_facts(q(s, d), fact_vectors(s, d)).select("query_id", "fact_id", F.round("similarity", 6).alias("similarity"), "rank"),
        "fact_floor": lambda s, d: graph.fact_floor(q(s, d), fact_vectors(s, d)).select("query_id", F.round("low", 6).alias("low")),
        "personalised_pagerank": _pagerank,
        "graph_search": _graph_search,
        # conversations
        "backfill_parents": lambda s, d: conversations.backfill_parents(_messages(s, d)),
        "active_leaves": lambda s, d: conversations.active_leaves(_messages(s, d)),
        "conversation_path": _paths,
        "list_conversations": lambda s, d: conversations.list_conversations(_messages(s, d), 20).drop("cursor"),
        "list_conversations_next": lambda s, d: conversations.list_conversations(_messages(s, d), 20, ("2025-06-01 00:00:00", 0)).drop("cursor"),
        "search_conversations": lambda s, d: conversations.list_conversations(_messages(s, d), 20, search="backup schedule").drop("cursor"),
        # snapshots and streams
        "replace_documents": _replace,
        "delete_documents": _delete,
        "upsert_files": lambda s, d: mutation.upsert(*(mutation.upsert(files(s, d).filter("false"), files(s, d).filter(when), ["filename"]).select("filename", "file_id", "sha256", "batch_no") for when in ("batch_no < 6", "batch_no >= 6")), ["filename"]),
        "assemble_calls": lambda s, d: assemble_calls(table(s, d, "events").select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"), F.lit(0).alias("call_index"), F.col("event_type").alias("call_id"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("arguments"))),
        "event_rates": _stream,
        **records.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {**statements(), **records.statements()}
