"""Hybrid ranked retrieval for whole sets of questions at once.

Every ranked list is a table with an explicit rank; every window is partitioned by query, after the
rows were reduced to the pool where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.stems import stemmed
from tessera.functions.text import STOP_WORDS, normalise_text, terms
from tessera.functions.vectors import cosine, nearest_rows
from tessera.functions.words import best_by_words, counted
from tessera.session import BROADCAST_ROWS, parallelism, release, written

# Constants of the ranking.
RRF_K = 60
MMR_LAMBDA = 0.7
CONTEXT_WINDOW = 1
DOC_SCAN_POOL = 60
TOP_DOCUMENTS = 3
PER_DOCUMENT = 6
SUB_QUERY_LIMIT = 8
WHOLE_DOCUMENT_CHARS = 16_000
PICKED_WEIGHT = 0.5
#: Bytes of different texts in a task, where texts repeat (a Parquet file keeps each of up to 1 MB of them once); least and most bytes of text that a task puts out.
ONCE, LEAST_TEXT, MOST_TEXT = 2**18, 2**23, 2**27
#: Chunks that are read alone.
WITHOUT_SPAN = "(source_type != 'text' or chunk_index is null or source_type is null)"


def vector_ranks(queries: DataFrame, chunks: DataFrame, pool: int) -> DataFrame:
    """``(query_id, chunk_id, similarity, rank)``, nearest first."""
    found = nearest_rows(queries.select("query_id", "vec"), chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec")), pool)
    return found.withColumnRenamed("id", "chunk_id")


def query_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """``(query_id, term)``: the distinct words of each question, stop words left out; ``stem`` reduces them to their stems."""
    words = queries.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term")).filter(~F.col("term").isin(STOP_WORDS))
    return words.select("query_id", stemmed("term").alias("term")).distinct() if stem else words


def build_postings(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """``(chunk_id, term, tf)``: the inverted index of the chunks, words sorted so that a reader skips what it was not asked for.

    Stop words are left out; null contents have no words. Only ids and words are shuffled, after a partial count.
    """
    words = chunks.select("chunk_id", F.explode(terms("content")).alias("term")).filter(~F.col("term").isin(STOP_WORDS))
    counts = words.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    if stem:
        counts = counts.select("chunk_id", stemmed("term").alias("term"), "tf").groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"))
    spark = chunks.sparkSession
    return written(counts.repartitionByRange(parallelism(spark), "term", "chunk_id").sortWithinPartitions("term", "chunk_id"), "postings")


def text_scores(queries: DataFrame, chunks: DataFrame, postings: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """``(query_id, chunk_id, score)``: sum over matching words of tf / (tf + 1).

    With ``postings`` (:func:`build_postings`) only the index is read. Without, each task counts the words of
    its chunks that any question asks for, and only these counts are shuffled, never a text. Questions' words
    are broadcast if few, which the count decides.
    """
    asked = written(query_terms(queries, stem), "asked")
    small = asked.count() <= BROADCAST_ROWS
    if postings is None:
        words = chunks.select("chunk_id", F.explode(terms("content")).alias("term"))
        if stem:
            words = words.filter(~F.col("term").isin(STOP_WORDS)).withColumn("term", stemmed("term"))
        wanted = asked.select("term").distinct()
        postings = words.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    met = postings.join(F.broadcast(asked) if small else asked, "term")
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("tf") / (F.col("tf") + F.lit(1.0))), 9).alias("score"))


def text_ranks(queries: DataFrame, chunks: DataFrame, pool: int, postings: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``, best match first, with the scores of :func:`text_scores`.

    Questions and chunks that share a word are too many to shuffle: each task ranks its own chunks. Words are
    numbered; of stems, every spelling has the number of its stem.
    """
    asked = written(query_terms(queries, stem), "asked")
    wanted = forms = written(asked.select("term").distinct().withColumn("word", F.monotonically_increasing_id()), "wanted")
    if postings is None:
        words = chunks.select("chunk_id", F.explode(terms("content")).alias("term"))
        if stem:
            spelled = words.filter(~F.col("term").isin(STOP_WORDS)).select("term").distinct().select("term", stemmed("term").alias("stem"))
            forms = written(spelled.join(wanted.withColumnRenamed("term", "stem"), "stem").select("term", "word"), "forms")
    few = forms.count() <= BROADCAST_ROWS
    forms = F.broadcast(forms) if few else forms
    if postings is None:
        counts = words.join(forms, "term").select("chunk_id", "word", F.lit(1).cast("long").alias("tf")).mapInArrow(counted, "chunk_id string, word long, tf long")
    else:
        counts = postings.join(forms, "term").select("chunk_id", "word", F.col("tf").cast("long").alias("tf"))
    found = best_by_words(asked.join(wanted, "term").select("query_id", "word"), counts, pool, chunks.count())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool)


def reciprocal_rank(rank: Column, weight: Column | float = 1.0) -> Column:
    return (weight if isinstance(weight, Column) else F.lit(float(weight))) / (F.lit(float(RRF_K)) + rank)


def fuse(lists: DataFrame, keys: list[str]) -> DataFrame:
    """``(query_id, *keys, score)``: weighted reciprocal-rank fusion of (query_id, rank, weight, *keys)."""
    return lists.groupBy("query_id", *keys).agg(F.round(F.sum(reciprocal_rank(F.col("rank"), F.col("weight"))), 9).alias("score"))


def hybrid_candidates(queries: DataFrame, chunks: DataFrame, pool: int, postings: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: vector and keyword lists of ``pool`` fused, cut to ``pool``."""
    v = vector_ranks(queries, chunks, pool).select("query_id", "chunk_id", F.col("rank").alias("v_rank"))
    t = text_ranks(queries, chunks, pool, postings).select("query_id", "chunk_id", F.col("rank").alias("t_rank"))
    zero = F.lit(0.0)
    score = F.coalesce(reciprocal_rank(F.col("v_rank")), zero) + F.coalesce(reciprocal_rank(F.col("t_rank")), zero)
    both = v.join(t, ["query_id", "chunk_id"], "full_outer").withColumn("score", F.round(score, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool).select("query_id", "chunk_id", "score", "rank")


def mmr_order(scores: np.ndarray, vectors: np.ndarray, limit: int, weight: float = MMR_LAMBDA) -> list[int]:
    """Greedy order by relevance against the nearest one picked before; ties go to the earlier candidate."""
    top = scores.max() if len(scores) else 0
    relevance = scores / top if top > 0 else np.ones(len(scores))
    norm = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / np.where(norm > 0, norm, 1.0)[:, None]
    redundant, left, picked = np.zeros(len(scores)), np.ones(len(scores), dtype=bool), []
    while left.any() and len(picked) < limit:
        value = np.where(left, np.round(weight * relevance - (1 - weight) * redundant, 12), -np.inf)
        best = int(value.argmax())
        picked.append(best)
        left[best] = False
        redundant = np.maximum(redundant, unit @ unit[best])
    return picked


def mmr(candidates: DataFrame, chunks: DataFrame, limit: int, groups: list[str] | None = None, weight: float = MMR_LAMBDA) -> DataFrame:
    """``(*groups, chunk_id, score, mmr_rank)``: each group's candidates (a bounded pool) diversified.

    Candidates without a usable vector count as unlike everything.
    """
    groups = groups or ["query_id"]
    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    rows = candidates.select(*groups, "chunk_id", "score", "rank").join(chunks.select("chunk_id", "embedding"), "chunk_id", "left")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "chunk_id"]).reset_index(drop=True)
        length = max((len(v) for v in rows.embedding if v is not None), default=1)
        vectors = np.array([np.nan_to_num(np.asarray(v, dtype=float)) if v is not None and len(v) == length else np.zeros(length) for v in rows.embedding])
        order = mmr_order(rows.score.to_numpy(dtype=float), vectors, limit, weight)
        out = rows.loc[order, [*groups, "chunk_id", "score"]].reset_index(drop=True)
        out["mmr_rank"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    schema = ", ".join(f"{g} {types[g]}" for g in groups) + ", chunk_id string, score double, mmr_rank int"
    return rows.groupBy(*groups).applyInPandas(pick, schema)


def hybrid_search(queries: DataFrame, chunks: DataFrame, limit: int, postings: DataFrame | None = None) -> DataFrame:
    """The simplest complete search: candidates, diversification, duplicates folded and context added."""
    found = mmr(hybrid_candidates(queries, chunks, max(4 * limit, 40), postings), chunks, limit).withColumnRenamed("mmr_rank", "rank")
    return expand_context(found, chunks)


def summary_ranks(queries: DataFrame, summaries: DataFrame, pool: int) -> DataFrame:
    """``(query_id, filename, rank)`` by the distance of the summaries' embeddings (filename, embedding)."""
    found = nearest_rows(queries.select("query_id", "vec"), summaries.select(F.col("filename").alias("id"), F.col("embedding").alias("vec")), pool)
    return found.select("query_id", F.col("id").alias("filename"), "rank")


def document_ranks(queries: DataFrame, chunks: DataFrame, summaries: DataFrame, top: int = TOP_DOCUMENTS, postings: DataFrame | None = None) -> DataFrame:
    """``(query_id, filename, score, rank)``: files by their best chunk in a scan and by their summaries, fused.

    Of equal scores, files that the scan found come first, then the better of their ranks.
    """
    scan = hybrid_candidates(queries, chunks, DOC_SCAN_POOL, postings).join(chunks.select("chunk_id", "filename"), "chunk_id")
    best = scan.groupBy("query_id", "filename").agg(F.max("score").alias("best"), F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), "first", "filename")
    by_chunk = best.select("query_id", "filename", F.row_number().over(order).alias("rank"), F.lit(0).alias("list"))
    by_summary = summary_ranks(queries, summaries, DOC_SCAN_POOL).select("query_id", "filename", "rank", F.lit(1).alias("list"))
    fused = by_chunk.unionByName(by_summary).groupBy("query_id", "filename").agg(F.round(F.sum(reciprocal_rank(F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "filename")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "filename", "score", "rank")


def _scores_of(pairs: DataFrame, asked: DataFrame, chunks: DataFrame, postings: DataFrame | None) -> DataFrame:
    """``(query_id, filename, chunk_id, score)`` as :func:`text_scores` gives them, of these ``pairs`` (query_id, filename, chunk_id) alone."""
    there = pairs.select("chunk_id").distinct()
    if postings is None:
        words = chunks.select("chunk_id", F.explode(terms("content")).alias("term")).join(there, "chunk_id", "left_semi")
        postings = words.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    met = pairs.distinct().join(postings, "chunk_id").join(asked, ["query_id", "term"])
    scored = met.groupBy("query_id", "filename", "chunk_id").agg(F.round(F.sum(F.col("tf") / (F.col("tf") + F.lit(1.0))), 9).alias("score"))
    return pairs.join(scored, ["query_id", "filename", "chunk_id"])


def search_within(queries: DataFrame, chunks: DataFrame, picked: DataFrame, limit: int, postings: DataFrame | None = None) -> DataFrame:
    """``(query_id, filename, chunk_id, score, rank)``: hybrid candidates of each picked file (query_id, filename), both lists
    ranked within the file, the best ``4 * limit`` kept."""
    pool = 4 * limit
    picked = written(picked.select("query_id", "filename"), "picked")
    n = picked.count()
    picked = F.broadcast(picked) if n <= BROADCAST_ROWS else picked
    vec = queries.select("query_id", "vec")
    per_file = Window.partitionBy("query_id", "filename")
    mine = chunks.select("chunk_id", "filename", "embedding").join(picked, "filename")
    sims = mine.join(vec, "query_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("vec")), 9)).filter("similarity is not null")
    v = sims.withColumn("v_rank", F.row_number().over(per_file.orderBy(F.desc("similarity"), "chunk_id"))).filter(F.col("v_rank") <= pool).select("query_id", "filename", "chunk_id", "v_rank")
    inside = written(chunks.select("chunk_id", "filename").join(picked, "filename").select("query_id", "filename", "chunk_id"), "inside")
    t = _scores_of(inside, query_terms(queries), chunks, postings).withColumnRenamed("score", "s")
    t = t.withColumn("t_rank", F.row_number().over(per_file.orderBy(F.desc("s"), "chunk_id"))).filter(F.col("t_rank") <= pool).select("query_id", "filename", "chunk_id", "t_rank")
    score = F.coalesce(reciprocal_rank(F.col("v_rank")), F.lit(0.0)) + F.coalesce(reciprocal_rank(F.col("t_rank")), F.lit(0.0))
    both = v.join(t, ["query_id", "filename", "chunk_id"], "full_outer").withColumn("score", F.round(score, 9))
    return both.withColumn("rank", F.row_number().over(per_file.orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= pool).select("query_id", "filename", "chunk_id", "score", "rank")


def routed_search(queries: DataFrame, chunks: DataFrame, summaries: DataFrame, limit: int, top: int = TOP_DOCUMENTS, per_document: int = PER_DOCUMENT, diversify: bool = True, postings: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the best documents first, then the best chunks of each, in the documents' order."""
    documents = written(document_ranks(queries, chunks, summaries, top, postings), "documents")  # used three times; a few rows a query
    inside = search_within(queries, chunks, documents, per_document, postings)
    if diversify:
        inside = mmr(inside, chunks, per_document, ["query_id", "filename"]).withColumnRenamed("mmr_rank", "rank")
    else:
        inside = inside.filter(F.col("rank") <= per_document)
    joined = inside.join(documents.select("query_id", "filename", F.col("rank").alias("doc_rank")), ["query_id", "filename"])
    unique = Window.partitionBy("query_id", "chunk_id").orderBy("doc_rank", "rank")
    joined = joined.withColumn("first", F.row_number().over(unique)).filter("first = 1")
    order = Window.partitionBy("query_id").orderBy("doc_rank", F.col("rank"), "chunk_id")
    return joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "chunk_id", "score", F.col("place").alias("rank"))


def _passage(content: str) -> Column:
    """What stands for a normalised text where only its equality counts; null texts have one of their own."""
    return F.coalesce(F.unhex(F.sha2(normalise_text(content).cast("binary"), 256)), F.lit(b""))


def _with_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked results with the places and passages of their chunks; a long chunk is found by many questions, so its text
    is read once, where it lies. What is small is sent to the chunks."""
    slim = written(results.select("query_id", "chunk_id", "rank"), "results")
    found = slim.select("chunk_id").distinct()
    there = chunks.join(F.broadcast(found), "chunk_id", "left_semi") if found.count() <= BROADCAST_ROWS else chunks
    places = written(there.select("chunk_id", "filename", "chunk_index", "source_type", _passage("content").alias("passage")), "passages")
    few = slim.count() <= BROADCAST_ROWS
    return places.join(F.broadcast(slim) if few else slim, "chunk_id")


def _collapse(rows: DataFrame, window: int) -> DataFrame:
    """(query_id, chunk_id, rank, filename, passage, span_start, span_end) of results with their chunks."""
    same = Window.partitionBy("query_id", "passage").orderBy("rank", "chunk_id")
    rows = rows.withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    text = rows.filter("source_type = 'text' and chunk_index is not null")
    along = Window.partitionBy("query_id", "filename").orderBy("chunk_index", "chunk_id")
    apart = F.col("chunk_index") - F.lag("chunk_index").over(along) > 2 * window
    islands = text.withColumn("island", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(along))
    spans = islands.groupBy("query_id", "filename", "island").agg(
        F.min(F.struct("rank", "chunk_id", "passage")).alias("head"), (F.min("chunk_index") - window).alias("span_start"), (F.max("chunk_index") + window).alias("span_end")
    )
    folded = spans.select("query_id", "head.chunk_id", "head.rank", "filename", "head.passage", "span_start", "span_end")
    none = F.lit(None).cast("int")
    return folded.unionByName(rows.filter(WITHOUT_SPAN).select("query_id", "chunk_id", "rank", "filename", "passage", none.alias("span_start"), none.alias("span_end")))


def collapse_duplicates(results: DataFrame, chunks: DataFrame, window: int = CONTEXT_WINDOW) -> DataFrame:
    """``(query_id, chunk_id, rank, span_start, span_end)``: equal passages dropped, overlapping spans of text in one file folded.

    Spans are unions of the intervals around kept text chunks; the chunk of the best rank stands for
    the span. Other kinds of chunk keep their own row without a span. Null contents equal each other.
    """
    return _collapse(_with_chunks(results, chunks), window).select("query_id", "chunk_id", "rank", "span_start", "span_end")


def joined_content(index: str, content: str, separator: str = "\n") -> Column:
    """The contents of a group in order of their index (ties by content), joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, content))), lambda x: x[content]), separator)


def _with_texts(rows: DataFrame, keys: list[str], pieces: Callable[[Column], DataFrame], content: Column) -> DataFrame:
    """``rows`` with ``content``, which is put together from the ``pieces`` (*keys, content) once for each of ``keys``.

    Rows are slim and their texts are not, so tasks are cut by what they put out; rows of one text lie in one task.
    """
    sizes = pieces(F.octet_length("content").alias("content")).groupBy(keys).agg(F.sum("content").alias("size"))
    each = rows.groupBy(keys).agg(F.count("*").alias("n")).join(sizes, keys)
    once, out = each.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()
    parts = max(1, math.ceil(max(out / MOST_TEXT, min(once / ONCE, out / LEAST_TEXT))))
    texts = pieces(F.col("content")).repartition(parts, *keys).groupBy(keys).agg(content.alias("content"))
    return rows.repartition(parts, *keys).join(texts, keys, "left")


def expand_context(results: DataFrame, chunks: DataFrame, window: int = CONTEXT_WINDOW) -> DataFrame:
    """``(query_id, chunk_id, rank, filename, content)``: each folded span with all its text, other rows as they are.

    Spans are spelled out as the places they cover, so that the text is met by an equi-join: a file with most
    of the chunks is no group of its own. A span that many questions have is put together once, and its text
    meets their rows last, in one task.
    """
    folded = written(_collapse(_with_chunks(results, chunks), window), "folded")
    release(chunks.sparkSession)  # the search's shuffles
    spanned = F.col("span_start").isNotNull() & F.col("filename").isNotNull()
    span = ["filename", "span_start", "span_end"]
    spans = written(folded.filter(spanned).select(span).distinct(), "spans")
    places = spans.select(*span, F.explode(F.sequence("span_start", "span_end")).alias("i"))
    few = spans.agg(F.coalesce(F.sum(F.col("span_end") - F.col("span_start") + 1), F.lit(0))).first()[0] <= BROADCAST_ROWS
    places = F.broadcast(places) if few else places
    text = chunks.filter("source_type = 'text' and content is not null")
    inside = lambda what: text.select("filename", F.col("chunk_index").alias("i"), what).join(places, ["filename", "i"])
    alone = chunks.filter(f"{WITHOUT_SPAN} or filename is null")
    own = lambda what: alone.select("chunk_id", _passage("content").alias("passage"), what)
    columns = ["query_id", "chunk_id", "rank", "filename", "content"]
    expanded = _with_texts(folded.filter(spanned), span, inside, joined_content("i", "content")).select(columns)
    return expanded.unionByName(_with_texts(folded.filter(~spanned), ["chunk_id", "passage"], own, F.max("content")).select(columns))


def first_wins(lists: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """``(query_id, key, list_no, rank, place)``: lists (query_id, list_no, rank, key) united in order, first occurrence kept."""
    unique = Window.partitionBy("query_id", key).orderBy("list_no", "rank")
    kept = lists.withColumn("copy", F.row_number().over(unique)).filter("copy = 1").drop("copy")
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("list_no", "rank", key)))
    return kept.filter(F.col("place") <= limit) if limit else kept


def interleave(lists: DataFrame, key: str, limit: int) -> DataFrame:
    """Lists (query_id, list_no, rank, key) merged round robin, first occurrence kept, cut to ``limit``."""
    unique = Window.partitionBy("query_id", key).orderBy("rank", "list_no")
    kept = lists.withColumn("copy", F.row_number().over(unique)).filter("copy = 1").drop("copy")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "list_no", key))).filter(F.col("place") <= limit)


def council_fusion(lists: DataFrame, budget: int) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: several angles' lists (query_id, list_no, rank, chunk_id) by unweighted fusion."""
    scored = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(reciprocal_rank(F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget).select("query_id", "chunk_id", "score", "rank")


def uncovered(results: DataFrame, chunks: DataFrame, spans: DataFrame, whole: DataFrame) -> DataFrame:
    """``results`` without chunks read before: ``spans`` (filename, chunk_index, source_type) and ``whole`` files.

    A text chunk was read with its neighbours, another kind alone.
    """
    rows = results.join(chunks.select("chunk_id", "filename", "chunk_index"), "chunk_id")
    reach = F.when(F.col("source_type") == "text", F.lit(CONTEXT_WINDOW)).otherwise(F.lit(0))
    near = spans.select("filename", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index")).distinct()
    return rows.join(near, ["filename", "chunk_index"], "left_anti").join(whole.select("filename").distinct(), "filename", "left_anti").select(*results.columns)


def document_sizes(chunks: DataFrame) -> DataFrame:
    """``(filename, chars)``: characters of the text chunks; files with none have 0."""
    return chunks.groupBy("filename").agg(F.coalesce(F.sum(F.when(F.col("source_type") == "text", F.length("content"))), F.lit(0)).cast("long").alias("chars"))


def whole_documents(chunks: DataFrame, size: int = 3, most: int = WHOLE_DOCUMENT_CHARS) -> DataFrame:
    """``(filename, part, chunk_index, page_number, content)``: files of at most ``most`` characters in groups of ``size`` text chunks.

    Files without text have no parts; they are searched, not read whole.
    """
    small = document_sizes(chunks).filter((F.col("chars") > 0) & (F.col("chars") <= most)).select("filename")
    text = chunks.filter("source_type = 'text' and content is not null").join(small, "filename", "left_semi")
    order = Window.partitionBy("filename").orderBy("chunk_index", "chunk_id")
    parts = text.withColumn("part", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    rows = parts.groupBy("filename", "part").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "page_number", "content"))).alias("rows"))
    return rows.select("filename", "part", F.col("rows")[0]["chunk_index"].alias("chunk_index"), F.col("rows")[0]["page_number"].alias("page_number"), F.array_join(F.transform("rows", lambda r: r["content"]), "\n").alias("content"))


def research_gather(lists: DataFrame, chunks: DataFrame, spans: DataFrame, whole: DataFrame, budget: int) -> DataFrame:
    """``(query_id, chunk_id, score, doc_rank, position)``: weighted fusion without what was read, cut to ``budget``, by document.

    ``lists`` has (query_id, list_no, rank, weight, chunk_id). Documents come by the sum of their kept
    scores, their chunks in reading order.
    """
    fused = fuse(lists, ["chunk_id"])
    fresh = uncovered(fused, chunks, spans, whole)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    kept = fresh.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= budget).join(chunks.select("chunk_id", "filename", "chunk_index"), "chunk_id")
    by_doc = kept.groupBy("query_id", "filename").agg(F.round(F.sum("score"), 9).alias("doc_score"), F.min("n").alias("first"))
    by_doc = by_doc.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_score"), "first")))
    return kept.join(by_doc.select("query_id", "filename", "doc_rank"), ["query_id", "filename"]).withColumn(
        "position", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_rank", "chunk_index", "chunk_id"))
    ).select("query_id", "chunk_id", "score", "doc_rank", "position")
