"""The knowledge graph: building, cleaning, weighting and ranking through it."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.text import normalise_phrase
from tessera.functions.vectors import alike, nearest_rows, of_members, similarities
from tessera.operators.catalog import corpus_stamp
from tessera.session import written

# Constants of the graph ranking.
DAMPING = 0.5
PASSAGE_WEIGHT = 0.05
LINKING_TOP_K = 5
SYNONYM_THRESHOLD = 0.8
SYNONYM_NEIGHBOURS = 100
ITERATIONS = 20
#: A graph of at most this many steps (two an edge) is walked in the memory of each task; a larger one by joins.
TASK_STEPS = 6_000_000


def parse_triples(replies: DataFrame) -> DataFrame:
    """``(chunk_id, subject, relation, object)`` from JSON lists of three; parts are normalised, incomplete ones and
    those that relate a phrase to itself dropped, repeats too."""
    rows = replies.select("chunk_id", F.explode(F.coalesce(F.from_json("reply", "array<array<string>>"), F.array().cast("array<array<string>>"))).alias("t")).filter("size(t) = 3")
    part = [normalise_phrase(F.col("t")[i]).alias(n) for i, n in enumerate(("subject", "relation", "object"))]
    return rows.select("chunk_id", *part).filter("subject != '' and relation != '' and object != '' and subject != object").distinct()


def build_graph(triples: DataFrame, usable: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, facts, links) with ids made from their text, so that building again changes nothing.

    ``usable`` (phrase) names the phrases with a vector; facts on others are left out with their links.
    """
    rows = triples
    if usable is not None:
        known = usable.select(F.col("phrase")).distinct()
        rows = rows.join(known.withColumnRenamed("phrase", "subject"), "subject", "left_semi").join(known.withColumnRenamed("phrase", "object"), "object", "left_semi")
    phrase_id = lambda c: F.substring(F.sha2(F.col(c), 256), 1, 16)
    rows = rows.select("chunk_id", "subject", "relation", "object", phrase_id("subject").alias("subject_id"), phrase_id("object").alias("object_id"))
    rows = rows.withColumn("fact_id", F.substring(F.sha2(F.concat_ws("\x1f", "subject", "relation", "object"), 256), 1, 16))
    phrases = rows.select(F.col("subject_id").alias("phrase_id"), F.col("subject").alias("phrase")).union(rows.select("object_id", "object")).distinct()
    facts = rows.select("fact_id", "subject_id", "object_id", "subject", "relation", "object").distinct()
    return phrases, facts, rows.select("fact_id", "chunk_id").distinct()


def fact_edges(facts: DataFrame, links: DataFrame) -> DataFrame:
    """``(phrase_a, phrase_b, facts)``: how often passages state a fact that joins two phrases, either way round.

    A fact counts once for each passage in ``links`` (fact_id, chunk_id); one that no passage states is no edge.
    """
    stated = links.select("fact_id", "chunk_id").distinct().groupBy("fact_id").agg(F.count("*").alias("n"))
    ends = facts.select("fact_id", "subject_id", "object_id").distinct().filter("subject_id is not null and object_id is not null and subject_id != object_id").join(stated, "fact_id")
    return ends.groupBy(F.least("subject_id", "object_id").alias("phrase_a"), F.greatest("subject_id", "object_id").alias("phrase_b")).agg(F.sum("n").alias("facts"))


def passage_edges(links: DataFrame, facts: DataFrame) -> DataFrame:
    """``(chunk_id, phrase_id)``: the phrases of the facts that a passage states."""
    joined = links.join(facts, "fact_id")
    return joined.select("chunk_id", F.col("subject_id").alias("phrase_id")).union(joined.select("chunk_id", "object_id")).filter("phrase_id is not null").distinct()


def weighted_edges(facts: DataFrame, links: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(a, b, weight)``: 2 for each passage that states a fact, 2 times a synonym's weight, 1 between passage and phrase; undirected, ``a < b``.

    Null, NaN and infinite synonym weights and loops are left out.
    """
    by_fact = fact_edges(facts, links).select("phrase_a", "phrase_b", (F.lit(2.0) * F.col("facts")).alias("weight"))
    w = F.col("weight").cast("double")
    good = synonyms.filter(w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf")) & F.expr("phrase_a != phrase_b"))
    by_name = good.select(F.least("phrase_a", "phrase_b").alias("phrase_a"), F.greatest("phrase_a", "phrase_b").alias("phrase_b"), (F.lit(2.0) * w).alias("weight"))
    phrases = by_fact.unionByName(by_name).groupBy(F.concat(F.lit("p:"), F.col("phrase_a")).alias("a"), F.concat(F.lit("p:"), F.col("phrase_b")).alias("b")).agg(F.sum("weight").alias("weight"))
    passages = passage_edges(links, facts).select(F.concat(F.lit("c:"), F.col("chunk_id")).alias("a"), F.concat(F.lit("p:"), F.col("phrase_id")).alias("b"), F.lit(1.0).alias("weight"))
    return phrases.unionByName(passages)


def _walks(damping: float, iterations: int) -> Callable:
    """Walks over a graph in memory: a task gets its steps first (query_id null), then the reset vector of one question after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, held, part, graph, now = [], [], None, None, None

        def walked() -> pa.RecordBatch:
            known, src, dst, share = graph
            rows = pa.Table.from_batches(held)
            vertex, mass, lone = rows["vertex"].to_numpy(), rows["value"].to_numpy(), rows["lone"][0].as_py()
            at = np.minimum(np.searchsorted(known, vertex), max(len(known) - 1, 0))
            inside = known[at] == vertex if len(known) else np.zeros(len(vertex), dtype=bool)
            start = np.bincount(at[inside], mass[inside], len(known))
            rank, restart = start, 1.0
            for _ in range(iterations):
                restart = 1 - damping * (1 - lone * restart)
                rank = damping * np.bincount(dst, rank[src] * share, len(known)) + restart * start
            there = np.nonzero(rank)[0]
            number, score = np.concatenate([known[there], vertex[~inside]]), np.concatenate([rank[there], restart * mass[~inside]])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(number), now, dtype=np.int64)), pa.array(number), pa.array(score)], names=["query_id", "number", "score"])

        for batch in batches:
            step = pc.is_null(batch.column("query_id"))
            new = batch.filter(step)
            if len(new):
                part = new.column("part")[0].as_py() if part is None else part  # another part in the same task has the same graph
                steps.append(new.filter(pc.equal(new.column("part"), part)).select(["vertex", "dst", "value"]))
            rest = batch.filter(pc.invert(step))
            if not len(rest):
                continue
            if graph is None:
                table = pa.Table.from_batches(steps) if steps else None
                src, dst, share = (table[c].to_numpy() if steps else np.zeros(0, dtype=np.int64) for c in ("vertex", "dst", "value"))
                known = np.unique(src)  # a step leads to where another begins
                graph = known, np.searchsorted(known, src).astype(np.int32), np.searchsorted(known, dst).astype(np.int32), share
                steps = table = src = dst = None
            query = np.asarray(rest.column("query_id"))
            cuts = [0, *(np.nonzero(np.diff(query))[0] + 1), len(query)]
            for a, b in zip(cuts, cuts[1:]):
                if held and query[a] != now:
                    yield walked()
                    held = []
                now = int(query[a])
                held.append(rest.slice(a, b - a))
        if held:
            yield walked()

    return run


def _in_memory(start: DataFrame, steps: DataFrame, damping: float, iterations: int) -> DataFrame:
    """The walks of :func:`personalised_pagerank` in tasks that each hold the whole graph, its vertices numbered, and some of the questions."""
    spark = start.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism)
    vertices = written(steps.select("vertex").union(start.select("vertex")).distinct().withColumn("number", F.monotonically_increasing_id()), "vertices")
    by_src = steps.join(vertices.withColumnRenamed("number", "src"), "vertex").select("src", F.col("dst").alias("vertex"), "share")
    numbered = by_src.join(vertices.withColumnRenamed("number", "dst"), "vertex")
    none = lambda kind: F.lit(None).cast(kind)
    everywhere = F.explode(F.array(*(F.lit(i) for i in range(parts)))).alias("part")
    graph = numbered.select(everywhere, none("long").alias("query_id"), F.col("src").alias("vertex"), "dst", F.col("share").alias("value"), none("double").alias("lone"))
    query = F.col("query_id").cast("long")
    resets = start.join(vertices, "vertex").select(F.pmod(F.xxhash64(query), F.lit(parts)).cast("int").alias("part"), query.alias("query_id"), F.col("number").alias("vertex"), none("long").alias("dst"), F.col("mass").alias("value"), "lone")
    placed = graph.unionByName(resets).repartition(parts, "part").sortWithinPartitions(F.asc_nulls_first("query_id"))
    ranks = placed.mapInArrow(_walks(damping, iterations), "query_id long, number long, score double")
    return written(ranks.join(vertices, "number").select("query_id", "vertex", "score"), "rank")


def personalised_pagerank(edges: DataFrame, reset: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, cut_every: int = 5, in_memory: int = TASK_STEPS) -> DataFrame:
    """``(query_id, vertex, score)`` of walks that return to ``reset`` (query_id, vertex, weight), all queries in one loop.

    Edges (a, b, weight) count both ways; edges of no positive weight are not walked. What a walk carries
    to a vertex without edges returns to the reset vector. With damping 1/2 the error after 20 rounds is
    below 2e-6. Lineage is cut every few rounds by a table in the shared folder.

    Only vertices of the reset vector can be without edges, and nothing flows to them: so what restarts in a
    round follows from what restarted in the round before, and a round is one join and one sum. A graph of
    at most ``TASK_STEPS`` steps is walked in memory, by tasks that share the questions.
    """
    usable = edges.filter("weight > 0 and a != b")
    both = usable.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(usable.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("out"))
    steps = written(both.join(out, "src").select(F.col("src").alias("vertex"), "dst", (F.col("weight") / F.col("out")).alias("share")), "steps")
    positive = reset.filter("weight > 0").groupBy("query_id", "vertex").agg(F.sum("weight").alias("weight"))
    walked = steps.select("vertex").distinct().withColumn("walked", F.lit(True))
    marked = written(positive.join(walked, "vertex", "left"), "marked")
    total = marked.groupBy("query_id").agg(F.sum("weight").alias("total"), F.coalesce(F.sum(F.when(F.col("walked").isNull(), F.col("weight"))), F.lit(0.0)).alias("lone"))
    start = written(marked.join(total, "query_id").select("query_id", "vertex", (F.col("weight") / F.col("total")).alias("mass"), (F.col("lone") / F.col("total")).alias("lone")), "reset")
    if steps.count() <= in_memory:
        return _in_memory(start, steps, damping, iterations)
    rank, restart = start.select("query_id", "vertex", F.col("mass").alias("score")), F.lit(1.0)
    for i in range(iterations):
        moved = rank.join(steps, "vertex").select("query_id", F.col("dst").alias("vertex"), (F.col("score") * F.col("share") * damping).alias("score"))
        restart = 1 - damping * (1 - F.col("lone") * restart)
        back = start.select("query_id", "vertex", (F.col("mass") * restart).alias("score"))
        rank = moved.unionByName(back).groupBy("query_id", "vertex").agg(F.sum("score").alias("score"))
        if (i + 1) % cut_every == 0:
            rank = written(rank, "rank")
    return rank


def closest_facts(queries: DataFrame, facts: DataFrame, k: int = LINKING_TOP_K) -> DataFrame:
    """``(query_id, fact_id, similarity, rank)`` among facts (fact_id, embedding)."""
    found = nearest_rows(queries.select("query_id", "vec"), facts.select(F.col("fact_id").alias("id"), F.col("embedding").alias("vec")), k)
    return found.withColumnRenamed("id", "fact_id")


def fact_floor(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """``(query_id, low)``: the least similarity of any fact (fact_id, embedding) to each question, found as the nearest to its opposite."""
    opposite = queries.select("query_id", F.transform("vec", lambda x: -x.cast("double")).alias("vec"))
    return closest_facts(opposite, facts, 1).select("query_id", (-F.col("similarity")).alias("low"))


def min_max(c: str, by: str) -> F.Column:
    """Column scaled to 0..1 within the group; 1 where all values are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low))


def seed_phrases(queries: DataFrame, facts: DataFrame, links: DataFrame, fact_vectors: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``(query_id, phrase_id, weight)``: the phrases that walks start from.

    The closest facts are scored between the least similar fact of all and the closest; ``kept`` (query_id,
    fact_id) names those that a filter left. A phrase takes its last kept fact's score, divided by the
    passages that name it; the phrases with the best mean scores are chosen.
    """
    near = closest_facts(queries, fact_vectors)
    top = near.groupBy("query_id").agg(F.max("similarity").alias("high")).join(fact_floor(queries, fact_vectors), "query_id")
    scored = near.join(top, "query_id").withColumn("s", F.when(F.col("high") > F.col("low"), (F.col("similarity") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0))
    if kept is not None:
        scored = scored.join(kept.select("query_id", "fact_id").distinct(), ["query_id", "fact_id"], "left_semi")
    ends = scored.join(facts.select("fact_id", "subject_id", "object_id").distinct(), "fact_id").select("query_id", "rank", "s", F.explode(F.array("subject_id", "object_id")).alias("phrase_id")).filter("phrase_id is not null")
    spread = passage_edges(links, facts).groupBy("phrase_id").agg(F.count("*").alias("passages"))
    seeds = ends.groupBy("query_id", "phrase_id").agg(F.max_by("s", "rank").alias("last"), F.avg("s").alias("mean")).join(spread, "phrase_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("mean", 9)), "phrase_id")
    seeds = seeds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= LINKING_TOP_K)
    return seeds.select("query_id", "phrase_id", (F.col("last") / F.greatest(F.coalesce("passages", F.lit(0)), F.lit(1))).alias("weight"))


def graph_search(queries: DataFrame, chunks: DataFrame, facts: DataFrame, links: DataFrame, synonyms: DataFrame, fact_vectors: DataFrame, limit: int, kept: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: passages ranked by walks from the phrases of the closest facts.

    Every passage with a usable vector joins the walks with a small weight, by its similarity scaled to 0..1.
    Without a kept fact the order is by similarity. ``kept`` as in :func:`seed_phrases`; without it questions
    of one vector walk once.
    """
    if kept is None:
        queries, members = alike(queries)
    seeds = seed_phrases(queries, facts, links, fact_vectors, kept).select("query_id", F.concat(F.lit("p:"), F.col("phrase_id")).alias("vertex"), "weight")
    seeds = written(seeds, "seeds")
    similar = written(similarities(queries.select("query_id", "vec"), chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))), "similar")
    some = seeds.filter("weight > 0").select("query_id").distinct()
    bounds = similar.groupBy("query_id").agg(F.min("similarity").alias("low"), F.max("similarity").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("similarity") - F.col("low")) / (F.col("high") - F.col("low")))
    passages = similar.join(some, "query_id", "left_semi").join(bounds, "query_id").select("query_id", F.concat(F.lit("c:"), F.col("id")).alias("vertex"), (F.lit(PASSAGE_WEIGHT) * scaled).alias("weight"))
    ranks = personalised_pagerank(weighted_edges(facts, links, synonyms), seeds.unionByName(passages)).filter(F.col("vertex").startswith("c:"))
    walked = ranks.select("query_id", F.expr("substring(vertex, 3)").alias("chunk_id"), F.round("score", 9).alias("score"))
    plain = similar.join(some, "query_id", "left_anti").select("query_id", F.col("id").alias("chunk_id"), F.col("similarity").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    found = walked.unionByName(plain).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return found if kept is not None else of_members(found, members)


class GraphCache:
    """The weighted edges of a graph, built again only when its stamp changes; one build at a time."""

    def __init__(self):
        self._lock, self._stamp, self._edges = threading.Lock(), None, None

    def edges(self, facts: DataFrame, links: DataFrame, synonyms: DataFrame) -> DataFrame:
        stamp = tuple(corpus_stamp({"facts": facts, "links": links, "synonyms": synonyms}).first())
        with self._lock:
            if stamp != self._stamp:
                self._edges, self._stamp = written(weighted_edges(facts, links, synonyms), "graph"), stamp
            return self._edges


def synonym_edges(new: DataFrame, phrases: DataFrame, threshold: float = SYNONYM_THRESHOLD, neighbours: int = SYNONYM_NEIGHBOURS) -> DataFrame:
    """``(phrase_a, phrase_b, weight)``: each new phrase with its most similar others from the threshold up, at most ``neighbours``.

    The new phrases are a query set, searched in blocks against all phrases; handles stand in for their ids.
    """
    handle = F.xxhash64("phrase_id").alias("query_id")
    found = nearest_rows(new.select(handle, F.col("embedding").alias("vec")), phrases.select(F.col("phrase_id").alias("id"), F.col("embedding").alias("vec")), neighbours + 1)
    pairs = found.filter(F.col("similarity") >= threshold).join(new.select(handle, "phrase_id"), "query_id").filter("phrase_id != id")
    order = Window.partitionBy("phrase_id").orderBy(F.desc("similarity"), "id")
    kept = pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= neighbours)
    return kept.groupBy(F.least("phrase_id", "id").alias("phrase_a"), F.greatest("phrase_id", "id").alias("phrase_b")).agg(F.round(F.max("similarity"), 6).alias("weight"))


def without_orphans(phrases: DataFrame, facts: DataFrame, links: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(phrases, facts, links, edges) after facts no passage states, phrases no fact names, and their edges are gone."""
    links = links.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    facts = facts.join(links.select("fact_id").distinct(), "fact_id", "left_semi")
    links = links.join(facts.select("fact_id"), "fact_id", "left_semi")
    named = facts.select(F.col("subject_id").alias("phrase_id")).union(facts.select("object_id")).distinct()
    phrases = phrases.join(named, "phrase_id", "left_semi")
    for end in ("phrase_a", "phrase_b"):
        edges = edges.join(phrases.select(F.col("phrase_id").alias(end)), end, "left_semi")
    return phrases, facts, links, edges


def orphan_phrases(phrases: DataFrame, facts: DataFrame) -> DataFrame:
    named = facts.select(F.col("subject_id").alias("phrase_id")).union(facts.select("object_id")).filter("phrase_id is not null").distinct()
    return phrases.join(named, "phrase_id", "left_anti").select("phrase_id", "phrase")


def phrase_facts(phrases: DataFrame, facts: DataFrame) -> DataFrame:
    """``(phrase_id, fact_id)`` of facts that name the phrase at either end, by two equi-joins."""
    by_subject = phrases.join(facts, phrases.phrase_id == facts.subject_id).select("phrase_id", "fact_id")
    return by_subject.union(phrases.join(facts, phrases.phrase_id == facts.object_id).select("phrase_id", "fact_id")).distinct()


def graph_totals(phrases: DataFrame, facts: DataFrame, links: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how many phrases, facts, links, synonym edges, chunks whose facts were extracted, and chunks."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    done = links.select("chunk_id").distinct()
    parts = [one(phrases, "phrases"), one(facts, "facts"), one(links, "links"), one(edges, "edges"), one(chunks.join(done, "chunk_id", "left_semi"), "extracted"), one(chunks, "chunks")]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
