import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import replies, text as tx, words
from tessera.functions.stems import stem
from tessera.functions.vectors import VectorIndex, cosine, nearest_rows
from tessera.operators import catalog, charts, citations, conversations, graph, mutation, packing, retrieval
from tessera.operators.ranking import running_offset
from tessera.providers import LocalProvider, embed_all, or_else, with_embeddings

CHUNKS = "chunk_id string, filename string, chunk_index int, content string, source_type string, source_format string, page_number int, embedding array<float>, rank int, score double"


def chunk(i, file="a/f.txt", index=0, content="words here", kind="text", vec=(1.0, 0.0)):
    return (i, file, index, content, kind, "txt", 1, None if vec is None else [float(x) for x in vec], 1, 0.5)


def test_running_offset_in_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(50), i, rng.randrange(4)) for i in range(800)]
    df = spark.createDataFrame(data, "k string, o int, id int, v int")
    got = {r.id: r.before for r in running_offset(df, ["k"], ["o", "id"], F.col("v"), "before", 7).collect()}
    seen: dict = {}
    for k, o, i, v in sorted(data, key=lambda r: (str(r[0]), r[1], r[2])):
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + v
    assert running_offset(df.limit(0), ["k"], ["o", "id"], F.col("v"), "before").count() == 0


def test_nearest_rows_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(120, 8)).astype(np.float32)
    rows = [(f"r{i:03d}", v.tolist(), 1) for i, v in enumerate(m)] + [("z", [0.0] * 8, 1), ("n", None, 1), ("s", [1.0], 1), ("copy", m[0].tolist(), 1)]
    q = [(i, rng.normal(size=8).tolist()) for i in range(5)] + [(9, [0.0] * 8), (10, None)]
    got = nearest_rows(spark.createDataFrame(q, "query_id long, vec array<double>"), spark.createDataFrame(rows, "id string, vec array<float>, rank int").repartition(5), 4).collect()
    ids = [r[0] for r in rows[:120]] + ["copy"]
    all_m = np.concatenate([m, m[:1]]).astype(float)
    for i, v in q[:5]:
        s = np.round(all_m @ np.array(v) / np.linalg.norm(all_m, axis=1) / np.linalg.norm(v), 9)
        want = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:4]]
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == set(range(5))
    assert spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c is None


def shuffled(spark, run):
    """Rows that the stages of ``run`` wrote for a shuffle, the most of one stage."""
    context = spark.sparkContext._jsc.sc()
    stages = lambda: context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    out = run()
    context.listenerBus().waitUntilEmpty(30_000)
    return out, max(s.shuffleWriteRecords() for s in (stages().apply(i) for i in range(stages().size())) if s.stageId() not in known)


def shuffled_bytes(spark, run):
    """Bytes that the stages of ``run`` wrote for a shuffle, all together."""
    context = spark.sparkContext._jsc.sc()
    stages = lambda: context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    out = run()
    context.listenerBus().waitUntilEmpty(30_000)
    return out, sum(s.shuffleWriteBytes() for s in (stages().apply(i) for i in range(stages().size())) if s.stageId() not in known)


def long_chunks(spark, n=40, questions=150):
    """(chunks of 20,000 characters in files of two, results of ``questions`` questions that find ten each)."""
    rng = random.Random(8)
    rows = [chunk(f"c{i:02d}", file=f"f{i // 2}", index=i % 2, content=f"{rng.randbytes(10_000).hex()}") for i in range(n)]
    rows += [chunk("x1", file="g", index=0, content=" Same  TEXT"), chunk("x2", file="g", index=9, content="same text"), chunk("y1", file="g", content=None, kind="image_caption"), chunk("y2", file=None, content="alone")]
    results = [(q, f"c{(q + 3 * i) % n:02d}", i + 1) for q in range(questions) for i in range(10)] + [(q, c, 11 + i) for q in range(questions) for i, c in enumerate(("x1", "x2", "y1", "y2"))]
    return spark.createDataFrame(rows, CHUNKS).repartition(4), spark.createDataFrame(results, "query_id long, chunk_id string, rank int")


def test_texts_found_by_many_questions_are_not_shuffled_for_each(spark):
    c, results = long_chunks(spark)
    folded, moved = shuffled_bytes(spark, lambda: retrieval.collapse_duplicates(results, c).collect())
    assert moved < 2_000_000 < 1_500 * 20_000
    own = {(r.query_id, r.chunk_id) for r in folded}
    assert {i for q, i in own if q == 0 and i[0] != "c"} == {"x1", "y1", "y2"} and len(own) == len(folded)


def test_context_found_by_many_questions_is_put_together_once(spark):
    c, results = long_chunks(spark)
    text = {r.chunk_id: r.content for r in c.collect()}
    got, moved = shuffled_bytes(spark, lambda: retrieval.expand_context(results, c).collect())
    assert moved < 4_000_000 < 1_500 * 20_000
    assert {(r.query_id, r.chunk_id) for r in got} == {(r.query_id, r.chunk_id) for r in retrieval.collapse_duplicates(results, c).collect()}
    for r in got:
        if r.chunk_id[0] == "c":
            n = int(r.chunk_id[1:]) // 2 * 2
            assert r.content == text[f"c{n:02d}"] + "\n" + text[f"c{n + 1:02d}"]
        else:
            assert r.content == {"x1": text["x1"], "y1": None, "y2": "alone"}[r.chunk_id]


def test_context_of_many_questions_is_written_once(spark, tmp_path):
    c, results = long_chunks(spark, n=200, questions=600)
    alone = spark.createDataFrame([chunk("y3", file="h", content="shown " * 3_000, kind="chart_data")], CHUNKS)
    results = results.unionByName(results.filter("rank = 1").withColumn("chunk_id", F.lit("y3")).withColumn("rank", F.lit(15)))
    retrieval.expand_context(results, c.unionByName(alone)).write.parquet(out := str(tmp_path / "out"))
    got = spark.read.parquet(out).groupBy("query_id").agg(F.count_distinct("chunk_id").alias("rows"), F.sum(F.length("content")).alias("chars"), F.count("content").alias("texts")).collect()
    assert len(got) == 600 and {(r.rows, r.texts) for r in got} == {(14, 13)} and {r.chars for r in got} == {10 * 40_001 + 11 + 5 + 18_000}
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) < 12_000_000 < 600 * 400_000  # of 4,000,000 characters that differ


def test_a_search_moves_no_text_for_each_question(spark):
    c, _ = long_chunks(spark)
    q = spark.createDataFrame([(i, "same text alone", [1.0, 0.5]) for i in range(150)], "query_id long, text string, vec array<double>")
    postings = retrieval.build_postings(c)
    got, moved = shuffled_bytes(spark, lambda: retrieval.hybrid_search(q, c, 10, postings).collect())
    assert sum(len(r.content or "") for r in got) > 15_000_000 and moved < 6_000_000


def test_words_are_ranked_where_the_chunks_lie(spark):
    rng = random.Random(2)
    text = lambda n: "common " + " ".join(rng.choice("alpha beta gamma delta running runs the of epsilon".split()) for _ in range(n))
    rows = [chunk(f"c{rng.randrange(300):03d}", content=text(rng.randrange(9))) for _ in range(330)] + [chunk("x", content=None)]  # some ids twice
    c = spark.createDataFrame(rows, CHUNKS).repartition(3)
    q = spark.createDataFrame([(i, text(4), [1.0]) for i in range(150)] + [(900, None, [1.0])], "query_id long, text string, vec array<double>")
    for o in ({}, {"stem": True}, {"postings": retrieval.build_postings(c)}, {"postings": retrieval.build_postings(c, stem=True), "stem": True}):
        lists = {}
        for r in retrieval.text_scores(q, c, **o).collect():
            lists.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
        got, most = shuffled(spark, lambda o=o: retrieval.text_ranks(q, c, 3, **o).collect())
        assert {(r.query_id, r["rank"]): (-r.score, r.chunk_id) for r in got} == {(i, n + 1): v for i, x in lists.items() for n, v in enumerate(sorted(x)[:3])}
        assert most < 8_000 < sum(map(len, lists.values()))  # pairs of question and chunk are not shuffled


def test_words_within_a_file_are_scored_there_alone(spark):
    rows = [chunk(f"c{i:03d}", file=f"f{i // 2}", content=f"common w{i % 3} w{i % 3}") for i in range(200)]
    c = spark.createDataFrame(rows, CHUNKS)
    q = spark.createDataFrame([(i, f"common w{i % 3}", [1.0, 0.0]) for i in range(100)], "query_id long, text string, vec array<double>")
    picked = spark.createDataFrame([(i, f"f{i}") for i in range(100)], "query_id long, filename string")
    for postings in (None, retrieval.build_postings(c)):
        got, most = shuffled(spark, lambda postings=postings: retrieval.search_within(q, c, picked, 2, postings).collect())
        score = {(r.query_id, r.chunk_id): r.score for r in retrieval.text_scores(q, c, postings).collect()}
        assert len(got) == 200 and most < 5_000 < len(score)
        for i in range(100):
            mine = [r.chunk_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])]
            by_words = sorted((f"c{2 * i:03d}", f"c{2 * i + 1:03d}"), key=lambda x: (-score[i, x], x))
            fused = {x: round(1 / (61 + n) + 1 / (61 + by_words.index(x)), 9) for n, x in enumerate((f"c{2 * i:03d}", f"c{2 * i + 1:03d}"))}
            assert mine == sorted(fused, key=lambda x: (-fused[x], x)) and [r.score for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [fused[x] for x in mine]


def test_questions_of_one_vector_are_searched_once(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(f"r{i:02d}", v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "id string, vec array<double>").repartition(4)
    kinds = rng.normal(size=(3, 4)).tolist()
    queries = spark.createDataFrame([(i, kinds[i % 3]) for i in range(900)] + [(901, None)], "query_id long, vec array<double>")
    got, most = shuffled(spark, lambda: nearest_rows(queries, rows, 5).collect())
    alone = {r.query_id: [] for r in got}
    for r in sorted(got, key=lambda r: r["rank"]):
        alone[r.query_id].append((r.id, r.similarity, r["rank"]))
    want = nearest_rows(queries.filter("query_id < 3"), rows, 5).collect()
    assert sorted(alone) == list(range(900)) and all(alone[i] == [x[1:] for x in sorted(map(tuple, want), key=lambda x: x[3]) if x[0] == i % 3] for i in range(900))
    assert most < 4 * 900 < 900 * 5  # were each question searched, five rows each and task


def test_words_are_ranked_alike_over_many_spans():
    rng = np.random.default_rng(4)
    tf = rng.integers(0, 4, size=(40_000, 6)) * (rng.random((40_000, 6)) < 0.3)
    at, word = np.nonzero(tf)
    ids = np.array([f"c{i:05d}" for i in range(len(tf))])
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[at[x]]), pa.array(word[x] * 7), pa.array(tf[at[x], word[x]])], names=["chunk_id", "word", "tf"]) for x in np.array_split(rng.permutation(len(at)), 9)]
    asked = [[0, 1, 2], [3, 5], [4]]
    run = words._best(pa.array([5, 6, 7]), np.array([0, 3, 5, 6]), np.concatenate(asked), np.arange(6) * 7, 50)
    got = pa.Table.from_batches(list(run(iter(batches)))).to_pandas()
    for name, own in zip((5, 6, 7), asked):
        score = np.round((tf[:, own] / (tf[:, own] + 1)).sum(1), 9)
        want = np.lexsort((ids, -score))[:50]
        mine = got[got.query_id == name].sort_values(["score", "chunk_id"], ascending=[False, True])
        assert mine.chunk_id.tolist() == ids[want].tolist() and mine.score.tolist() == score[want].tolist()


def test_mmr_prefers_what_is_new():
    scores = np.array([1.0, 0.99, 0.6])
    vectors = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    assert retrieval.mmr_order(scores, vectors, 3) == [0, 2, 1]
    assert retrieval.mmr_order(np.zeros(2), np.zeros((2, 2)), 5) == [0, 1]
    assert retrieval.mmr_order(np.array([0.9, 0.9]), np.array([[1.0, 0], [-1.0, 0]]), 2) == [0, 1]


def test_search_handles_nulls_ties_and_empty_tables(spark):
    rows = [chunk("b"), chunk("a"), chunk("c", content=None), chunk("d", content="", vec=None), chunk("e", vec=(0, 0)), chunk("f", file=None, index=None, kind=None), chunk("g", content="term " * 20_000)]
    c = spark.createDataFrame(rows, CHUNKS)
    q = spark.createDataFrame([(1, "Words, words", [1.0, 0.0]), (2, None, None), (3, "the of", [0.0, 0.0])], "query_id long, text string, vec array<double>")
    got = retrieval.hybrid_candidates(q, c, 5).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got if r.query_id == 1][:2] == ["a", "b"] and {r.query_id for r in got} == {1}
    none = spark.createDataFrame([], CHUNKS)
    assert retrieval.hybrid_candidates(q, none, 5).count() == 0
    assert retrieval.hybrid_search(q, none, 5).count() == 0
    assert retrieval.hybrid_search(q, c, 5).count() > 0


def test_spans_are_folded_by_their_union(spark):
    rng = random.Random(3)
    rows = [chunk(f"c{i:02d}", file=f"f{i % 2}", index=i // 2, content=f"text {i % 17} {i}") for i in range(60)]
    picked = rng.sample(range(60), 25)
    results = spark.createDataFrame([(1, f"c{i:02d}", r) for r, i in enumerate(picked)], "query_id long, chunk_id string, rank int")
    got = retrieval.collapse_duplicates(results, spark.createDataFrame(rows, CHUNKS)).collect()
    for f in (0, 1):
        spans = sorted((r.span_start, r.span_end) for r in got if int(r.chunk_id[1:]) % 2 == f)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        covered = {i for a, b in spans for i in range(a, b + 1)}
        assert covered == {i // 2 + o for i in picked if i % 2 == f for o in (-1, 0, 1)}


@pytest.mark.parametrize("limit", [50, 120])
def test_next_fit_equals_a_loop(spark, limit):
    rng = random.Random(limit)
    data = [(g, o, rng.randrange(1, 90)) for g in (1, 2) for o in range(40)]
    got = {(r.g, r.o): r.batch_no for r in packing.next_fit(spark.createDataFrame(data, "g int, o long, c int"), "g", "o", F.col("c"), limit).collect()}
    for g in (1, 2):
        used, batch = 0, 0
        for _, o, c in (d for d in data if d[0] == g):
            if batch == 0 or used + c + 20 > limit:
                batch, used = batch + 1, 0
            used += c + 20
            assert got[g, o] == batch


def test_spread_sample_keeps_heads_and_an_even_rest(spark):
    rows = [(f"c{i:03d}", "f", i, "x", "text", "xlsx", i // 25, None, 1, 0.0) for i in range(100)]
    got = [r.chunk_id for r in packing.spread_sample(spark.createDataFrame(rows, CHUNKS), 10).orderBy("place").collect()]
    rest = [i for i in range(100) if i % 25]
    want = sorted([0, 25, 50, 75] + [rest[int(k * len(rest) / 6)] for k in range(6)])
    assert got == [f"c{i:03d}" for i in want]


def test_spread_sample_reads_other_files_whole_and_keeps_every_head(spark):
    rows = [(f"d{i:03d}", "doc", i, "x", "text", "docx", i, None, 1, 0.0) for i in range(60)] + [(f"s{i:03d}", "sheets", i, "x", "text", "xlsx", i, None, 1, 0.0) for i in range(60)]
    got = [r.chunk_id for r in packing.spread_sample(spark.createDataFrame(rows, CHUNKS), 10).collect()]
    assert len(got) == 120  # every sheet has one chunk, so all are heads


def test_numbered_lines_fit_the_room(spark):
    rows = [(1, 1, "a", "x" * 30), (1, 2, "b", "y" * 30), (1, 3, "a", "x" * 30), (1, 4, "c", "z" * 300), (1, 5, "d", None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, k string, content string")
    got = packing.number_within(df, "query_id", "rank", F.col("k"), F.col("content"), 120, offset=2).orderBy("place").collect()
    assert [(r.number, r.pointer) for r in got] == [(3, False), (4, False), (3, True), (None, None)]
    assert got[2].line == "[3] (same passage as [3] above)" and got[3].line == "(2 more results did not fit and were left out.)"


def test_only_lines_that_fit_are_given_their_texts(spark):
    c, results = long_chunks(spark)
    rows = results.join(c.select("chunk_id", "filename", "content"), "chunk_id")
    room = 15_000  # of ten texts of 13,334 tokens one fits
    want = sorted(map(tuple, packing.number_within(rows, "query_id", "rank", F.col("content"), F.col("content"), room).collect()))
    slim = results.join(c.select("chunk_id", F.sha2("content", 256).alias("source"), F.length("content").alias("chars")), "chunk_id")
    lines = lambda: packing.fitting_lines(packing.place_within(slim, "query_id", "rank", F.col("source"), F.col("chars")), "query_id", room, c.select("chunk_id", F.col("content").alias("text")), "chunk_id").collect()
    got, moved = shuffled_bytes(spark, lines)
    assert sorted(map(tuple, got)) == want and len(want) == 300 and moved < 2_000_000
    _, moved = shuffled_bytes(spark, lambda: packing.number_sources(rows, "query_id", "rank", F.col("content")).select("query_id", "chunk_id", "number", "pointer").collect())
    assert moved < 2_000_000  # keys are shuffled as digests


def test_notes_are_numbered_by_first_use(spark):
    rows = [(1, 1, "b.pdf", "e1", "page 1", "one", 7), (1, 2, "a.pdf", "e2", "text", "two", 1), (1, 3, "a.pdf", "e3", "text", "three", 0), (1, 4, "a.pdf", "e3", "text", "four", 0)]
    notes = spark.createDataFrame(rows, "query_id long, note_no int, filename string, excerpt string, label string, claim string, position int")
    got = packing.render_notes(notes, 1_000).orderBy("number").collect()
    assert [r.block for r in got] == ["## a.pdf\n- [1] (text) three\n- [1] (text) four\n- [2] (text) two", "## b.pdf\n- [3] (page 1) one"]
    assert [r.filename for r in packing.render_notes(notes, 50).collect()] == ["a.pdf"] and packing.render_notes(notes.filter("false"), 40).count() == 0


def test_facts_weigh_by_the_passages_that_state_them(spark):
    facts = spark.createDataFrame([("f1", "p1", "p2"), ("f2", "p2", "p1"), ("f3", "p1", None), ("f4", "p1", "p3")], "fact_id string, subject_id string, object_id string")
    links = spark.createDataFrame([("f1", "c1"), ("f1", "c2"), ("f1", "c2"), ("f2", "c1"), ("f3", "c1")], "fact_id string, chunk_id string")
    assert [(r.phrase_a, r.phrase_b, r.facts) for r in graph.fact_edges(facts, links).collect()] == [("p1", "p2", 3)]
    none = spark.createDataFrame([("p1", "p2", 0.9), ("p1", "p2", float("nan"))], "phrase_a string, phrase_b string, weight double")
    got = {(r.a, r.b): r.weight for r in graph.weighted_edges(facts, links, none).collect()}
    assert abs(got["p:p1", "p:p2"] - 7.8) < 1e-9 and got["c:c1", "p:p1"] == 1
    cache = graph.GraphCache()
    first = cache.edges(facts, links, none)
    assert cache.edges(facts, links, none) is first and cache.edges(facts, links.filter("chunk_id = 'c1'"), none) is not first


def test_facts_are_scored_above_the_least_similar_of_all(spark):
    unit = lambda a: [math.cos(a), math.sin(a)]
    angles = {f"f{i}": 0.1 * i for i in range(5)} | {"far": 3.0}
    vectors = spark.createDataFrame([(f, unit(a)) for f, a in angles.items()], "fact_id string, embedding array<double>")
    facts = spark.createDataFrame([(f, f"s{f}", None) for f in angles], "fact_id string, subject_id string, object_id string")
    links = spark.createDataFrame([(f, "c") for f in angles], "fact_id string, chunk_id string")
    q = spark.createDataFrame([(1, "q", unit(0.0))], "query_id long, text string, vec array<double>")
    got = {r.phrase_id: r.weight for r in graph.seed_phrases(q, facts, links, vectors).collect()}
    low = math.cos(3.0)
    assert set(got) == {f"sf{i}" for i in range(5)} and all(abs(got[f"sf{i}"] - (math.cos(0.1 * i) - low) / (1 - low)) < 1e-6 for i in range(5))
    kept = spark.createDataFrame([(1, "f3")], "query_id long, fact_id string")
    assert [r.phrase_id for r in graph.seed_phrases(q, facts, links, vectors, kept).collect()] == ["sf3"]


def test_only_text_is_read_with_its_neighbours(spark):
    rows = [chunk(f"c{i}", file="f", index=i, content=str(i)) for i in range(6)]
    results = spark.createDataFrame([(1, f"c{i}", i + 1) for i in range(6)], "query_id long, chunk_id string, rank int")
    spans = spark.createDataFrame([("f", 1, "text"), ("f", 4, "chart_data")], "filename string, chunk_index int, source_type string")
    none = spark.createDataFrame([], "filename string")
    assert sorted(r.chunk_id for r in retrieval.uncovered(results, spark.createDataFrame(rows, CHUNKS), spans, none).collect()) == ["c3", "c5"]


def test_index_of_words_gives_the_scores_of_a_scan(spark):
    texts = ["the port budget, the port", "Budgets of ports", None, "", "x " * 5_000 + "port"]
    c = spark.createDataFrame([chunk(f"c{i}", content=t) for i, t in enumerate(texts)], CHUNKS)
    q = spark.createDataFrame([(1, "the Port budget?"), (2, None), (3, "the of")], "query_id long, text string")
    score = lambda **o: {(r.query_id, r.chunk_id): r.score for r in retrieval.text_scores(q, c, **o).collect()}
    assert score() == score(postings=retrieval.build_postings(c)) and set(score()) == {(1, "c0"), (1, "c4")}
    assert set(score(stem=True)) == set(score(postings=retrieval.build_postings(c, stem=True), stem=True)) == {(1, "c0"), (1, "c1"), (1, "c4")}


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("adoption", "adopt"), ("generalizations", "gener"), ("sky", "sky"), ("été", "été"), ("a1", "a1")])
def test_stems(word, want):
    assert stem(word) == want


def test_vector_index_recalls_the_exact_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1_500, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1_500)]
    rows = spark.createDataFrame([(f"r{i:04d}", x.tolist()) for i, x in enumerate(v)] + [("null", None), ("zero", [0.0] * 16), ("short", [1.0])], "id string, vec array<double>")
    queries = spark.createDataFrame([(i, v[i * 50].tolist()) for i in range(30)], "query_id long, vec array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/index").build(rows, 24)
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact, near, every = pairs(nearest_rows(queries, rows, 10)), pairs(index.search(queries, 10, 8)), pairs(VectorIndex(spark, index.path).search(queries, 10, 24))
    assert len(exact & near) >= 0.9 * len(exact) and every == exact


def test_pagerank_against_a_dense_solution(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 0.5), ("x", "y", 3.0), ("a", "a", 9.0), ("a", "c", -1.0)]
    names = sorted({n for e in edges for n in e[:2]} | {"lone"})
    w = np.zeros((len(names), len(names)))
    for a, b, v in edges:
        if v > 0 and a != b:
            w[names.index(a), names.index(b)] += v
            w[names.index(b), names.index(a)] += v
    start = {"a": 1.0, "lone": 1.0}
    r = np.array([start.get(n, 0.0) for n in names]) / 2
    p = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    p[w.sum(1) == 0] = r
    want = np.linalg.solve(np.eye(len(names)) - 0.5 * p.T, 0.5 * r)
    reset = spark.createDataFrame([(7, n, v) for n, v in start.items()], "query_id long, vertex string, weight double")
    got = {x.vertex: x.score for x in graph.personalised_pagerank(spark.createDataFrame(edges, "a string, b string, weight double"), reset).collect()}
    assert all(abs(got.get(n, 0.0) - want[i]) < 1e-5 for i, n in enumerate(names))


def test_walks_in_memory_equal_walks_by_joins(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame([(f"v{rng.randrange(80):02d}", f"v{rng.randrange(80):02d}", rng.random()) for _ in range(150)], "a string, b string, weight double")
    seeds = [(i, f"v{rng.randrange(80):02d}", rng.random()) for i in range(40) for _ in range(3)] + [(i, "lone", 1.0) for i in range(0, 40, 4)] + [(50, "lone", 2.0)]
    reset = spark.createDataFrame(seeds, "query_id long, vertex string, weight double").repartition(5)
    walk = lambda **o: {(r.query_id, r.vertex): r.score for r in graph.personalised_pagerank(edges, reset, **o).collect()}
    joined, (inside, most) = walk(in_memory=-1), shuffled(spark, walk)
    assert set(joined) == set(inside) and all(abs(joined[k] - inside[k]) < 1e-12 for k in joined)
    assert most <= len(joined) + 4 * 300  # the graph once for each part, and results; not what every vertex of every walk passes on
    assert graph.personalised_pagerank(edges.limit(0), reset).filter("query_id = 50").first().score == 1.0


def test_questions_of_one_vector_search_the_graph_once(spark):
    rng = np.random.default_rng(9)
    vec = lambda: rng.normal(size=4).tolist()
    c = spark.createDataFrame([chunk(f"c{i:02d}", vec=vec()) for i in range(60)], CHUNKS)
    facts = spark.createDataFrame([(f"f{i}", f"p{i % 7}", f"p{(i * 3 + 1) % 11}") for i in range(30)], "fact_id string, subject_id string, object_id string")
    links = spark.createDataFrame([(f"f{i}", f"c{i * 2 % 60:02d}") for i in range(30)], "fact_id string, chunk_id string")
    vectors = spark.createDataFrame([(f"f{i}", vec()) for i in range(30)], "fact_id string, embedding array<double>")
    none = spark.createDataFrame([], "phrase_a string, phrase_b string, weight double")
    kinds = [vec() for _ in range(3)]
    ask = lambda n: spark.createDataFrame([(i, kinds[i % 3]) for i in range(n)] + [(900, None)], "query_id long, vec array<double>")
    search = lambda q, kept=None: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in graph.graph_search(q, c, facts, links, none, vectors, 4, kept).collect()}
    got, most = shuffled(spark, lambda: search(ask(300)))
    every = spark.range(3).crossJoin(facts).selectExpr("id as query_id", "fact_id")
    alone = search(ask(3), every)  # a filter that keeps all: each question by itself
    assert len(alone) == 12 and got == {(i, n): alone[i % 3, n] for i in range(300) for n in range(1, 5)}
    assert most < 60 * 300  # not a row for each question and passage


def test_graph_building_and_orphans(spark):
    replies_df = spark.createDataFrame([("c1", '[["Ann", "works for", "The  Firm!"], ["x", "y"], ["a", "is", "A"], ["b", "", "c"]]'), ("c2", "no json"), ("c3", None), ("c4", '[["ann", "works for", "the firm"]]')], "chunk_id string, reply string")
    triples = graph.parse_triples(replies_df)
    assert sorted((r.chunk_id, r.subject, r.object) for r in triples.collect()) == [("c1", "ann", "the firm"), ("c4", "ann", "the firm")]
    phrases, facts, links = graph.build_graph(triples)
    assert (phrases.count(), facts.count(), links.count()) == (2, 1, 2)
    edges = spark.createDataFrame([], "phrase_a string, phrase_b string, weight double")
    left = graph.without_orphans(phrases, facts, links, edges, spark.createDataFrame([("c2",)], "chunk_id string"))
    assert [t.count() for t in left] == [0, 0, 0, 0]
    assert graph.weighted_edges(facts, links, edges).count() == 5


def test_paths_in_branches_and_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 2), (5, 99), (6, 7), (7, 6), (8, 8)] + [(100 + i, 99 + i if i else None) for i in range(70)]
    m = spark.createDataFrame(rows, "message_id long, parent_id long")
    leaves = spark.createDataFrame([(3,), (4,), (5,), (6,), (8,), (169,)], "message_id long")
    got: dict = {}
    for r in conversations.paths_to_root(m, leaves).collect():
        got.setdefault(r.leaf_id, {})[r.depth] = r.message_id
    assert got[3] == {0: 3, 1: 2, 2: 1} and got[4][1] == 2 and got[5] == {0: 5} and got[8] == {0: 8}
    assert set(got[6].values()) == {6, 7} and len(got[169]) == 70


def test_turns_are_appended_and_forked(spark):
    m = spark.createDataFrame([(1, 1, None, "user", "q", None), (2, 1, 1, "assistant", "a", None)], "message_id long, conversation_id long, parent_id long, role string, content string, created_at timestamp")
    c = spark.createDataFrame([(1, 2, None, "t", "me")], "conversation_id long, active_id long, updated_at timestamp, title string, owner_id string")
    turn = spark.createDataFrame([(1, 3, 4, None, "q2", "a2"), (1, 5, 6, -1, "q3", "a3"), (1, 7, 8, 1, "q4", "a4")], "conversation_id long, question_id long, answer_id long, parent long, question string, answer string").withColumn("created_at", F.current_timestamp())
    after, updated = conversations.append_turn(m, c, turn)
    parents = {r.message_id: r.parent_id for r in after.collect()}
    assert parents == {1: None, 2: 1, 3: 2, 4: 3, 5: None, 6: 5, 7: 1, 8: 7} and updated.first().active_id == 8
    assert conversations.rename(c, 1, "new", owner="other").first().title == "t"
    gone = conversations.delete_conversations(m, c, spark.createDataFrame([(1,)], "conversation_id long"))
    assert [t.count() for t in gone] == [0, 0]


def test_snapshots(spark, tmp_path):
    c = spark.createDataFrame([("a", 0, "old"), ("b", 0, "old")], "filename string, chunk_index int, content string")
    store = mutation.SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.versions() == {}
    store.commit({"chunks": c})
    new = spark.createDataFrame([("a", 0, "new"), ("a", 1, "new")], c.schema)
    for _ in range(2):
        store.commit({"chunks": mutation.replace_documents(store.read("chunks"), new)})
    assert sorted((r.filename, r.content) for r in store.read("chunks").collect()) == [("a", "new"), ("a", "new"), ("b", "old")]
    assert mutation.upsert(c, new.filter("chunk_index = 0"), ["filename"]).count() == 2
    assert mutation.insert_missing(c, new, ["filename"]).count() == 2


def test_one_of_two_writers_gets_a_conflict(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    mine, other = (mutation.SnapshotStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    assert mine.commit({"t": df}) == 1 and other.commit({"u": df}) == 2 and set(mine.versions()) == {"t", "u"}
    other._newest = lambda: 1  # it began before the second commit
    with pytest.raises(mutation.Conflict):
        other.commit({"t": df})
    assert mine.commit({"t": df}) == 3


def test_users_and_uploads(spark):
    files = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h1"), (3, "a", "h1"), (4, "c", "h2"), (5, "d", None)], "file_id long, filename string, sha256 string")
    known = spark.createDataFrame([("k", "h2"), ("z", None)], "filename string, sha256 string")
    assert sorted((r.file_id, r.holder) for r in mutation.reject_duplicates(files, known).collect()) == [(2, "a"), (4, "k")]
    at = lambda m: f"2025-01-01 00:{m:02d}:00"
    users = spark.createDataFrame([("u", "n", at(0)), ("v", "n", at(0)), ("w", "n", at(0))], "owner_id string, name string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    seen = spark.createDataFrame([("u", "n", at(4)), ("v", "m", at(4)), ("w", "n", at(6)), ("x", "n", at(1))], "owner_id string, name string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    got = {r.owner_id: (r["name"], r.seen_at.minute) for r in mutation.touch_users(users, seen).collect()}
    assert got == {"u": ("n", 0), "v": ("m", 4), "w": ("n", 6), "x": ("n", 1)}


def test_citations():
    answer = "Dr. Smith signed it [1]. See e.g. page 3 [2][3]!\n\n\n1. First item [4]\n```\ncode. [9] here\n```\n| a. b [5] |\n"
    assert citations.segment(answer) == [("Dr. Smith signed it.", [1]), ("See e.g. page 3!", [2, 3]), ("", []), ("1. First item", [4]), ("```", []), ("code. [9] here", []), ("```", []), ("| a. b |", [5])]
    assert citations.segment(None) == [] and citations.segment("\n\n") == []


def test_claims_are_judged_by_their_own_sources(spark):
    claims = spark.createDataFrame([(1, 1, "cats sleep", [1]), (1, 2, "dogs fly", [1, 2]), (1, 3, "no source", [])], "answer_id long, segment_no int, text string, source_indices array<int>")
    sources = spark.createDataFrame([(1, 1, "cats sleep a lot"), (1, 2, "dogs bark")], "answer_id long, source_no int, content string")
    got = citations.verify(claims, sources, lambda c, e: __import__("pandas").Series([a in b for a, b in zip(c, e)])).collect()
    assert sorted((r.segment_no, r.reason) for r in got) == [(2, "not supported"), (3, "no source")]


SPEC = {"type": "pie", "title": "t", "labels": ["2021", "2022", "2023"], "series": [{"name": "s", "values": [1000, 2, 3.5]}], "sources": [1]}


def test_chart_specs():
    parsed = charts.parse_chart(json.dumps(SPEC))
    assert parsed["type"] == "pie" and charts.fit_type(parsed)["type"] == "bar"
    assert charts.parse_chart('{"type": " Bar ", "title": "t", "labels": ["a"], "series": [{"name": "s", "values": [1,]}], "sources": [1][3],}')["sources"] == [1, 3]
    assert charts.parse_chart(json.dumps({**SPEC, "type": "line", "labels": [2021, 2022.5, "x"], "extra": 1}))["labels"] == ["2021", "2022.5", "x"]
    two = [{"name": "s", "values": [1, 2, 3]}, {"name": "u", "values": [1, 2, 3]}]
    bad = [{"type": "map"}, {"type": "area"}, {"title": ""}, {"title": "t" * 201}, {"labels": []}, {"labels": ["a"] * 61}, {"labels": ["a", None, "b"]}, {"series": [{"name": "s", "values": [1, "x", 2]}]}, {"series": [{"name": "s", "values": [1, True, 2]}]}]
    bad += [{"series": [{"name": "", "values": [1, 2, 3]}]}, {"series": two}, {"unit": "u" * 41}, {"sources": None}, {"sources": [1.5]}]
    for change in bad:
        assert charts.parse_chart(json.dumps({**SPEC, **change})) is None, change
    for text in ("", "{}", "[1]", "no"):
        assert charts.parse_chart(text) is None
    assert charts.is_time_series(["Q1", "Q2", "Q3 2024"]) and not charts.is_time_series(["1", "2", "3"]) and not charts.is_time_series(["2021"])
    assert '"values": [1000, 2, 3.5]' in charts.render(parsed) and "unverified" not in charts.render(parsed) and '"unverified": [2]' in charts.render(parsed, [2.0])


def test_charts_are_held_against_their_sources():
    block = "```Chart \r\n" + json.dumps({**SPEC, "type": "line", "sources": [2, 9, 2]}) + "\r\n``` \r\nend"
    text, kept, dropped, warnings = charts.filter_answer("- see\n  " + block, ["1,000 and 2 and 3.5", "only 1000"])
    assert (kept, dropped) == (1, 0) and text.startswith("- see\n  ```chart\n  {") and text.endswith("\n  ```\nend")
    made = json.loads(text.split("\n")[2])
    assert made["sources"] == [2] and made["unverified"] == [2, 3.5] and "2, 3.5" in warnings[0]
    whole = charts.filter_answer(block.replace("[2, 9, 2]", "[9]"), ["1,000 and 2 and 3.5", "x"])
    assert whole[3] == [] and "unverified" not in whole[0]  # without a valid citation all sources count
    assert charts.filter_answer("```chart", [])[0] == "```chart" and charts.proposed_block("so:\n```chart\n{}\n```\n") == "```chart\n{}\n```" and charts.proposed_block("NONE") is None
    assert charts.proposal_sources(["a  b", None]) == "[1] a b\n\n[2] "


ANSWERS = ["plain text", "", "a\n```chart\n" + json.dumps(SPEC) + "\n```\nb", "```chart\nbroken\n```\nrest", "text ```chart inline", "```python\nx = 1\n```\n", "```chart\nnever closed", "  ```chart\n" + json.dumps({**SPEC, "type": "line"}) + "\n  ```\nend"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_chart_filter_does_not_depend_on_tokens(size):
    for answer in ANSWERS:
        f = charts.ChartFilter()
        text = "".join(f.feed(answer[i : i + size]) for i in range(0, len(answer), size)) + f.finish()
        assert (text, f.charts, f.dropped, f.warnings) == charts.filter_answer(answer)
    assert charts.filter_answer(ANSWERS[3])[:3] == ("rest", 0, 1) and charts.filter_answer(ANSWERS[6])[:3] == ("", 0, 1)
    assert charts.filter_answer(ANSWERS[5])[0] == ANSWERS[5] and charts.filter_answer(ANSWERS[4])[0] == ANSWERS[4]


def test_chart_values_in_sources(spark):
    c = spark.createDataFrame([(1, [1000.0, 7.0], [2]), (2, [5.0], [9])], "chart_id long, values array<double>, sources array<int>")
    s = spark.createDataFrame([(1, 1, "7"), (1, 2, "about 1,000 and 3"), (2, 1, "it was 5.0")], "chart_id long, source_no int, content string")
    assert [(r.chart_id, r.value) for r in charts.unverified(c, s).collect()] == [(1, 7.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  A\t\nb  C ", "Été-des_ሰላም!", "a/b.c/Report.PDF", "-1,234.5 and .5 x 7")], "a string, b string, c string, d string")
    r = df.select(tx.normalise_text("a").alias("a"), tx.normalise_phrase("b").alias("b"), tx.suffix("c").alias("c"), tx.numbers("d").alias("d"), tx.cursor_decode(tx.cursor_encode(F.lit("2025-01-01 00:00:00"), F.lit("k?>9"))).alias("e"), *(tx.cursor_decode(F.lit(x)).alias(f"x{i}") for i, x in enumerate(("", "%%%", "YWJj", "YXxi")))).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("a b c", "été des_ሰላም", "pdf", ["-1234.5", ".5", "7"], ("2025-01-01 00:00:00", "k?>9")) and (r.x0, r.x1, r.x2, r.x3) == (None,) * 4
    assert tx.STOP_WORDS[0] == "a" and len(set(tx.STOP_WORDS)) < 200


def test_filters_take_wildcards_or_not(spark):
    df = spark.createDataFrame([("100%/a_b.pdf",), ("1000/axb.pdf",), (None,)], "filename string")
    assert df.filter(catalog.like_filter("filename", "a_b")).count() == 2
    assert df.filter(catalog.literal_filter("filename", "A_B")).count() == 1
    assert df.filter(catalog.folder_filter("filename", "/100%/")).count() == 1


def test_duplicate_files_keep_the_recorded_then_the_shortest(spark):
    rows = [("long name.pdf", "h"), ("n.pdf", "h"), ("x.pdf", None), ("y.pdf", None), ("z.pdf", "k")]
    files = spark.createDataFrame(rows, "filename string, sha256 string").withColumn("created_at", F.current_timestamp())
    assert [tuple(r) for r in catalog.duplicate_files(files).collect()] == [("h", "n.pdf", 2)]
    recorded = spark.createDataFrame([("long name.pdf", "h")], "filename string, sha256 string")
    assert catalog.duplicate_files(files, recorded).first().kept == "long name.pdf"


def test_replies():
    assert replies.lines("- one\n2) `two`\nNONE\n- One\nHere they are:") == ["one", "two"] and replies.lines(None) == []
    assert replies.sub_queries("q", "1. a\n2. b\n3. c\n4. d") == ["q", "a", "b", "c"]
    assert replies.sections("PLAN: x\n- y\nGAPS:\nnone", ("PLAN", "GAPS")) == {"PLAN": ["x", "y"], "GAPS": []}
    assert replies.verdicts("1: drop\n3. keep", 3) == [False, True, True]
    assert replies.json_in('Sure: ```json\n{"a": [1]}\n``` done') == {"a": [1]} and replies.json_in("x [1, 2] y") == [1, 2] and replies.json_in("none") is None
    assert replies.closest("aple", ["pear", "apple"]) == "apple" and replies.closest("a", []) is None
    assert replies.angle_questions("Who: signed it?\nwhy - late?") == {"who": "signed it?", "why": "late?"} and replies.is_small_talk("Hello!") and replies.is_small_talk("Good morning, all") and not replies.is_small_talk("hire plan?") and not replies.is_small_talk("hello, what is the budget of the port for the next year")


def test_providers(spark):
    waits: list = []

    class Broken(LocalProvider):
        calls = 0

        def embed(self, texts):
            Broken.calls += 1
            raise OSError("down")

    with pytest.raises(OSError):
        embed_all(Broken(), ["x"], wait=waits.append)
    assert Broken.calls == 3 and waits == [2.0, 4.0] and or_else(lambda: 1 / 0, []) == []
    got = with_embeddings(spark.createDataFrame([("a b",), (None,), (" ",)], "t string"), "t", LocalProvider(8)).collect()
    assert len(got[0].embedding) == 8 and got[1].embedding is None and got[2].embedding is None
