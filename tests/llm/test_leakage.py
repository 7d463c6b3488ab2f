import itertools
import random

import numpy as np

from tessera.llm.leakage import MASKS, TOLERANT_MASKS, best_overlap, compare_diagonal, leaked_items, leaks, tolerant_leaks, words_of

DOCS = "doc_id long, text string, words string, seed int"
ITEMS = "item_id long, text string, kind string"


def brute(docs, items, n=13):
    grams = {}
    for i, t, *_ in items:
        w = words_of(t) if t else []
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = words_of(t) if t else []
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def made(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def test_words():
    assert words_of("Été_2 naïve, CO-OP wit­ness ﬁne") == ["ete", "2", "naive", "co", "op", "witness", "fine"]
    assert all(len(m) == 13 and m[0] == m[-1] == "1" for m in MASKS)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(made(rng, rng.choice([5, 13, 40, 90]))), None) for i in range(30)] + [(99, None, "x"), (98, "", "x")]
    items.append((77, items[3][1], "shared"))
    docs = []
    for d in range(120):
        body = made(rng, rng.randrange(20, 300))
        if d % 3 == 0:
            source = rng.choice(items[:30])[1].split()
            n = rng.choice([11, 12, 13, 14, 30])
            at = rng.randrange(max(len(source) - n, 0) + 1)
            body[10:10] = source[at : at + n]
        text = "**" + ",  ".join(body).upper() + "."
        docs.append((d, text, "x", 1))
    docs += [docs[0], (500, None, "x", 1), (501, "", "x", 1), (502, " ".join(made(rng, 60_000)), "x", 1)]
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs, items) and len(got) >= 8


def test_substitutions_are_tolerated_but_not_counted_as_a_run(spark):
    rng = random.Random(8)
    source = made(rng, 40)
    changed = source.copy()
    changed[9] = changed[21] = changed[31] = "changed"
    docs = spark.createDataFrame([(1, " ".join(made(rng, 50) + changed + made(rng, 50)), "x", 1)], DOCS)
    items = spark.createDataFrame([(5, " ".join(source), None)], ITEMS)
    assert leaks(docs, items).count() == 0
    best = tolerant_leaks(docs, items).first()
    assert (best.doc_id, best.item_id, best.start, best.longest_run, best.equal_words, best.overlap_words) == (1, 5, 50, 11, 37, 40)


def test_diagonal_and_empty(spark):
    a = np.arange(30, dtype=np.int64)
    assert compare_diagonal(a, a[5:20], 5, 8) == (15, 15, 15, 5)
    none = spark.createDataFrame([], DOCS)
    assert leaked_items(none, spark.createDataFrame([], ITEMS)).count() == 0
    assert leaks(none, spark.createDataFrame([(1, "a " * 20, None)], ITEMS)).count() == 0


def test_an_overlap_after_a_poor_fragment_is_measured(spark):
    rng = random.Random(9)
    source = made(rng, 60)
    changed = [w if i < 9 or i >= 20 else "wrong" for i, w in enumerate(source)]
    docs = spark.createDataFrame([(1, " ".join(made(rng, 40) + changed + made(rng, 40)), "x", 1)], DOCS)
    items = spark.createDataFrame([(5, " ".join(source), None)], ITEMS)
    assert leaks(docs, items).count() == 1
    best = tolerant_leaks(docs, items).first()
    assert (best.doc_id, best.item_id, best.start, best.equal_words, best.overlap_words) == (1, 5, 60, 40, 40)
    a, b = np.arange(20), np.arange(20)
    b[8:12] = -1  # four wrong words in a row, yet 16 of 20 are equal
    assert best_overlap(a, b, 0, 0) == (8, 16, 20, 0)


def test_every_pattern_within_the_limits_has_a_seed(spark):
    for words in range(13, 26):
        for wrong in itertools.combinations(range(1, words - 1), words // 5):
            pattern = [i not in wrong for i in range(words)]
            assert any(all(pattern[at + i] for i, c in enumerate(m) if c == "1") for m in TOLERANT_MASKS for at in range(words - len(m) + 1)), pattern
    patterns = [(n, w) for n in (13, 15) for w in itertools.combinations(range(1, n - 1), n // 5)][::4]
    docs, items = [], []
    for k, (n, wrong) in enumerate(patterns):
        text = [f"w{k}x{i}" for i in range(n)]
        items.append((k, " ".join(text), None))
        docs.append((k, " ".join(f"other{k}" if i in wrong else w for i, w in enumerate(text)), "x", 1))
    got = {(r.doc_id, r.item_id) for r in tolerant_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(k, k) for k in range(len(patterns))}


def test_an_overlap_runs_to_its_end_though_no_seed_is_left(spark):
    rng = random.Random(12)
    source = [f"s{i}" for i in range(160)]
    typed = [w if i < 60 or (i - 60) % 7 not in (3, 6) else f"other{i}" for i, w in enumerate(source)]
    docs = spark.createDataFrame([(1, " ".join(made(rng, 50) + typed + made(rng, 50)), "x", 1)], DOCS)
    best = tolerant_leaks(docs, spark.createDataFrame([(5, " ".join(source), None)], ITEMS)).first()
    assert best.longest_run == 63 and best.overlap_words >= 155 and best.equal_words >= 0.8 * best.overlap_words
