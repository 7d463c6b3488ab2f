import random

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm.groups import connected_groups, tied_phrases

EDGES = "phrase_a string, phrase_b string, weight float"


def brute(pairs):
    group = {}
    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        left, right = group.get(a, {a}), group.get(b, {b})
        both = left | right
        for x in both:
            group[x] = both
    return {x: min(g) for x, g in group.items()}


@pytest.mark.parametrize("cap", [3, 40, 100_000])
def test_groups_equal_brute_force_at_every_partition_size(spark, cap):
    rng = random.Random(3)
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]  # a chain numbered in sequence
    pairs += [(f"h{0}", f"h{i}") for i in range(1, 50)]  # a star
    pairs += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    pairs += [pairs[0], pairs[5][::-1], ("x", "x"), (None, "y"), ("z", None)]
    found = connected_groups(spark.createDataFrame(pairs, "l string, r string"), "l", "r", max_edges=cap).collect()
    assert {r.member: r.group_id for r in found} == brute(pairs) and len(found) == len(brute(pairs))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_any_graph(spark, edges):
    pairs = [(str(a), str(b)) for a, b in edges]
    found = connected_groups(spark.createDataFrame(pairs, "l string, r string"), "l", "r", max_edges=4).collect()
    assert {r.member: r.group_id for r in found} == brute(pairs)


def test_weights_and_missing_phrases(spark):
    nan, inf = float("nan"), float("inf")
    edges = [("a", "b", 0.8), ("c", "b", 0.9), ("d", "e", 0.79), ("f", "g", nan), ("h", "i", None), ("j", "k", -1.0), ("l", "m", inf), ("n", "gone", 0.9), ("a", "a", 1.0), (None, "a", 1.0)]
    phrases = [(x, "text", 1) for x in "abcdefghijklmn"] + [(None, "t", 1), ("a", "again", 1)]
    found = tied_phrases(spark.createDataFrame(edges, EDGES), spark.createDataFrame(phrases, "phrase_id string, weight string, phrase_a int")).collect()
    assert sorted((r.phrase_id, r.group_id) for r in found) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_empty(spark):
    assert tied_phrases(spark.createDataFrame([], EDGES), spark.createDataFrame([], "phrase_id string")).count() == 0
    with pytest.raises(ValueError):
        connected_groups(spark.createDataFrame([], "l string, r string"), "l", "r", max_edges=0)
