import random

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm.packing import encoder, fill_report, pack_histogram, pack_texts, TOKENIZER

DOCS = "doc_id long, text string, tokens string, share int"


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=40))
def test_patterns_use_the_histogram_up(histogram):
    used: dict[int, int] = {}
    for pattern, count in pack_histogram(histogram, 64):
        assert 0 < sum(pattern) <= 64 and count > 0
        for n in pattern:
            used[n] = used.get(n, 0) + count
    assert used == {n: c for n, c in histogram.items() if c}


def test_little_room_is_lost():
    rng = random.Random(4)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        n = min(2_048, int(rng.lognormvariate(5.5, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    patterns = pack_histogram(histogram, 2_048)
    total = sum(n * c for n, c in histogram.items())
    assert total / (2_048 * sum(c for _, c in patterns)) > 0.97
    with pytest.raises(ValueError):
        pack_histogram({3_000: 1}, 2_048)


def test_every_text_once_and_nothing_overflows(spark):
    rng = random.Random(1)
    texts = [" ".join("word" for _ in range(rng.randint(1, 90))) for _ in range(200)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1), (900, None, "x", 1), (901, "", "x", 1), (902, "long text " * 400, "x", 1)]
    got = pack_texts(spark.createDataFrame(rows, DOCS), capacity=100).collect()
    size = {i: len(encoder(TOKENIZER).encode_ordinary(t)) for i, t, *_ in rows if t}
    fill: dict[int, int] = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert {r.doc_id for r in got} == set(size)
    assert sum(r.tokens for r in got if r.doc_id == 902) == size[902] > 100
    assert sum(r.doc_id == 0 for r in got) == 2
    assert {r.doc_id for r in got if r.piece_no > 1} == {902}
    one = fill_report(pack_texts(spark.createDataFrame(rows, DOCS), capacity=100), 100).first()
    assert one.containers == len(fill) and one.filled > 0.9


def test_empty(spark):
    none = pack_texts(spark.createDataFrame([], DOCS))
    assert none.count() == 0 and fill_report(none).first().containers == 0
