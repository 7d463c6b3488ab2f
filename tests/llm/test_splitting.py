import random

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm.splitting import WHITE_SPACE, oversized_pieces, split_chunks, split_text

CHUNKS = "chunk_id string, filename string, chunk_index int, content string, page_number int, source_type string, words int"


def words(text):
    return [w for w in "".join(" " if c in WHITE_SPACE else c for c in text).split(" ") if w]


def rebuilt(text, **options):
    out = []
    for a, b, n, shared in split_text(text, **options):
        part = words(text[a:b])
        assert len(part) == n
        assert part[:shared] == out[len(out) - shared :]
        out += part[shared:]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "clause,", "\n\n", "x\n", " ", "　a", "ሰላም።", " "]), max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_pieces_cover_the_text_once(parts, most, overlap):
    text = " ".join(parts)
    assert rebuilt(text, most=most, overlap=overlap) == words(text)
    pieces = split_text(text, most=most, overlap=overlap)
    assert all(n <= most for _, _, n, _ in pieces)
    assert [s for *_, s in pieces[1:]] == [overlap] * max(len(pieces) - 1, 0)


def test_cuts_at_sentence_ends():
    rng = random.Random(2)
    text = " ".join(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(5, 20))) + "." for _ in range(200))
    pieces = split_text(text)
    assert len(pieces) > 3 and all(text[b - 1] == "." for _, b, _, _ in pieces)


def test_an_edit_moves_only_cuts_near_it():
    rng = random.Random(7)
    body = [" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randint(6, 18))) + "." for _ in range(900)]
    before = " ".join(body)
    after = " ".join([*body[:3], "One more sentence was put in here today.", *body[3:]])
    ends = [{text[b - 40 : b] for _, b, _, _ in split_text(text)} for text in (before, after)]
    assert len(ends[0] & ends[1]) >= 0.7 * len(ends[0])


def test_one_endless_sentence_and_one_endless_word():
    assert [n for _, _, n, _ in split_text("w " * 1_000)][0] <= 500
    assert len(split_text("x" * 2_000_000)) == 1


def test_fresh_indexes(spark):
    long = " ".join(f"word{i}." for i in range(1_200))
    rows = [("a", "f", 0, "short", 1, "text", 9), ("b", "f", 1, long, 7, "text", 9), ("c", "f", 1, "tie", None, "text", 9), ("d", "f", None, None, None, None, 9), ("e", None, 5, "", 2, "text", 9), ("g", "h", 3, long, 3, "text", 9)]
    got = split_chunks(spark.createDataFrame(rows, CHUNKS)).orderBy("filename", "chunk_index").collect()
    f = [r for r in got if r.filename == "f"]
    assert [r.chunk_index for r in f] == list(range(len(f)))
    assert [r.chunk_id for r in f][:2] == ["d", "a"] and f[-1].chunk_id == "c"
    assert all(r.page_number == 7 for r in f if r.chunk_id == "b")
    assert sum(r.chunk_id == "b" for r in f) == sum(r.chunk_id == "g" for r in got) >= 3
    assert [r.chunk_index for r in got if r.filename is None] == [0]


def test_found_and_empty(spark):
    rows = [("a", "f", 0, "w " * 500, 1, "text", 1), ("b", "f", 0, "w " * 501, 1, "text", 1), ("c", "f", 0, None, 1, "text", 1)]
    assert {r.chunk_id for r in oversized_pieces(spark.createDataFrame(rows, CHUNKS)).collect()} == {"b"}
    assert split_chunks(spark.createDataFrame([], CHUNKS)).count() == 0
    with pytest.raises(ValueError):
        oversized_pieces(spark.createDataFrame([], CHUNKS), most=10, overlap=10)
