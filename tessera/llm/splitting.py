"""Problem 3: cut oversized texts at natural boundaries, with overlap.

Content-defined chunking over words. A landmark is a word position whose rolling hash over the last
few words is 0 modulo a constant; from the first landmark after the minimum size the cut snaps to the
nearest natural boundary between minimum and maximum. As landmarks depend on a few words only, an
edit moves the cuts near it and leaves the pieces further on as they were.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.ranking import running_offset
from tessera.session import written

# The characters with the property White_Space of the Unicode standard.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{WHITE_SPACE}]+")
#: How strongly the text pauses after a word: paragraph, line, sentence, clause.
_PARAGRAPH, _LINE, _SENTENCE, _CLAUSE = 4, 3, 2, 1
_NEW_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_SENTENCE_END = re.compile("[.!?…。！？።፧፨][\"'»”’)\\]]*$")
_CLAUSE_END = re.compile("[,;:–—፡፣፤፥፦、，][\"'»”’)\\]]*$")
_ROLL = 8
_DIVISOR = 64


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    h = 0xCBF29CE484222325
    for byte in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _landmarks(words: list[str]) -> np.ndarray:
    """True at each word that ends a window whose polynomial rolling hash is 0 modulo the divisor."""
    h = np.array([_word_hash(w) for w in words], dtype=np.uint64)
    mixed = np.zeros(len(h), dtype=np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(1)
        for back in range(_ROLL):
            mixed[back:] += h[: len(h) - back] * factor
            factor *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed % np.uint64(_DIVISOR) == 0


def _pauses(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    level = np.zeros(len(spans), dtype=np.int8)
    for i in range(len(spans) - 1):
        gap = text[spans[i][1] : spans[i + 1][0]]
        breaks = 0 if gap == " " else len(_NEW_LINES.findall(gap))
        if breaks:
            level[i] = _PARAGRAPH if breaks > 1 or "\u2029" in gap or "\x0c" in gap else _LINE
        else:
            tail = text[max(spans[i][0], spans[i][1] - 4) : spans[i][1]]
            level[i] = _SENTENCE if _SENTENCE_END.search(tail) else _CLAUSE if _CLAUSE_END.search(tail) else 0
    return level


def cut_points(words: list[str], level: np.ndarray, most: int, least: int, overlap: int) -> list[int]:
    """Ends (exclusive word positions) of the pieces' new words."""
    n, ends, start = len(words), [], 0
    marks = np.nonzero(_landmarks(words))[0] + 1 if n > most else np.zeros(0, dtype=int)
    strong = np.nonzero(level >= _SENTENCE)[0] + 1
    weak = np.nonzero(level == _CLAUSE)[0] + 1
    while True:
        room = most - (overlap if ends else 0)
        if n - start <= room:
            ends.append(n)
            return ends
        lo, hi = start + least, start + room
        i = np.searchsorted(marks, lo)
        target = int(marks[i]) if i < len(marks) and marks[i] <= hi else hi
        cut = None
        for places in (strong, weak):
            a, b = np.searchsorted(places, lo), np.searchsorted(places, hi, side="right")
            if a < b:
                near = places[a:b]
                cut = int(near[np.argmin(np.abs(near - target))])
                break
        ends.append(cut if cut is not None else target)
        start = ends[-1]


def split_text(text: str, most: int = 500, overlap: int = 50, least: int | None = None) -> list[tuple[int, int, int, int]]:
    """Pieces of ``text`` as (first character, end character, words, words shared with the piece before).

    A text of at most ``most`` words is one piece, an empty or blank one none. Each later piece starts
    with the last ``overlap`` words of the one before.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return []
    if len(spans) <= most:
        return [(spans[0][0], spans[-1][1], len(spans), 0)]
    least = least if least is not None else max(1, (most - overlap) // 2)
    words = [text[a:b] for a, b in spans]
    ends = cut_points(words, _pauses(text, spans), most, least, overlap)
    out, begin = [], 0
    for i, end in enumerate(ends):
        first = max(begin - overlap, 0) if i else 0
        out.append((spans[first][0], spans[end - 1][1], end - first, begin - first))
        begin = end
    return out


def _split(most: int, overlap: int, least: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list, list, list] = ([], [], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = split_text(text, most, overlap, least)
                for no, (a, b, words, shared) in enumerate(pieces, 1):
                    for c, x in zip(rows, (key, no, len(pieces), text[a:b], words, shared)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.int32())],
                names=["chunk_id", "piece_no", "pieces", "content", "words", "shared_words"],
            )

    return run


def oversized_pieces(chunks: DataFrame, most: int = 500, overlap: int = 50, least: int | None = None) -> DataFrame:
    """``(chunk_id, piece_no, pieces, content, words, shared_words)`` of chunks of more than ``most`` words.

    Null, empty and blank contents are not oversized. Only texts long enough to hold so many words
    leave the JVM.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be smaller than the size limit")
    if least is not None and not 1 <= least <= most - overlap:
        raise ValueError("the minimum must leave room for the overlap")
    long = chunks.filter(F.length("content") > 2 * most).select(F.col("chunk_id").cast("string").alias("chunk_id"), "content")
    return long.mapInArrow(_split(most, overlap, least), "chunk_id string, piece_no int, pieces int, content string, words int, shared_words int").filter("pieces > 1")


def split_chunks(chunks: DataFrame, most: int = 500, overlap: int = 50, least: int | None = None) -> DataFrame:
    """Every chunk, oversized ones as pieces, with a fresh ``chunk_index`` from 0 in each file.

    Columns ``filename, chunk_index, chunk_id, piece_no, page_number, source_type, content, shared_words``. A file's
    order is by old index and then by id (nulls first); null contents keep their row. Rows without a file
    name are numbered together.
    """
    base = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "filename", F.col("chunk_index").alias("old_index"), "page_number", "source_type", F.col("content").alias("whole"))
    pieces = written(oversized_pieces(chunks, most, overlap, least), "pieces")
    counts = pieces.filter("piece_no = 1").select("chunk_id", F.col("pieces").alias("n"))
    slim = base.select("chunk_id", "filename", "old_index").join(counts, "chunk_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    placed = running_offset(slim, ["filename"], ["old_index", "chunk_id"], F.col("n"), "first_index").select("chunk_id", "first_index")
    cut = pieces.select("chunk_id", "piece_no", "content", "shared_words")
    return (
        base.join(placed, "chunk_id")
        .join(cut, "chunk_id", "left")
        .select(
            "filename",
            (F.col("first_index") + F.coalesce("piece_no", F.lit(1)) - 1).cast("int").alias("chunk_index"),
            "chunk_id",
            F.coalesce("piece_no", F.lit(1)).alias("piece_no"),
            "page_number",
            "source_type",
            F.coalesce("content", "whole").alias("content"),
            F.coalesce("shared_words", F.lit(0)).alias("shared_words"),
        )
    )
