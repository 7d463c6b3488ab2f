"""Problem 9: evaluation texts that leak into training texts.

Spaced-seed hashing over word positions. Each fixed mask selects some positions of a window of at
most 13 words; words at the other positions may differ. Seeds of the items fill a Bloom filter of
fixed size; one pass over the corpus keeps the stretches of documents whose seeds pass it, the rest
of the text leaves no trace. The stretches' seeds are joined with the items' seeds, and each hit's
diagonal is compared word by word: that gives the longest run of equal words and the overlap that
tolerates substitutions. Runs of equal words need the heavy masks only; overlaps with substitutions are
sought with lighter ones that no overlap within the limits can miss. Words put in or left out end an overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import written

#: Masks over word positions; every one fits into a run of 13 words. Fixed values.
MASKS = ("1101100110101", "1110010100111", "1011101000111")
#: Masks for overlaps with substitutions. Of at least 13 words of which 0.8 are equal, four in a row are equal, or the
#: words are 15 in four runs of three, which the second mask meets; so every such overlap has a seed.
TOLERANT_MASKS = ("1111", "11101110111")
BLOOM_BITS = 1 << 26
#: A table of at most this many slim rows may be broadcast.
BROADCAST_ROWS = 200_000
#: Words of all items, of 8 bytes each, that may be sent to all tasks.
BROADCAST_WORDS = 2_000_000
_OVERLAP = "doc_id long, item_id long, start long, longest_run int, equal_words int, overlap_words int"
#: Words beyond the outermost seeds of a stretch that a run of equal words without a seed may have.
_MARGIN = 24
_SLICE = 1 << 19
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Word hashes, computed once per worker and forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


_HASH = _Hashes()


def words_of(text: str) -> list[str]:
    """Runs of letters and digits; case, accents, marks and invisible characters do not count."""
    if text.isascii():
        return _WORD.findall(text.lower())
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    kept = "".join([c for c in folded if c.isascii() or unicodedata.category(c) not in ("Mn", "Me", "Cf")])
    return _WORD.findall(kept)


def word_hashes(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))


def seeds(hashes: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask the seed of the window that starts at each word."""
    out = []
    with np.errstate(over="ignore"):
        for number, mask in enumerate(masks):
            n = len(hashes) - len(mask) + 1
            if n <= 0:
                out.append(np.zeros(0, dtype=np.uint64))
                continue
            total = np.full(n, np.uint64(0x9E3779B97F4A7C15) * np.uint64(number + 1), dtype=np.uint64)
            for i, c in enumerate(mask):
                if c == "1":
                    total = (total ^ hashes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
                    total ^= total >> np.uint64(32)
            out.append(total)
    return out


def _bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BLOOM_BITS - 1)
    return (values & mask).astype(np.int64), ((values >> np.uint64(32)) & mask).astype(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        hashed = [word_hashes(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([h.view(np.int64) for h in hashed], pa.list_(pa.int64()))], names=["item_id", "item_words"])


def _item_seeds(masks: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.asarray(words.values).view(np.uint64)
                for s in seeds(h, masks):
                    if len(s):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(s.view(np.int64)), pa.array(np.full(len(s), item, dtype=np.int64)), pa.array(np.arange(len(s), dtype=np.int32))], names=["seed", "item_id", "item_pos"]
                        )

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's slices that hold a bit of this partition's seeds."""
    bits = np.zeros(BLOOM_BITS, dtype=bool)
    for batch in batches:
        for at in _bits(np.asarray(batch.column(0)).view(np.uint64)):
            bits[at] = True
    for number, part in enumerate(bits.reshape(-1, _SLICE)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["slice", "bits"])


def bloom_filter(spark: SparkSession, item_seeds: DataFrame):
    """Broadcast filter of ``BLOOM_BITS`` bits (8 MB, whatever the number of items)."""

    def join_slices(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.frombuffer(rows.bits.iloc[0], dtype=np.uint8)
        for more in rows.bits.iloc[1:]:
            whole = whole | np.frombuffer(more, dtype=np.uint8)
        return pd.DataFrame({"slice": [rows.slice.iloc[0]], "bits": [whole.tobytes()]})

    slices = item_seeds.select("seed").mapInArrow(_bitmap, "slice int, bits binary").groupBy("slice").applyInPandas(join_slices, "slice int, bits binary")
    packed = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for row in slices.collect():  # at most BLOOM_BITS bits in all
        packed[row.slice * _SLICE // 8 : (row.slice + 1) * _SLICE // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return spark.sparkContext.broadcast(packed)


def _stretches(filter_bits, masks: tuple[str, ...], margin: int) -> Callable:
    """(doc_id, first word, word hashes, hit positions, hit seeds) of the stretches of a document around passing seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = filter_bits.value
        longest = max(map(len, masks))

        def passes(values: np.ndarray) -> np.ndarray:
            first, second = _bits(values)
            at = np.nonzero(packed[first >> 3] & (np.uint8(128) >> (first & 7).astype(np.uint8)))[0]
            s = second[at]
            return at[(packed[s >> 3] & (np.uint8(128) >> (s & 7).astype(np.uint8))) > 0]

        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = word_hashes(text)
                places, values = [], []
                for s in seeds(hashes, masks):
                    hit = passes(s)
                    places.append(hit)
                    values.append(s[hit])
                place, value = np.concatenate(places), np.concatenate(values)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, value = place[order], value[order]
                cuts = np.nonzero(np.diff(place) > 2 * margin)[0] + 1
                for p, v in zip(np.split(place, cuts), np.split(value, cuts)):
                    lo, hi = max(int(p[0]) - margin, 0), int(p[-1]) + longest + margin
                    for c, x in zip(out, (doc, lo, hashes[lo:hi].view(np.int64), (p - lo).astype(np.int32), v.view(np.int64))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.int64()))],
                names=["doc_id", "start", "words", "places", "seeds"],
            )

    return run


def compare_diagonal(a: np.ndarray, b: np.ndarray, shift: int, anchor: int, drop: int = 6) -> tuple[int, int, int, int]:
    """(longest equal run, equal words, words overlapped, first word) of ``a[i]`` against ``b[i - shift]`` around ``anchor``.

    The overlap grows from the anchor while substitutions do not outweigh matches by ``drop``.
    """
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    equal = a[lo:hi] == b[lo - shift : hi - shift]
    edges = np.diff(np.r_[0, equal.astype(np.int8), 0])
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    longest = int((ends - starts).max()) if len(starts) else 0
    at = min(max(anchor - lo, 0), max(len(equal) - 1, 0))
    score = np.where(equal, 1, -2)

    def grow(step: np.ndarray) -> int:
        if not len(step):
            return 0
        total = np.cumsum(step)
        best = np.maximum.accumulate(np.r_[0, total])[1:]
        stop = np.nonzero(best - total > drop)[0]
        total = total[: stop[0]] if len(stop) else total
        return int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0

    right, left = grow(score[at:]), grow(score[:at][::-1])
    return longest, int(equal[at - left : at + right].sum()), left + right, lo + at - left


def best_overlap(a: np.ndarray, b: np.ndarray, shift: int, anchor: int, least_words: int = 13, similarity: float = 0.8) -> tuple[int, int, int, int]:
    """Like :func:`compare_diagonal`, but the best of all overlaps of the diagonal that meet both limits; zeros if none does.

    Overlaps grow from each run of equal words. Where none of them meets the limits, the stretch with the most
    equal words that does is taken.
    """
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    equal = a[lo:hi] == b[lo - shift : hi - shift]
    if len(equal) < least_words or np.count_nonzero(equal) < similarity * least_words - 1e-9:
        return 0, 0, 0, lo
    count = np.r_[0, np.cumsum(equal)]
    level = count - similarity * np.arange(len(count))
    if (level[least_words:] - np.minimum.accumulate(level)[: len(level) - least_words]).max() < -1e-9:
        return 0, 0, 0, lo
    first = compare_diagonal(a, b, shift, anchor)
    edges = np.diff(np.r_[0, equal.astype(np.int8), 0])
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    meets = lambda m: m[2] >= least_words and m[1] >= similarity * m[2] - 1e-9
    found, upto = [first] if meets(first) else [], -1
    for start in starts:
        if start >= upto:
            grown = compare_diagonal(a, b, shift, lo + int(start))
            upto = grown[3] - lo + grown[2]
            if meets(grown):
                found.append(grown)
    if not found:
        for start in starts:
            words = ends - start
            same = count[ends] - count[start]
            ok = np.nonzero((words >= least_words) & (same >= similarity * words - 1e-9))[0]
            if len(ok):
                at = ok[np.argmax(same[ok])]
                found.append((first[0], int(same[at]), int(words[at]), lo + int(start)))
    # a stretch that meets the limits only with unequal words at its ends has no such run; it is taken as it is
    if not found:
        reach = np.nonzero(level[least_words:] - np.minimum.accumulate(level)[: len(level) - least_words] >= -1e-9)[0][0] + least_words
        start = int(np.argmin(level[: reach - least_words + 1]))
        found.append((first[0], int(count[reach] - count[start]), int(reach - start), lo + start))
    return max(found, key=lambda m: (m[1], m[2], -m[3]))


def leaked_items(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, measure: Callable = compare_diagonal) -> DataFrame:
    """``(doc_id, item_id, start, longest_run, equal_words, overlap_words)``: each overlap of a document with an item.

    ``longest_run`` counts consecutive equal words, ``overlap_words`` the aligned stretch with
    substitutions inside. Null texts, and texts shorter than a mask, meet nothing; repeated rows count
    once; other columns of either table are not read.
    """
    spark = documents.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    known = written(texts.mapInArrow(_item_rows, "item_id long, item_words array<long>").distinct(), "items")
    table = written(known.mapInArrow(_item_seeds(masks), "seed long, item_id long, item_pos int").distinct(), "seeds")
    bits = bloom_filter(spark, table)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null and doc_id is not null")
    # an overlap with substitutions may go on without a seed, but not beyond the ends of its item
    margin = _MARGIN if measure is compare_diagonal else max(_MARGIN, known.agg(F.max(F.size("item_words"))).first()[0] or 0)
    found = docs.mapInArrow(_stretches(bits, masks, margin), "doc_id long, start long, words array<long>, places array<int>, seeds array<long>")
    found = written(found.withColumn("stretch", F.xxhash64("doc_id", "start", "words")), "stretches")
    hits = found.select("doc_id", "stretch", F.explode(F.arrays_zip("places", "seeds")).alias("hit")).select("doc_id", "stretch", F.col("hit.places").alias("place"), F.col("hit.seeds").alias("seed"))
    right = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    lines = hits.join(right, "seed").groupBy("doc_id", "stretch", "item_id", (F.col("place") - F.col("item_pos")).alias("shift")).agg(F.min("place").alias("anchor"))
    stretches = found.select("doc_id", "stretch", "start", "words").dropDuplicates(["doc_id", "stretch"])
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("item_words")), F.lit(0)).alias("words")).first()
    if size.words <= BROADCAST_WORDS and size.n <= BROADCAST_ROWS:
        # each stretch goes to Python once, with all its diagonals; the items' words are there
        table_of = spark.sparkContext.broadcast({r.item_id: np.array(r.item_words, dtype=np.int64) for r in known.collect()})
        diagonals = lines.groupBy("doc_id", "stretch").agg(F.collect_list("item_id").alias("items"), F.collect_list("shift").alias("shifts"), F.collect_list("anchor").alias("anchors"))
        aligned = stretches.join(diagonals, ["doc_id", "stretch"]).select("doc_id", "start", "words", "items", "shifts", "anchors")
        return aligned.mapInArrow(_measured(table_of, measure), _OVERLAP).distinct()
    aligned = lines.join(stretches, ["doc_id", "stretch"]).join(known, "item_id").select("doc_id", "start", "words", F.array("item_id").alias("items"), F.array("shift").alias("shifts"), F.array("anchor").alias("anchors"), "item_words")
    return aligned.mapInArrow(_measured(None, measure), _OVERLAP).distinct()


def _measured(table_of, measure: Callable) -> Callable:
    """Each diagonal of each stretch (doc_id, start, words, items, shifts, anchors, and item_words without a table) compared word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(6))
            docs, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (doc, start) in enumerate(zip(docs, starts)):
                a = np.asarray(batch.column(2)[row].values)
                items, shifts, anchors = (batch.column(c)[row].as_py() for c in (3, 4, 5))
                for item, shift, anchor in zip(items, shifts, anchors):
                    b = np.asarray(batch.column(6)[row].values) if table_of is None else table_of.value[item]
                    run_, equal, overlap, first = measure(a, b, shift, anchor)
                    if overlap or run_:
                        for c, x in zip(out, (doc, item, start + first, run_, equal, overlap)):
                            c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[c.split()[0] for c in _OVERLAP.split(", ")])

    return run


def leaks(documents: DataFrame, items: DataFrame, least_run: int = 13) -> DataFrame:
    """``(doc_id, item_id)`` of documents with at least ``least_run`` consecutive words of the item."""
    if least_run < max(map(len, MASKS)):
        raise ValueError("a run must be at least as long as the masks")
    return leaked_items(documents, items).filter(F.col("longest_run") >= least_run).select("doc_id", "item_id").distinct()


def tolerant_leaks(documents: DataFrame, items: DataFrame, least_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """Overlaps of at least ``least_words`` words of which the share ``similarity`` is equal, the best per document and item."""
    if least_words < 13 or similarity < 0.8:
        raise ValueError("the masks meet every overlap of at least 13 words with a similarity of at least 0.8")
    measured = leaked_items(documents, items, TOLERANT_MASKS, partial(best_overlap, least_words=least_words, similarity=similarity))
    near = measured.filter((F.col("overlap_words") >= least_words) & (F.col("equal_words") >= similarity * F.col("overlap_words") - 1e-9))
    best = F.max(F.struct("equal_words", "overlap_words", "longest_run", (-F.col("start")).alias("s"))).alias("b")
    return near.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.s")).alias("start"), "b.longest_run", "b.equal_words", "b.overlap_words")
