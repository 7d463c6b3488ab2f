"""Problem 8: fill containers of fixed capacity with texts, sized in tokens.

Shortest-pack-first over the histogram of lengths (Krell et al., 2021): lengths are placed longest
first, always into the open pattern with the most room; only the histogram, of at most ``capacity``
bins, reaches the driver. The patterns are joined back to the texts by the rank of a text among those
of its length. Ranks are counted in hashed shares of each length, so a length that a third of all
texts have is spread over many tasks.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.session import parallelism, written

#: A vocabulary file of ranks; a parameter everywhere.
TOKENIZER = os.environ.get("TESSERA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _sizes(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, tokens)``; null texts are left out."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").mapInArrow(_sizes(tokenizer), "doc_id long, tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one container, longest first) and how many containers follow each."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    widest: list[int] = []  # rooms as a heap of negatives; stale entries are skipped

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        bucket = room.setdefault(space, {})
        if not bucket:
            heapq.heappush(widest, -space)
        bucket[pattern] = bucket.get(pattern, 0) + count

    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        left = histogram[length]
        while left:
            while widest and not room.get(-widest[0]):
                heapq.heappop(widest)
            space = -widest[0] if widest else 0
            if space < length:
                # fresh containers take as many of this length as fit
                each = min(capacity // length, left)
                count = left // each
                put(capacity - each * length, (length,) * each, count)
                left -= each * count
                continue
            pattern, count = next(iter(room[space].items()))
            each = min(space // length, left)
            used = min(count, left // each)
            if used == count:
                del room[space][pattern]
            else:
                room[space][pattern] = count - used
            put(space - each * length, pattern + (length,) * each, used)
            left -= each * used
    return [(p, c) for space in sorted(room) for p, c in sorted(room[space].items(), reverse=True) if c]


def _runs(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, first container and items per container of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for pattern, count in patterns:
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            at = seen.get(length, 0)
            runs.setdefault(length, []).append((at, first, each))
            seen[length] = at + each * count
        first += count
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack_texts(documents: DataFrame, capacity: int = 2_048, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, piece_no, token_start, tokens, container_id)``: the container of every text.

    A text of more than ``capacity`` tokens is split into full pieces and a rest; no other text is.
    Null texts and texts without a token take no room and do not come out. Rows that repeat an id are
    packed each for itself. Containers are numbered from 0 without gaps.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = documents.sparkSession
    sized = written(token_sizes(documents, tokenizer).filter("tokens > 0"), "sizes")
    whole = F.col("tokens").cast("long")
    last = F.floor((whole - 1) / capacity).cast("int")
    pieces = sized.select("doc_id", whole.alias("all"), F.explode(F.sequence(F.lit(0), last)).alias("no")).select(
        "doc_id",
        (F.col("no") + 1).cast("int").alias("piece_no"),
        (F.col("no").cast("long") * capacity).alias("token_start"),
        F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("no").cast("long") * capacity).cast("int").alias("tokens"),
    )
    histogram = {r.tokens: r["count"] for r in pieces.groupBy("tokens").count().collect()}  # at most `capacity` rows
    if not histogram:
        return spark.createDataFrame([], "doc_id long, piece_no int, token_start long, tokens int, container_id long")
    runs = _runs(pack_histogram(histogram, capacity))

    shares = max(parallelism(spark), sum(histogram.values()) // 500_000)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shares)).cast("int"))
    in_share = Window.partitionBy("tokens", "share").orderBy("doc_id", "piece_no")
    before = Window.partitionBy("tokens").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("tokens", "share").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("tokens", "share", "before")
    ranked = dealt.withColumn("n", F.row_number().over(in_share) - 1).join(starts, ["tokens", "share"]).withColumn("rank", F.col("n") + F.col("before"))

    @F.pandas_udf(T.LongType())
    def container(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(tokens), dtype=np.int64)
        size, place = tokens.to_numpy(), rank.to_numpy()
        for n in np.unique(size):
            at = np.nonzero(size == n)[0]
            first, base, each = runs[int(n)]
            run = np.searchsorted(first, place[at], side="right") - 1
            out[at] = base[run] + (place[at] - first[run]) // each[run]
        return pd.Series(out)

    return ranked.select("doc_id", "piece_no", "token_start", "tokens", container("tokens", "rank").alias("container_id"))


def fill_report(packed: DataFrame, capacity: int = 2_048) -> DataFrame:
    """One row: containers, tokens, unused tokens and the filled share (null without containers)."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
    return total.withColumn("unused", F.col("containers") * capacity - F.col("tokens")).withColumn("filled", F.try_divide(F.col("tokens").cast("double"), F.col("containers") * capacity))
