"""Problem 7: the most similar vectors of every vector.

Multiprobe p-stable hashing. A table hashes a vector's projections on ``K`` Gaussian directions, cut
into cells of one width; besides its own cell every vector visits the cells that its nearest
neighbours most probably fell into, in the order of the expected squared distance to the crossed
cell borders. Inside a cell a 192-bit sign sketch discards pairs that are certainly too far apart
before a pair of 8-byte handles is emitted; the pairs of all tables are merged and ranked again by
the exact cosine.

Scale: what is shuffled per vector is a 40-byte row for each table and probe. Copies of one direction are
put into one class first, so a group of copies never meets itself; only the class's smallest members
can be anybody's nearest. Cells with more than ``hot_cell`` vectors are cut into blocks and searched
exactly, block by block, keeping ``k`` partners per vector and block; so are cells with many visitors,
who are cut into slices. ``K`` grows with the logarithm of the row count, and the number of tables
follows from the recall wanted at the least similarity, without a bound: 5 at 10^5 vectors, 44 at 10^8,
104 at 10^9.

Hashing finds only what is near. Where every vector must get its ``k`` nearest, however far they are,
:func:`nearest_vectors` compares all of them, tile by tile: exact, in time quadratic in the rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import parallelism, written

WIDTH = 1.5
PROBES = 4
CELL = 200
HOT_CELL = 2_048
#: A cell is hot, too, with more than this many times ``hot_cell`` visitors.
VISITORS = 16
EDGE_RECALL = 0.9
BITS = 192
#: A table of at most this many rows (of a few dozen bytes) may be broadcast.
BROADCAST_ROWS = 100_000
#: Vectors of one side of a tile of the exact search.
TILE = 65_536
_PAIRS_AT_ONCE = 2_000_000


def _collision(distance: float, width: float) -> float:
    """Probability that two points ``distance`` apart share a cell in one projection."""
    r = width / distance
    cdf = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def probe_sets(k: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks of cell borders to cross, likeliest first; rank 0 is the nearest of 2k borders."""
    cost = []
    for j in range(1, 2 * k + 1):
        if j <= k:
            cost.append(j * (j + 1) / (4 * (k + 1) * (k + 2)))
        else:
            i = 2 * k + 1 - j
            cost.append(1 - i / (k + 1) + i * (i + 1) / (4 * (k + 1) * (k + 2)))
    heap: list[tuple[float, tuple[int, ...]]] = [(cost[0], (0,))]
    out: list[tuple[int, ...]] = []
    while heap and len(out) < probes:
        total, ranks = heapq.heappop(heap)
        if all(2 * k - 1 - r not in ranks for r in ranks):  # not both borders of one projection
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return out


def _perturbations(offset: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Cell shifts (row, probe, projection) for offsets within the cell, in cell widths."""
    n, k = offset.shape
    order = np.argsort(np.concatenate([offset, 1 - offset], axis=1), axis=1)
    shift = np.zeros((n, len(sets), k), dtype=np.int64)
    rows = np.arange(n)
    for t, ranks in enumerate(sets):
        for r in ranks:
            border = order[:, r]
            shift[rows, t, border % k] += np.where(border < k, -1, 1)
    return shift


def tables_for(k: int, distance: float, recall: float, width: float, probes: int) -> int:
    """Tables so that a pair ``distance`` apart meets with the probability ``recall``, by simulation of the hash."""
    rng = np.random.default_rng(5)
    n = 4_000
    x = rng.random((n, k))
    y = x + rng.normal(0, distance / width, (n, k))
    apart = np.floor(y).astype(np.int64)
    sets = probe_sets(k, probes)
    met = (apart == 0).all(1)
    met |= (_perturbations(x, sets) == apart[:, None]).all(2).any(1)
    met |= (_perturbations(y % 1, sets) == -apart[:, None]).all(2).any(1)
    rate = min(max(float(met.mean()), 1e-3), 0.999)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - rate)))


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length among the usable vectors of column ``at``."""
    column = batch.column(at)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for length in np.unique(lengths[lengths > 0]):
        rows = np.nonzero(lengths == length)[0]
        flat = column.take(pa.array(rows)).flatten()
        matrix = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64).reshape(len(rows), int(length))
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((matrix * matrix).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            yield rows[good], matrix[good]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, id, two hashes of the direction) of each usable vector."""
    for batch in batches:
        for rows, m in _by_length(batch, 2):
            unit = np.round(m / np.sqrt((m * m).sum(1))[:, None], 12) + 0.0
            data = [r.tobytes() for r in unit]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(np.array([xxhash.xxh64_intdigest(b, 1) for b in data], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([xxhash.xxh64_intdigest(b, 2) for b in data], dtype=np.uint64).view(np.int64)),
                ],
                names=["vec_set", "id", "c1", "c2"],
            )


def _hash_rows(k: dict[str, int], tables: dict[str, int], width: float, probes: int, seed: int, slim: bool = False) -> Callable:
    """Rows (key, handle, sketch) of a vector's cells; the handle's lowest bit tells a visited cell from the vector's own.

    ``slim`` gives only (key, visit), to count the cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[tuple[str, int], tuple] = {}
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), dtype=object)
            handle = np.asarray(batch.column(1)).view(np.int64)
            for rows, m in _by_length(batch, 2):
                m = m / np.sqrt((m * m).sum(1))[:, None]
                for name in set(names[rows]):
                    own = names[rows] == name
                    v, h, dim = m[own], handle[rows][own], m.shape[1]
                    if (name, dim) not in spaces:
                        rng = np.random.default_rng([seed, dim])
                        kk, tt = k[name], tables[name]
                        spaces[name, dim] = (
                            rng.normal(size=(dim, tt * kk)),
                            rng.random(tt * kk),
                            rng.integers(1, 1 << 62, size=(tt, kk), dtype=np.int64) | 1,
                            np.array([xxhash.xxh64_intdigest(f"{name}/{dim}/{t}") for t in range(tt)], dtype=np.uint64).view(np.int64),
                            rng.normal(size=(dim, BITS)),
                            probe_sets(kk, probes),
                        )
                    directions, offset, mix, salt, planes, sets = spaces[name, dim]
                    tt, kk = mix.shape
                    cell = v @ directions / width + offset
                    low = np.floor(cell)
                    inside, base = (cell - low).reshape(-1, kk), low.astype(np.int64).reshape(-1, kk)
                    t_of = np.tile(np.arange(tt), len(v))
                    with np.errstate(over="ignore"):
                        key = (base * mix[t_of]).sum(1) + salt[t_of]
                        key ^= (key >> 29) ^ (key << 21)
                        shifted = (_perturbations(inside, sets) * mix[t_of][:, None]).sum(2) + ((base * mix[t_of]).sum(1) + salt[t_of])[:, None]
                        shifted ^= (shifted >> 29) ^ (shifted << 21)
                    keys = np.concatenate([key, shifted.reshape(-1)])
                    visit = np.concatenate([np.zeros(len(key), np.int64), np.ones(shifted.size, np.int64)])
                    if slim:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(visit)], names=["key", "visit"])
                        continue
                    bits = np.packbits(v @ planes > 0, axis=1).view(np.int64)
                    who = np.repeat(np.arange(len(v)), tt)
                    whose = np.concatenate([who, np.repeat(who, len(sets))])
                    for at in range(0, len(keys), 100_000):
                        s = slice(at, at + 100_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[s]), pa.array(h[whose[s]] | visit[s]), *(pa.array(bits[whose[s], i]) for i in range(3))],
                            names=["key", "handle", "s1", "s2", "s3"],
                        )

    return run


def _cell_pairs(most: int) -> Callable:
    """Pairs of handles in one cell whose sketches differ in at most ``most`` bits, one of them at home there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, handle, s1, s2, s3 = (np.concatenate([np.asarray(b.column(i)) for b in parts]) for i in range(5))
        del parts
        visit = handle & 1
        order = np.lexsort((visit, key))
        key, handle, visit = key[order], handle[order] & ~np.int64(1), visit[order]
        sketch = [s[order].view(np.uint64) for s in (s1, s2, s3)]
        del s1, s2, s3
        first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        ends = np.r_[first[1:], len(key)]
        homes = np.add.reduceat(1 - visit, first)
        # the i-th home row of a cell meets every later row of its cell
        end_of = np.repeat(ends, homes)
        start_of = np.repeat(first, homes)
        home = start_of + np.arange(len(start_of)) - np.repeat(np.cumsum(homes) - homes, homes)
        many = end_of - home - 1
        upto = np.cumsum(many)
        found: list[np.ndarray] = []
        at = 0
        while at < len(home):
            base = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, base + _PAIRS_AT_ONCE, side="right")))
            n = many[at:to]
            i = np.repeat(home[at:to], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
            near = np.bitwise_count(sketch[0][i] ^ sketch[0][j])
            for s in sketch[1:]:
                near = near + np.bitwise_count(s[i] ^ s[j])
            ok = (near <= most) & (handle[i] != handle[j])
            a, b = handle[i[ok]], handle[j[ok]]
            if len(a):
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
            if sum(map(len, found)) > 500_000:
                yield from _pair_batches(np.unique(np.concatenate(found), axis=0))
                found = []
            at = to
        if found:
            yield from _pair_batches(np.unique(np.concatenate(found), axis=0))

    return run


def _pair_batches(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(pairs), 100_000):
        p = pairs[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["ha", "hb"])


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, id_a, id_b, similarity) from rows (set_a, id_a, vector_a, set_b, id_b, vector_b)."""
    for batch in batches:
        same = np.asarray(pc.equal(batch.column(0), batch.column(3)))
        la, lb = (np.asarray(batch.column(c).value_lengths()) for c in (2, 5))
        same &= la == lb
        for length in np.unique(la[same]):
            rows = pa.array(np.nonzero(same & (la == length))[0])
            a, b = (np.asarray(batch.column(c).take(rows).flatten().cast(pa.float64())).reshape(len(rows), int(length)) for c in (2, 5))
            cos = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(4).take(rows), pa.array(np.round(cos, 6))],
                names=["vec_set", "id_a", "id_b", "similarity"],
            )


def _block_search(k: int) -> Callable:
    """The ``k`` best partners of each row within one block; rows come sorted by key, block and role, the block's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, block = None, [], [], None
        for batch in batches:
            key = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            edges = np.nonzero(np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])])[0]
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if (key[0][lo], key[1][lo]) != now:
                    now, ids, vectors, block = (key[0][lo], key[1][lo]), [], [], None
                m = np.asarray(part.column(5).flatten().cast(pa.float64())).reshape(part.num_rows, -1)
                m = m / np.sqrt((m * m).sum(1))[:, None]
                names = part.column(4).to_pylist()
                if key[2][lo] == 0:
                    ids += names
                    vectors.append(m)
                    continue
                if not ids:
                    continue
                if block is None:
                    order = sorted(range(len(ids)), key=ids.__getitem__)
                    ids, block = [ids[i] for i in order], np.concatenate(vectors)[order]
                out: tuple[list, list, list, list] = ([], [], [], [])
                for at in range(0, len(names), 512):
                    cos = np.round(m[at : at + 512] @ block.T, 6)
                    best = np.argsort(-cos, axis=1, kind="stable")[:, : k + 1]
                    for r, row in enumerate(best):
                        for c in row:
                            if ids[c] != names[at + r]:
                                for o, x in zip(out, (part.column(3)[at + r].as_py(), names[at + r], ids[c], float(cos[r, c]))):
                                    o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())], names=["vec_set", "id_a", "id_b", "similarity"])

    return run


def similar_vectors(
    vectors: DataFrame,
    k: int = 5,
    least: float = 0.85,
    recall: float = EDGE_RECALL,
    width: float = WIDTH,
    probes: int = PROBES,
    cell: int = CELL,
    hot_cell: int = HOT_CELL,
    seed: int = 11,
) -> DataFrame:
    """``(vec_set, id, other_id, similarity, rank)``: for every vector its ``k`` most similar others of the same set.

    ``vectors`` has ``vec_set`` string, ``id`` string (unique in its set) and ``embedding``. The similarity is the
    cosine, rounded to 6 places; of equals the smaller id comes first. Pairs less similar than ``least`` do not
    come out, so many vectors have fewer than ``k`` (see :func:`nearest_vectors`); a pair exactly that similar is met with the probability ``recall``, nearer ones with a
    higher one. Null, empty and zero vectors and those with a null, NaN or infinite element take no part;
    vectors of different lengths are never compared. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_set", F.col("id").cast("string").alias("id"), "embedding").filter("embedding is not null and id is not null")
    handle = F.xxhash64("vec_set", "id").bitwiseAND(F.lit(-2)).alias("handle")
    sizes = {r.vec_set: r["count"] for r in vectors.groupBy("vec_set").count().collect()}  # one row per set
    if not sizes:
        return spark.createDataFrame([], "vec_set string, id string, other_id string, similarity double, rank int")

    keyed = vectors.mapInArrow(_classes, "vec_set string, id string, c1 long, c2 long")
    copied = keyed.groupBy("vec_set", "c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copied = written(copied.select("vec_set", "c1", "c2", "rep"), "copied")
    n_classes = copied.count()
    members = None
    if n_classes:
        small = F.broadcast(copied) if n_classes <= BROADCAST_ROWS else copied
        members = written(keyed.join(small, ["vec_set", "c1", "c2"]).select("vec_set", "id", "rep"), "members")
        others = members.filter("id != rep").select("vec_set", "id")
        n_members = members.count()
        single = vectors.join(F.broadcast(others) if n_members <= BROADCAST_ROWS else others, ["vec_set", "id"], "left_anti")
    else:
        single = vectors
    single = single.select("vec_set", "id", "embedding", handle)

    far = math.sqrt(2)
    ks = {s: max(4, round(math.log(max(n / cell, 2)) / -math.log(_collision(far, width)))) for s, n in sizes.items()}
    edge = math.sqrt(max(2 - 2 * least, 1e-6))
    ts = {s: tables_for(ks[s], edge, recall, width, probes) for s in sizes}
    angle = math.acos(max(-1.0, min(1.0, least))) / math.pi
    most = math.ceil(BITS * angle + 3.5 * math.sqrt(BITS * angle * (1 - angle)))

    plain = single.select("vec_set", "handle", "embedding")
    cells = plain.mapInArrow(_hash_rows(ks, ts, width, probes, seed, True), "key long, visit long").groupBy("key").agg(F.count("*").alias("rows"), F.sum("visit").alias("visits"))
    cells = cells.withColumn("homes", F.col("rows") - F.col("visits")).filter((F.col("homes") > hot_cell) | ((F.col("homes") > 0) & (F.col("visits") > VISITORS * hot_cell)))
    hot = written(cells, "hot")
    n_hot = hot.count()
    rows = plain.mapInArrow(_hash_rows(ks, ts, width, probes, seed), "key long, handle long, s1 long, s2 long, s3 long")
    hot_keys = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    cool = rows.join(hot_keys.select("key"), "key", "left_anti") if n_hot else rows
    total = sum(n * ts[s] * (1 + probes) for s, n in sizes.items())
    parts = max(parallelism(spark), math.ceil(total / 1_000_000))
    pairs = cool.repartition(parts, "key").mapInArrow(_cell_pairs(most), "ha long, hb long")
    pairs = pairs.repartition(parts, "ha").dropDuplicates(["ha", "hb"])
    side = single.select("handle", "vec_set", "id", "embedding")
    first, second = (side.select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns)) for x in "ab")
    scored = (
        pairs.join(first, pairs.ha == first.handle_a)
        .join(second, F.col("hb") == second.handle_b)
        .select("vec_set_a", "id_a", "embedding_a", "vec_set_b", "id_b", "embedding_b")
        .mapInArrow(_similarity, "vec_set string, id_a string, id_b string, similarity double")
        .filter(F.col("similarity") >= least)
    )
    directed = scored.unionByName(scored.select("vec_set", F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "similarity"))
    if n_hot:
        # residents in blocks, everybody who asks in slices: each pair of a block and a slice is searched by itself
        blocks = F.ceil(F.col("homes") / (hot_cell // 2)).cast("int")
        slices = F.ceil(F.col("rows") / (VISITORS * hot_cell)).cast("int")
        mine = rows.join(hot_keys, "key").withColumns({"blocks": blocks, "slices": slices})
        spread = lambda n, salt: F.pmod(F.xxhash64("handle", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        role = F.col("handle").bitwiseAND(F.lit(1))
        place = (F.col("b") * F.col("slices") + F.col("s")).alias("block")
        base = mine.filter(role == 0).withColumn("b", spread("blocks", 0)).withColumn("s", every("slices")).select("key", place, F.lit(0).alias("role"), "handle")
        asks = mine.withColumn("s", spread("slices", 1)).withColumn("b", every("blocks"))
        ask = asks.select("key", place, F.lit(1).alias("role"), F.col("handle").bitwiseAND(F.lit(-2)).alias("handle"))
        searched = (
            base.unionByName(ask)
            .join(side, "handle")
            .repartition(max(parts, 4 * n_hot), "key", "block")
            .sortWithinPartitions("key", "block", "role")
            .select("key", "block", "role", "vec_set", "id", "embedding")
            .mapInArrow(_block_search(k), "vec_set string, id_a string, id_b string, similarity double")
            .filter(F.col("similarity") >= least)
        )
        searched = written(searched, "searched")
        back = searched.select("vec_set", F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "similarity")
        directed = directed.unionByName(searched).unionByName(back).distinct()
    best = Window.partitionBy("vec_set", "id_a").orderBy(F.desc("similarity"), F.asc("id_b"))
    if members is not None:
        nearest = written(directed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "nearest")
        in_class = Window.partitionBy("vec_set", "rep").orderBy("id")
        heads = written(members.withColumn("r", F.row_number().over(in_class)).filter(F.col("r") <= k + 1).drop("r"), "heads")
        partner = heads.select("vec_set", F.col("rep").alias("id_b"), F.col("id").alias("other"))
        subject = members.select("vec_set", F.col("rep").alias("id_a"), F.col("id").alias("member"))
        # a class is one of somebody's nearest through its smallest members; all members have the class's nearest
        nearest = nearest.join(partner, ["vec_set", "id_b"], "left").select("vec_set", "id_a", F.coalesce("other", "id_b").alias("id_b"), "similarity")
        nearest = nearest.join(subject, ["vec_set", "id_a"], "left").select("vec_set", F.coalesce("member", "id_a").alias("id_a"), "id_b", "similarity")
        inside = (
            members.join(heads.select("vec_set", "rep", F.col("id").alias("id_b")), ["vec_set", "rep"])
            .filter("id != id_b")
            .select("vec_set", F.col("id").alias("id_a"), "id_b", F.lit(1.0).alias("similarity"))
        )
        directed = nearest.unionByName(inside)
    return directed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("vec_set", F.col("id_a").alias("id"), F.col("id_b").alias("other_id"), "similarity", "rank")


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, id, length, vector) of each usable vector."""
    for batch in batches:
        for rows, m in _by_length(batch, 2):
            vec_set, id_, vector = (batch.column(i).take(pa.array(rows)) for i in range(3))
            yield pa.RecordBatch.from_arrays([vec_set, id_, pa.array(np.full(len(rows), m.shape[1], dtype=np.int32)), vector], names=["vec_set", "id", "dim", "embedding"])


def _nearest_in(q: np.ndarray, base: np.ndarray, own: np.ndarray, k: int, step: int = 2_048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``base``, similarity) of the ``k`` nearest of each row; of equals the earlier row of ``base``.

    Both hold unit vectors; ``own`` is the row of ``base`` that a row of ``q`` must not meet, or -1. Single precision
    only discards what lies further below the k-th than its error bound; all others are compared in double precision.
    """
    margin = 3e-6 + 2 * (q.shape[1] + 4) * 6e-8
    q32, b32 = q.astype(np.float32), base.astype(np.float32)
    rows, cols, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(q), -np.inf)
    for lo in range(0, len(base), step):
        rough = q32 @ b32[lo : lo + step].T
        if rough.shape[1] > k + 1:
            unfilled = np.nonzero(np.isneginf(floor))[0]
            if len(unfilled):
                floor[unfilled] = np.partition(rough[unfilled], -(k + 1), axis=1)[:, -(k + 1)] - margin
        r, c = np.divmod(np.flatnonzero(rough >= floor.astype(np.float32)[:, None]), rough.shape[1])
        c += lo
        other = c != own[r]
        r, c = r[other], c[other]
        exact = [np.einsum("ij,ij->i", q[r[at : at + 50_000]], base[c[at : at + 50_000]]) for at in range(0, len(r), 50_000)]
        rows, cols, sims = np.concatenate([rows, r]), np.concatenate([cols, c]), np.round(np.concatenate([sims, *exact]), 6)
        order = np.lexsort((cols, -sims, rows))
        rows, cols, sims = rows[order], cols[order], sims[order]
        first = np.searchsorted(rows, np.arange(len(q)))
        keep = np.arange(len(rows)) - first[rows] < k
        rows, cols, sims = rows[keep], cols[keep], sims[keep]
        many = np.bincount(rows, minlength=len(q))
        full = np.nonzero(many >= k)[0]
        floor[full] = sims[np.cumsum(many)[full] - 1] - margin
    return rows, cols, sims


def _tile_search(k: int) -> Callable:
    """The ``k`` nearest of each asking row within one tile; rows come sorted by key, block and role, those asked first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, base, place = None, [], [], None, {}
        for batch in batches:
            key, block, role = (np.asarray(batch.column(i)) for i in range(3))
            edges = np.nonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])])[0]
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if (key[lo], block[lo]) != now:
                    now, ids, vectors, base = (key[lo], block[lo]), [], [], None
                m = np.asarray(part.column(5).flatten().cast(pa.float64())).reshape(part.num_rows, -1)
                m = m / np.sqrt((m * m).sum(1))[:, None]
                names = part.column(4).to_pylist()
                if role[lo] == 0:
                    ids += names
                    vectors.append(m)
                    continue
                if not ids:
                    continue
                if base is None:
                    order = sorted(range(len(ids)), key=ids.__getitem__)
                    ids, base = [ids[i] for i in order], np.concatenate(vectors)[order]
                    vectors, place = [], {x: i for i, x in enumerate(ids)}
                own = np.array([place.get(x, -1) for x in names], dtype=np.int64)
                partner = pa.array(ids, pa.string())
                for at in range(0, len(names), 2_048):
                    r, c, sims = _nearest_in(m[at : at + 2_048], base, own[at : at + 2_048], k)
                    asked = part.slice(at).take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([asked.column(3), asked.column(4), partner.take(pa.array(c)), pa.array(sims)], names=["vec_set", "id", "other_id", "similarity"])

    return run


def nearest_vectors(vectors: DataFrame, k: int = 5, tile: int = TILE) -> DataFrame:
    """``(vec_set, id, other_id, similarity, rank)``: the ``k`` most similar others of every vector, however far they are.

    Takes what :func:`similar_vectors` takes and ranks as it does, but compares every two vectors of a set, so it is
    exact and has no least similarity; a vector gets fewer than ``k`` rows only where its set holds fewer others.
    Each side of a tile has about ``tile`` vectors; a vector is shuffled twice per tile side of its set.
    """
    spark = vectors.sparkSession
    given = vectors.select("vec_set", F.col("id").cast("string").alias("id"), "embedding").filter("embedding is not null and id is not null")
    kind = given.schema["embedding"].dataType.simpleString()
    usable = written(given.mapInArrow(_usable, f"vec_set string, id string, dim int, embedding {kind}"), "usable")
    sizes = usable.groupBy("vec_set", "dim").count().agg(F.max("count").alias("most"), F.count("*").alias("sets")).first()
    if not sizes.sets:
        return spark.createDataFrame([], "vec_set string, id string, other_id string, similarity double, rank int")
    blocks = max(math.ceil(sizes.most / tile), round(math.sqrt(parallelism(spark) / sizes.sets)))
    home = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    key = F.xxhash64("vec_set", "dim", "asking").alias("key")
    base = usable.select("*", home.alias("block"), every.alias("asking")).select(key, "block", F.lit(0).alias("role"), "vec_set", "id", "embedding")
    ask = usable.select("*", home.alias("asking"), every.alias("block")).select(key, "block", F.lit(1).alias("role"), "vec_set", "id", "embedding")
    met = (
        base.unionByName(ask)
        .repartition(max(parallelism(spark), 4 * sizes.sets * blocks * blocks), "key", "block")
        .sortWithinPartitions("key", "block", "role")
        .mapInArrow(_tile_search(k), "vec_set string, id string, other_id string, similarity double")
    )
    best = Window.partitionBy("vec_set", "id").orderBy(F.desc("similarity"), F.asc("other_id"))
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85, **options) -> DataFrame:
    """``(vec_table, id_a, id_b)``, smaller id first: pairs of which one is among the ``k`` nearest of the other."""
    near = similar_vectors(vectors, k, least, **options)
    return near.select(F.col("vec_set").alias("vec_table"), F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()
