"""Problem 6: consolidate pairwise matches into groups.

Union-find runs inside bounded edge partitions. Each partition keeps only a spanning forest, in the
form of stars. Forests are merged level by level: a vertex that is the root of no star points to the
best root it has seen and retires; the remaining stars are rewritten onto the retired vertices'
parents and form the edges of the next level, again in bounded partitions, until one partition holds
all that is left. No component, however large, is ever gathered in one task: only the contracted
forest of at most ``max_edges`` edges is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import written

#: Edges that one union-find task holds; about 100 MB of identifiers.
MAX_EDGES = 250_000


def union_find(n: int, left: list[int], right: list[int], order: np.ndarray) -> np.ndarray:
    """Root of each of ``n`` vertices; the root is the member that comes first in ``order``."""
    parent = list(range(n))
    rank = order.tolist()
    for a, b in zip(left, right):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            if rank[a] < rank[b]:
                parent[b] = a
            else:
                parent[a] = b
    roots = np.asarray(parent)
    while True:
        above = roots[roots]
        if (above == roots).all():
            return roots
        roots = above


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the partition's edges as stars (member, root)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    both = pa.Table.from_batches(parts)
    n = both.num_rows
    codes, names = pd.factorize(pa.concat_arrays([*both.column(0).chunks, *both.column(1).chunks]).to_pandas())
    names = np.asarray(names, dtype=object)
    # a hashed order of the vertices: chains numbered in sequence contract as fast as random ones
    mixed = pd.util.hash_array(names)
    order = np.empty(len(names), dtype=np.int64)
    order[np.lexsort((names.astype(str), mixed))] = np.arange(len(names))
    roots = union_find(len(names), codes[:n].tolist(), codes[n:].tolist(), order)
    member = np.nonzero(roots != np.arange(len(names)))[0]
    for at in range(0, len(member), 50_000):
        m = member[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[m], pa.string()), pa.array(names[roots[m]], pa.string())], names=["member", "root"])


def connected_groups(edges: DataFrame, a: str, b: str, max_edges: int = MAX_EDGES) -> DataFrame:
    """``(member, group_id)`` for every vertex of ``edges``; ``group_id`` is the smallest member of its group.

    Identifiers are strings. Rows with a null end and edges of a vertex to itself are ignored; repeated
    and reversed edges count once. No edges give no rows.
    """
    if max_edges < 1:
        raise ValueError("max_edges must be positive")
    spark = edges.sparkSession
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    level = edges.select(F.least(x, y).alias("l"), F.greatest(x, y).alias("r")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    level = written(level, "edges")
    retired: list[DataFrame] = []
    while True:
        count = level.count()
        parts = math.ceil(count / max_edges)
        if parts <= 1:
            labels = written(level.coalesce(1).mapInArrow(_forest, "member string, root string"), "labels")
            break
        # bounded partitions: edges are spread by both ends, so a vertex with very many edges is split too
        stars = written(level.repartition(parts, F.xxhash64("l", "r")).mapInArrow(_forest, "member string, root string"), "stars")
        parent = stars.groupBy("member").agg(F.min(F.struct(F.xxhash64("root").alias("h"), F.col("root").alias("p")))["p"].alias("parent"))
        roots = stars.select(F.col("root").alias("member")).distinct().withColumn("is_root", F.lit(True))
        parent = written(parent.join(roots, "member", "left"), "parents")
        retired.append(parent.filter(F.col("is_root").isNull()).select("member", "parent"))
        moved = stars.join(parent.select("member", "parent"), "member").select(F.col("parent").alias("x"), F.col("root").alias("y"))
        kept = parent.filter("is_root").select(F.col("member").alias("x"), F.col("parent").alias("y"))
        level = written(
            moved.unionByName(kept).filter("x != y").select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r")).distinct(),
            "edges",
        )
    labels = labels.unionByName(labels.select(F.col("root").alias("member"), "root").distinct())
    for n, gone in enumerate(reversed(retired)):
        # what retired at this level takes its parent's label; a parent that appears in no later level is a root itself
        above = labels.withColumnRenamed("member", "parent")
        down = gone.join(above, "parent", "left").select("member", F.coalesce("root", "parent").alias("root"))
        tops = gone.select(F.col("parent").alias("member")).distinct().join(labels, "member", "left_anti").select("member", F.col("member").alias("root"))
        labels = written(labels.unionByName(down).unionByName(tops), f"labels{n}")
    smallest = labels.groupBy("root").agg(F.min("member").alias("group_id"))
    return labels.join(smallest, "root").select("member", "group_id")


def tied_phrases(edges: DataFrame, phrases: DataFrame, least_weight: float = 0.8, max_edges: int = MAX_EDGES) -> DataFrame:
    """``(phrase_id, group_id)`` of phrases tied by pairs of at least ``least_weight``.

    A pair counts if its weight is a finite number and both ends are different phrases that exist.
    Null, NaN, infinite and too small weights, deleted phrases, loops and repeats are no ties; other
    columns of either table are not read.
    """
    weight = F.col("weight").cast("double")
    known = phrases.select(F.col("phrase_id").alias("known")).filter("known is not null").distinct()
    strong = (
        edges.filter(weight.isNotNull() & ~F.isnan(weight) & (weight >= least_weight) & (weight < float("inf")))
        .select("phrase_a", "phrase_b")
        .filter("phrase_a != phrase_b")
        .select(F.least("phrase_a", "phrase_b").alias("phrase_a"), F.greatest("phrase_a", "phrase_b").alias("phrase_b"))
        .distinct()
    )
    strong = strong.join(known, strong.phrase_a == known.known, "left_semi")
    strong = strong.join(known, strong.phrase_b == known.known, "left_semi")
    return connected_groups(strong, "phrase_a", "phrase_b", max_edges).withColumnRenamed("member", "phrase_id")
