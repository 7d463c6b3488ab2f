"""Problem 2: check each new batch of files against everything accepted before.

Accepted files leave fingerprints in a persistent store: of their hash, of their name as it reads,
winnowed ones of the name's letters, and if it is short one for each slip it may have. The store is a
folder that outlives the session: :class:`FingerprintStore` opens it, :func:`add_batch` holds one batch
against it and adds what is accepted. Fingerprints lie in folders by bucket; each batch adds a layer of
them and of Bloom filters, one filter a bucket. A new batch's fingerprints are screened by the filters,
bucket by bucket; only the buckets of positives are read from the store, candidates must share one of a
slip or enough of their winnowed fingerprints, and the names are then compared. A layer counts once its
marker is published, so a batch that failed half-way leaves nothing and is added again. Layers of one tier
are merged when they are many, so a fingerprint is rewritten as often as the logarithm of the layers.

Within a batch, files are decided in rounds: a file with no earlier undecided file under one of its
keys is accepted; one with an earlier accepted file is a case. Keys, not pairs, carry the groups, so a
group of copies costs one row a copy, however large it is. Each batch ends in tables of the store, so
plans do not grow with the batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tessera.llm.filenames import canonical_hash, canonical_name, fingerprints, same_words, slip_prints
from tessera.session import names_in, new_folder, publish, read_text, release, remove, written

HASH, NAME, WINNOWED, SLIP = 0, 1, 2, 3
BITS_PER_KEY = 12
PROBES = 4
#: Share of the smaller winnowed set that two spellings of one name must have in common.
COVERAGE = 0.2
#: Positives that may be sent to all tasks, of 12 bytes each.
BROADCAST_ROWS = 500_000
#: So many layers of one tier are merged into one of the next.
MERGE = 8
#: Fingerprints that a bucket is planned for.
BUCKET_KEYS = 1_000_000
_PREPARED = "file_id long, batch int, hash_key long, name_key long, words string, prints array<long>, slips array<long>"
_STORE = "fp long, kind int, file_id long, words string, size int, bucket int"
_FILTERS = "bucket int, bits binary"
_CASES = "file_id long, a long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, hashes, numbers = (batch.column(i).to_pylist() for i in range(4))
        rows: tuple[list, ...] = ([], [], [], [], [])
        for name, value in zip(names, hashes):
            digest = canonical_hash(value)
            rows[0].append(None if digest is None else _signed(xxhash.xxh64_intdigest(digest, 1)))
            words, digits = canonical_name(name) if name is not None else ((), ())
            if words or digits:
                rows[1].append(_signed(xxhash.xxh64_intdigest("\x1f".join((*words, "", *digits)), 2)))
            else:
                rows[1].append(None)
            rows[2].append(" ".join(words))
            rows[3].append([_signed(x) for x in fingerprints(words, digits)])
            rows[4].append([_signed(x) for x in slip_prints(words, digits)])
        types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), *(pa.array(c, t) for c, t in zip(rows, types))], names=[c.split()[0] for c in _PREPARED.split(", ")])


def _positions(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of each probe, by double hashing."""
    k = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        a = k * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(32)
        b = (k * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17) | np.uint64(1)
        return [((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that one of their bucket's filters has, or that several files of the batch share.

    Rows come sorted by bucket, the bucket's filters (with ``bits``) before its keys.
    """
    now, filters = None, []
    for batch in batches:
        buckets = np.asarray(batch.column(0))
        if not len(buckets):
            continue
        fps, shared, bits = np.asarray(batch.column(1).fill_null(0)), np.asarray(batch.column(2).fill_null(False)), batch.column(3)
        is_filter = np.asarray(bits.is_valid())
        seen = np.zeros(len(buckets), dtype=bool)
        edges = np.r_[0, np.nonzero((buckets[1:] != buckets[:-1]) | (is_filter[1:] != is_filter[:-1]))[0] + 1, len(buckets)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if buckets[lo] != now:
                now, filters = buckets[lo], []
            if is_filter[lo]:
                filters += [np.frombuffer(x, dtype=np.uint8) for x in bits.slice(lo, hi - lo).to_pylist()]
                continue
            for packed in filters:
                has = np.ones(hi - lo, dtype=bool)
                for at in _positions(fps[lo:hi], len(packed) * 8):
                    has &= (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                seen[lo:hi] |= has
        take = ~is_filter & (seen | shared)
        yield pa.RecordBatch.from_arrays([pa.array(fps[take]), pa.array(seen[take]), pa.array(shared[take])], names=["fp", "seen", "shared"])


def _filter_of(bucket: int, keys: np.ndarray) -> pa.RecordBatch:
    size = max(8, math.ceil(len(keys) * BITS_PER_KEY / 8))
    packed = np.zeros(size * 8, dtype=np.uint8)
    for at in _positions(keys, size * 8):
        packed[at] = 1
    bits = np.packbits(packed, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits], pa.binary())], names=["bucket", "bits"])


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each bucket, or for each part of it; rows come file by file, so a bucket's rows lie together."""
    now, parts = None, []
    for batch in batches:
        buckets, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(buckets):
            continue
        edges = np.r_[0, np.nonzero(buckets[1:] != buckets[:-1])[0] + 1, len(buckets)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if now is not None and buckets[lo] != now:
                yield _filter_of(now, np.concatenate(parts))
                parts = []
            now = int(buckets[lo])
            parts.append(keys[lo:hi])
    if now is not None:
        yield _filter_of(now, np.concatenate(parts))


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and same_words(tuple(x.split()), tuple(y.split())) for x, y in zip(a, b)], dtype=bool)


class FingerprintStore:
    """Fingerprints, Bloom filters and cases of the batches so far, below one folder; opening it makes it if it is new.

    ``buckets`` counts only for a new store. One writer at a time: of two that add the same layer, the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        publish(spark, f"{self.path}/store", json.dumps({"buckets": buckets}))
        self.buckets: int = json.loads(read_text(spark, f"{self.path}/store"))["buckets"]
        self.known: dict[str, dict] = {n: json.loads(read_text(spark, f"{self.path}/layers/{n}")) for n in names_in(spark, f"{self.path}/layers")}

    def layers(self, tier: int | None = None) -> list[str]:
        """Names of the layers in force, of one tier or of all."""
        gone = {n for x in self.known.values() for n in x["merged"]}
        return [n for n, x in self.known.items() if n not in gone and tier in (None, x["tier"])]

    def bucket(self, fp) -> F.Column:
        return F.pmod(fp, F.lit(self.buckets)).cast("int")

    def _read(self, what: str, schema: str, layers: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*(f"{self.path}/{what}/layer={n}" for n in layers))

    def screen(self, prints: DataFrame) -> DataFrame:
        """(fp, seen, shared): fingerprints of the batch that a filter has seen or that several of its files share."""
        keys = prints.groupBy("fp").agg((F.min("file_id") < F.max("file_id")).alias("shared"))
        layers = self.layers()
        if not layers:
            return keys.filter("shared").select("fp", F.lit(False).alias("seen"), "shared")
        keys = keys.select(self.bucket(F.col("fp")).alias("bucket"), "fp", "shared", F.lit(None).cast("binary").alias("bits"))
        both = keys.unionByName(self._read("filters", _FILTERS, layers), allowMissingColumns=True).repartition("bucket")
        return both.sortWithinPartitions("bucket", F.col("bits").isNull()).mapInArrow(_screen, "fp long, seen boolean, shared boolean")

    def rows(self, wanted: DataFrame, few: bool, buckets: list[int]) -> DataFrame:
        """(fp, kind, a, a_words, a_size) of the store under ``wanted`` (fp, kind), which lie in these buckets; no file of another bucket is read.

        If they are ``few``, they are sent to the tasks and nothing of the store but their rows is shuffled.
        """
        store = self._read("prints", _STORE, self.layers()).filter(F.col("bucket").isin(buckets))
        if few:
            store = store.join(F.broadcast(wanted), ["fp", "kind"], "left_semi")
        return store.select("fp", "kind", F.col("file_id").alias("a"), F.col("words").alias("a_words"), F.col("size").alias("a_size"))

    def _write(self, prints: DataFrame, tier: int, merged: list[str]) -> None:
        name = f"{len(self.known):06d}"
        folder = lambda what: f"{self.path}/{what}/layer={name}"
        rows = prints.withColumn("bucket", self.bucket(F.col("fp"))).repartition("bucket").sortWithinPartitions("bucket", "fp")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(folder("prints"))
        self._read("prints", _STORE, [name]).select("bucket", "fp").mapInArrow(_filters, _FILTERS).write.mode("overwrite").parquet(folder("filters"))
        marker = {"tier": tier, "merged": merged}
        if not publish(self.spark, f"{self.path}/layers/{name}", json.dumps(marker)):
            raise RuntimeError(f"another writer added layer {name} to {self.path}")
        self.known[name] = marker

    def add(self, accepted: DataFrame, cases: DataFrame) -> str:
        """A new layer of these files (as prepared), and the batch's cases (file_id, a) beside it; returns its name."""
        name = f"{len(self.known):06d}"
        cases.write.mode("overwrite").parquet(f"{self.path}/cases/layer={name}")
        self._write(_prints(accepted).select("fp", "kind", "file_id", "words", "size"), 0, [])
        tier = 0
        while len(old := self.layers(tier)) >= MERGE:
            self._write(self._read("prints", _STORE, old).drop("bucket", "layer"), tier + 1, old)
            for n in old:
                remove(self.spark, f"{self.path}/prints/layer={n}")
                remove(self.spark, f"{self.path}/filters/layer={n}")
            tier += 1
        return name

    def cases(self, layers: list[str] | None = None) -> DataFrame:
        """(file_id_a, file_id_b) of these batches' cases, or of all."""
        every = [n for n, x in self.known.items() if not x["merged"]] if layers is None else layers
        if not every:
            return self.spark.createDataFrame([], "file_id_a long, file_id_b long")
        return self._read("cases", _CASES, every).select(F.col("a").alias("file_id_a"), F.col("file_id").alias("file_id_b"))


def _prints(files: DataFrame) -> DataFrame:
    """(fp, kind, file_id, hash_key, name_key, words, size) of each key and winnowed fingerprint."""
    keys = F.array(F.struct(F.col("hash_key").alias("fp"), F.lit(HASH).alias("kind")), F.struct(F.col("name_key").alias("fp"), F.lit(NAME).alias("kind")))
    parts = F.transform("prints", lambda x: F.struct(x.alias("fp"), F.lit(WINNOWED).alias("kind")))
    slips = F.transform("slips", lambda x: F.struct(x.alias("fp"), F.lit(SLIP).alias("kind")))
    each = files.select("file_id", "hash_key", "name_key", "words", F.size("prints").alias("size"), F.explode(F.concat(keys, parts, slips)).alias("p"))
    words = F.when(F.col("p.kind") >= WINNOWED, F.col("words")).alias("words")
    return each.select("p.fp", "p.kind", "file_id", "hash_key", "name_key", words, "size").filter("fp is not null")


def _near_names(rows: DataFrame) -> DataFrame:
    """(name_key, near): for names in ``rows`` (fp, kind, name_key, words, size) those that read the same apart from slips."""
    mine = rows.groupBy("fp", "kind", "name_key").agg(F.first("words").alias("words"), F.first("size").alias("size"))
    other = mine.select("fp", "kind", F.col("name_key").alias("other_key"), F.col("words").alias("other_words"), F.col("size").alias("other_size"))
    shared = mine.join(other, ["fp", "kind"]).filter("name_key < other_key").groupBy("name_key", "other_key")
    shared = shared.agg(F.count("*").alias("shared"), F.max("kind").alias("kind"), *(F.first(c).alias(c) for c in ("words", "other_words", "size", "other_size")))
    near = shared.filter((F.col("kind") == SLIP) | (F.col("shared") >= COVERAGE * F.least("size", "other_size"))).filter(_same("words", "other_words"))
    both = F.array(F.struct("name_key", "other_key"), F.struct(F.col("other_key").alias("name_key"), F.col("name_key").alias("other_key")))
    return near.select(F.explode(both).alias("p")).select("p.name_key", "p.other_key").groupBy("name_key").agg(F.collect_set("other_key").alias("near"))


def _decide(suspects: DataFrame) -> list[DataFrame]:
    """Cases (file_id, a) among a batch's suspects (file_id, hash_key, name_key, near); see the module's text."""
    cases: list[DataFrame] = []
    undecided = suspects
    while True:
        own = undecided.select("file_id", F.explode(F.array("hash_key", "name_key")).alias("key")).filter("key is not null")
        asks = own.unionByName(undecided.select("file_id", F.explode("near").alias("key")))
        first = own.groupBy("key").agg(F.min("file_id").alias("first"))
        blocked = asks.join(first, "key").filter("first < file_id").select("file_id").distinct()
        held = own.join(blocked, "file_id", "left_anti").groupBy("key").agg(F.min("file_id").alias("a"))
        case = asks.join(held, "key").filter("a < file_id").groupBy("file_id").agg(F.min("a").alias("a"))
        state = undecided.join(blocked, "file_id").join(case, "file_id", "left")
        left = Observation()
        state = written(state.observe(left, F.count(F.when(F.col("a").isNull(), 1)).alias("undecided")), "state")
        cases.append(state.filter("a is not null").select("file_id", "a"))
        if not left.get["undecided"]:
            return cases
        undecided = state.filter("a is null").drop("a")


def _prepared(files: DataFrame, *more) -> DataFrame:
    picked = files.select(F.col("file_id").cast("long").alias("file_id"), "filename", "sha256", *more).filter("file_id is not null")
    return picked.groupBy("file_id").agg(F.min(F.struct("batch", "filename", "sha256")).alias("r")).select("file_id", "r.filename", "r.sha256", "r.batch").mapInArrow(_prepare, _PREPARED)


def _add_prepared(store: FingerprintStore, batch: DataFrame) -> str:
    prints = _prints(batch)
    found = Observation()
    flagged = prints.join(store.screen(prints), "fp").withColumn("bucket", store.bucket(F.col("fp")))
    seen_buckets = F.collect_set(F.when(F.col("seen"), F.col("bucket"))).alias("buckets")  # bounded by the buckets of the store
    rows = written(flagged.observe(found, seen_buckets, F.count(F.when(F.col("shared"), 1)).alias("shared"), F.count(F.when(F.col("seen"), 1)).alias("seen")), "rows")
    cases: list[DataFrame] = []
    suspects = rows.filter("shared")
    if buckets := sorted(found.get["buckets"]):
        # (file, accepted file) pairs under a common key, or under enough common fingerprints
        past = store.rows(rows.filter("seen").select("fp", "kind").distinct(), found.get["seen"] <= BROADCAST_ROWS, buckets)
        hits = rows.filter("seen").join(past, ["fp", "kind"]).groupBy("file_id", "a")
        hits = hits.agg(F.min("kind").alias("kind"), F.max("kind").alias("last"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("a_words").alias("a_words"), F.max("size").alias("size"), F.max("a_size").alias("a_size"))
        alike = (F.col("kind") < WINNOWED) | (((F.col("last") == SLIP) | (F.col("n") >= COVERAGE * F.least("size", "a_size"))) & _same("words", "a_words"))
        cases.append(written(hits.filter(alike).groupBy("file_id").agg(F.min("a").alias("a")), "old"))
        suspects = suspects.join(cases[0], "file_id", "left_anti")
    if found.get["shared"]:
        near = _near_names(suspects.filter(F.col("kind") >= WINNOWED))
        cases += _decide(written(suspects.select("file_id", "hash_key", "name_key").distinct().join(near, "name_key", "left"), "suspects"))
    gone = store.spark.createDataFrame([], _CASES)
    for some in cases:
        gone = gone.unionByName(some)
    layer = store.add(batch.join(gone.select("file_id"), "file_id", "left_anti"), gone)
    release(store.spark)
    return layer


def add_batch(store: FingerprintStore, files: DataFrame) -> DataFrame:
    """``(file_id_a, file_id_b)``: the files b of one batch that repeat a file a, accepted earlier or in this batch; the others are accepted.

    Nulls, malformed hashes and rows with one id as in :func:`repeated_files`. Nothing of the history but the
    filters of the batch's buckets and the fingerprints in buckets of positives is read.
    """
    batch = written(_prepared(files, F.lit(0).alias("batch")).drop("batch"), "batch")
    return store.cases([_add_prepared(store, batch)])


def repeated_files(files: DataFrame, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``(file_id_a, file_id_b)``: each file b that repeats an accepted file a, found batch by batch.

    Files arrive by batch (null last) and ``file_id``; of rows with one id one counts, rows without id
    none. A null or malformed hash matches nothing, nor does a null name or one without letters and
    digits. If several accepted files match, a is the first. An empty table gives no rows. The store is
    made in ``path``, which stays, or in a folder of this session.
    """
    spark = files.sparkSession
    folder = new_folder(spark, "prepared")
    _prepared(files, F.coalesce(F.col("batch_no").cast("int"), F.lit(2**31 - 1)).alias("batch")).write.partitionBy("batch").parquet(folder)
    prepared = spark.read.schema(_PREPARED).parquet(folder)
    sizes = {r.batch: r["count"] for r in prepared.groupBy("batch").count().collect()}  # one row a batch
    store = FingerprintStore(spark, path or new_folder(spark, "store"), buckets or max(8, math.ceil(sum(sizes.values()) * 20 / BUCKET_KEYS)))
    layers = [_add_prepared(store, prepared.filter(F.col("batch") == number).drop("batch")) for number in sorted(sizes)]
    return store.cases(layers)
