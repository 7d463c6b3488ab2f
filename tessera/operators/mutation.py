"""Changes as new snapshots: replace, upsert, delete with everything that depends on it, and an atomic store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators.graph import without_orphans
from tessera.session import names_in, publish, read_text


def replace_documents(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with every file of ``new`` replaced as a whole."""
    return chunks.join(new.select("filename").distinct(), "filename", "left_anti").unionByName(new.select(*chunks.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` take the place of those with equal keys; of several with one key the largest row stays."""
    rest = [c for c in table.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)) if rest else rows.select(*keys).distinct()
    return table.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*table.columns))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key is not there yet; ids made from the key make this an insert-or-get."""
    fresh = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def insert_or_get(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with what was missing, the distinct keys of ``rows`` with ``inserted``: whether they are new)."""
    asked = rows.dropDuplicates(keys)
    there = table.select(*keys).distinct().withColumn("_there", F.lit(True))
    told = asked.join(there, keys, "left").select(*keys, F.col("_there").isNull().alias("inserted"))
    return insert_missing(table, rows, keys), told


def reject_duplicates(files: DataFrame, known: DataFrame) -> DataFrame:
    """``(file_id, filename, holder)``: uploads of a batch whose hash another name holds, in the store or earlier in the batch.

    ``files`` (file_id, filename, sha256), ``known`` (filename, sha256); within a batch the smaller id was first.
    The same name may hold its hash again; null hashes are never duplicates.
    """
    held = known.filter("sha256 is not null").groupBy("sha256").agg(F.min("filename").alias("old"))
    first = files.filter("sha256 is not null").groupBy("sha256").agg(F.min(F.struct("file_id", "filename"))["filename"].alias("new"))
    holder = F.coalesce("old", "new").alias("holder")
    return files.join(first, "sha256").join(held, "sha256", "left").select("file_id", "filename", holder).filter("filename != holder")


def delete_owner(users: DataFrame, conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, conversations, messages) without the users of ``gone`` (owner_id) and all that hangs on them."""
    lost = conversations.join(gone.select("owner_id").distinct(), "owner_id", "left_semi").select("conversation_id").distinct()
    return users.join(gone, "owner_id", "left_anti"), conversations.join(lost, "conversation_id", "left_anti"), messages.join(lost, "conversation_id", "left_anti")


def touch_users(users: DataFrame, seen: DataFrame, age: int = 300) -> DataFrame:
    """Users (owner_id, name, seen_at) after sign-ins of the same columns: new ones are added, and known ones changed
    only if their name differs or they were last seen more than ``age`` seconds before."""
    newest = seen.groupBy("owner_id").agg(F.max(F.struct("seen_at", "name")).alias("n"))
    joined = users.join(newest, "owner_id", "full_outer")
    old = F.coalesce(F.unix_timestamp("n.seen_at") - F.unix_timestamp("seen_at") > age, F.lit(True))
    change = F.col("n").isNotNull() & (old | ~F.col("n.name").eqNullSafe(F.col("name")))
    return joined.select("owner_id", F.when(change, F.col("n.name")).otherwise(F.col("name")).alias("name"), F.when(change, F.col("n.seen_at")).otherwise(F.col("seen_at")).alias("seen_at"))


def stamp(table: DataFrame, keys: DataFrame, key: str, column: str, when: Column) -> DataFrame:
    """``column`` set where the key was processed."""
    marked = keys.select(key).distinct().withColumn("_done", F.lit(True))
    return table.join(marked, key, "left").withColumn(column, F.when(F.col("_done"), when).otherwise(F.col(column))).drop("_done")


def delete_documents(gone: DataFrame, chunks: DataFrame, summaries: DataFrame, files: DataFrame, phrases: DataFrame, facts: DataFrame, links: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All tables after the files of ``gone`` (filename) and what only they supported are gone, and ``deleted`` (filename, chunks)."""
    names = gone.select("filename").distinct()
    kept = chunks.join(names, "filename", "left_anti")
    phrases, facts, links, edges = without_orphans(phrases, facts, links, edges, kept)
    return {
        "chunks": kept,
        "summaries": summaries.join(names, "filename", "left_anti"),
        "files": files.join(names, "filename", "left_anti"),
        "phrases": phrases,
        "facts": facts,
        "links": links,
        "edges": edges,
        "deleted": chunks.join(names, "filename", "left_semi").groupBy("filename").agg(F.count("*").alias("chunks")),
    }


def replace_captions(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """Caption rows of the files of ``captions`` (filename, caption_no, content) replaced, numbered after the other rows."""
    names = captions.select("filename").distinct()
    old = chunks.join(names.withColumn("_again", F.lit(True)), "filename", "left").filter(F.col("_again").isNull() | (F.col("source_type") != "image_caption")).drop("_again")
    after = old.groupBy("filename").agg((F.coalesce(F.max("chunk_index"), F.lit(-1)) + 1).alias("base"))
    rows = captions.join(after, "filename", "left").withColumn("chunk_index", (F.coalesce("base", F.lit(0)) + F.col("caption_no") - 1).cast("int"))
    rows = rows.withColumn("source_type", F.lit("image_caption")).withColumn("chunk_id", F.substring(F.sha2(F.concat_ws("\x1f", "filename", "chunk_index", "content"), 256), 1, 16))
    return old.unionByName(rows.select(*[c for c in old.columns if c in rows.columns]), allowMissingColumns=True)


def rechunk_guard(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(filename, text_chunks, safe)``: whether new text chunks (filename, chunk_index) stay below the other rows' indexes."""
    first_other = chunks.filter("source_type != 'text'").groupBy("filename").agg(F.min("chunk_index").alias("first_other"))
    new = fresh.groupBy("filename").agg(F.count("*").alias("text_chunks"), F.max("chunk_index").alias("last"))
    return new.join(first_other, "filename", "left").select("filename", "text_chunks", F.coalesce(F.col("last") < F.col("first_other"), F.lit(True)).alias("safe"))


class SnapshotStore:
    """Tables as numbered snapshot folders; a commit shows all its tables or none.

    Each commit publishes a pointer of its own number, which appears whole or not at all; the newest pointer
    counts. A crash before that leaves the last commit as it was. Of two writers that start from the same
    commit one gets a :class:`Conflict` and writes again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _newest(self) -> int:
        return max((int(n) for n in names_in(self.spark, f"{self.root}/commits") if n.isdigit()), default=0)

    def versions(self) -> dict[str, str]:
        number = self._newest()
        return json.loads(read_text(self.spark, f"{self.root}/commits/{number:08d}")) if number else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.versions()[name])

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write new snapshots, then publish the pointer to them; returns the number of the commit."""
        before = self._newest()
        known = self.versions()
        for name, df in tables.items():
            target = f"{self.root}/{name}/{before + 1:08d}-{uuid.uuid4().hex[:8]}"
            df.write.mode("errorifexists").parquet(target)
            known[name] = target
        if not publish(self.spark, f"{self.root}/commits/{before + 1:08d}", json.dumps(known)):
            raise Conflict(f"another writer made commit {before + 1} first")
        return before + 1


    def append(self, name: str, rows: DataFrame) -> int:
        """Add rows to a table, or begin it with them."""
        return self.commit({name: self.read(name).unionByName(rows.select(*self.read(name).columns)) if name in self.versions() else rows})

    def read_buckets(self, name: str) -> DataFrame | None:
        """A table that :meth:`replace_files` keeps, or None before its first file."""
        paths = [p for k, p in self.versions().items() if k.startswith(f"{name}/")]
        return self.spark.read.parquet(*paths) if paths else None

    def replace_files(self, name: str, rows: DataFrame, buckets: int = 64) -> int | None:
        """Replace every file of ``rows`` (filename, ...) as a whole; only the buckets of files that hold one of them are written.

        A bucket's folder stays as it is while no file of it comes again, so a small batch rewrites a small part.
        """
        bucket = F.pmod(F.xxhash64("filename"), F.lit(buckets)).cast("int")
        touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())  # at most as many as buckets
        if not touched:
            return None
        known = self.versions()
        old = [known[f"{name}/{b}"] for b in touched if f"{name}/{b}" in known]
        whole = replace_documents(self.spark.read.parquet(*old), rows) if old else rows
        target = f"{self.root}/{name}/{self._newest() + 1:08d}-{uuid.uuid4().hex[:8]}"
        whole.withColumn("_bucket", bucket).repartition("_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(target)
        return self._point({f"{name}/{b}": f"{target}/_bucket={b}" for b in touched})

    def _point(self, paths: dict[str, str]) -> int:
        number = self._newest() + 1
        if not publish(self.spark, f"{self.root}/commits/{number:08d}", json.dumps({**self.versions(), **paths})):
            raise Conflict(f"another writer made commit {number} first")
        return number


class Conflict(RuntimeError):
    """Another writer was first."""
