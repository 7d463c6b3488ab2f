"""Listing, filtering and counting the corpus; duplicates and work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import column, source_format, word_characters


def like_filter(c: Column | str, part: str) -> Column:
    """Case-insensitive substring in which % and _ act as wildcards."""
    return column(c).ilike(f"%{part}%")


def literal_filter(c: Column | str, part: str) -> Column:
    """Case-insensitive substring taken literally."""
    return F.contains(F.lower(column(c)), F.lit(part.lower()))


def folder_filter(c: Column | str, folder: str) -> Column:
    """Names below a folder; the folder is a literal, slashes around it do not matter."""
    inner = folder.strip("/")
    return column(c).startswith(inner + "/") if inner else F.lit(True)


def type_filter(c: Column | str, kind: str) -> Column:
    return F.lower(column(c)).endswith("." + kind.lower().lstrip("."))


def include_exclude(c: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Every part of ``include`` and none of ``exclude`` occurs."""
    tests = [like_filter(c, p) for p in include] + [~like_filter(c, p) for p in exclude]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def list_documents(chunks: DataFrame, condition: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``(filename, chunks)`` by name, one page."""
    rows = chunks.filter(condition) if condition is not None else chunks
    out = rows.groupBy("filename").agg(F.count("*").alias("chunks")).orderBy("filename")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def count_documents(chunks: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = chunks.filter(condition) if condition is not None else chunks
    return rows.agg(F.count_distinct("filename").alias("documents"))


def list_folders(chunks: DataFrame, parent: str = "") -> DataFrame:
    """``(folder, files)`` of the folders right below ``parent``, with the distinct files at any depth."""
    inner = parent.strip("/")
    prefix = inner + "/" if inner else ""
    rest = F.substring("filename", len(prefix) + 1, 2**30)
    rows = chunks.filter(F.col("filename").startswith(prefix) & rest.contains("/"))
    return rows.select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("folder"), "filename").groupBy("folder").agg(F.count_distinct("filename").alias("files"))


def first_ingested(files: DataFrame) -> DataFrame:
    return files.groupBy("filename").agg(F.min("created_at").alias("first_at"))


def kinds_by_document(chunks: DataFrame) -> DataFrame:
    """Chunks of each kind, the first other index and the format of the first chunk of each file."""
    text = F.col("source_type") == "text"
    return chunks.groupBy("filename").agg(
        F.count_if(text).alias("text_chunks"),
        F.count_if(~text).alias("other_chunks"),
        F.min(F.when(~text, F.col("chunk_index"))).alias("first_other_index"),
        F.min(F.struct("chunk_index", "chunk_id", "source_format"))["source_format"].alias("format"),
    )


def next_index(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("filename").agg((F.coalesce(F.max("chunk_index"), F.lit(-1)) + 1).alias("next_index"))


def corpus_stamp(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows and the latest time of each table: changes whenever the corpus does."""
    parts = []
    for name, df in tables.items():
        latest = F.max("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp")
        parts.append(df.agg(F.count("*").alias(f"{name}_rows"), latest.alias(f"{name}_latest")))
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def missing_summaries(chunks: DataFrame, summaries: DataFrame, redo: bool = False) -> DataFrame:
    """Files to summarise: all, or those without a summary."""
    files = chunks.select("filename").distinct()
    return files if redo else files.join(summaries.select("filename").distinct(), "filename", "left_anti")


def pending_captions(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    rows = files.filter(F.col("captioned_at").isNull() & include_exclude("filename", include, exclude))
    return rows.select("filename").distinct()


def backfill_format(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "filename", source_format("filename").alias("source_format"))


def exact_rows(chunks: DataFrame) -> DataFrame:
    """One row, the smallest id, of those equal in file, index and content; nulls equal each other."""
    return chunks.groupBy("filename", "chunk_index", "content").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies")).select("chunk_id", "filename", "chunk_index", "copies")


def duplicate_files(files: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """``(sha256, kept, names)``: hashes under several names, and the name that stays.

    The recorded holder stays, else the shortest name, else the earliest. Null hashes are no group.
    """
    per_name = files.filter("sha256 is not null").groupBy("sha256", "filename").agg(F.min("created_at").alias("first_at"))
    if recorded is not None:
        per_name = per_name.join(recorded.select("sha256", "filename", F.lit(0).alias("unrecorded")).distinct(), ["sha256", "filename"], "left")
    else:
        per_name = per_name.withColumn("unrecorded", F.lit(None).cast("int"))
    order = F.struct(F.coalesce("unrecorded", F.lit(1)), F.length("filename"), "first_at", "filename")
    return per_name.groupBy("sha256").agg(F.min_by("filename", order).alias("kept"), F.count("*").alias("names")).filter("names > 1")


def identical_document(batch: DataFrame, known: DataFrame) -> DataFrame:
    """``(filename, holder)``: files of a batch whose hash another name holds already, in the store or earlier in the batch."""
    held = known.filter("sha256 is not null").groupBy("sha256").agg(F.min("filename").alias("old"))
    first = batch.filter("sha256 is not null").groupBy("sha256").agg(F.min("filename").alias("first"))
    joined = batch.join(first, "sha256").join(held, "sha256", "left").withColumn("holder", F.coalesce("old", "first"))
    return joined.filter("holder != filename").select("filename", "holder")


def cached_captions(images: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with their caption, distinct hashes to caption) for ``images`` (image_id, sha256) and ``cache`` (sha256, caption)."""
    distinct = cache.groupBy("sha256").agg(F.max("caption").alias("caption"))
    known = images.join(distinct, "sha256", "left")
    missing = images.filter("sha256 is not null").select("sha256").distinct().join(distinct, "sha256", "left_anti")
    return known.select("image_id", "sha256", "caption"), missing


def stage_shares(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """``(stage, n, seconds, share)``: where the time went."""
    total = events.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum(seconds), 6).alias("seconds"))
    return total.withColumn("share", F.round(F.try_divide(F.col("seconds"), F.sum("seconds").over(Window.partitionBy())), 6))


def usable_phrases(phrases: DataFrame) -> DataFrame:
    """Phrases of more than two word characters with a vector that is not zero."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return phrases.filter((word_characters("phrase") > 2) & (norm > 0))
