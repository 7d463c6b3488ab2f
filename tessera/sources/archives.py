"""Zip archives as a Spark data source, resumable checkpoints and the event-stream text format."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.extract import SUFFIXES


def skip_reason(name: str) -> str | None:
    """Why an entry is not read, or None."""
    base = name.rsplit("/", 1)[-1]
    if name.endswith("/"):
        return "folder"
    if name.startswith("__MACOSX/") or "/__MACOSX/" in name or base == ".DS_Store":
        return "system file"
    if base.startswith("~$"):
        return "lock file"
    return None if base.rpartition(".")[2].lower() in SUFFIXES else "unsupported type"


class ZipSource(DataSource):
    """``spark.read.format("zip_entries").load(folder)`` for archives in a folder that all executors mount.

    Option ``content`` ("true") reads the entries too, one at a time; without it only central
    directories are read. A large archive is cut into partitions of ``entries`` (500) entries. Archives on
    other storage are read by :func:`unzip`.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, entry string, size long, skipped string, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content, self.entries = options.get("path", ""), options.get("content", "false") == "true", int(options.get("entries", "500"))

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            names = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.lower().endswith(".zip"))
        else:
            names = [self.path]
        out = []
        for n in names:
            with zipfile.ZipFile(n) as z:
                size = len(z.infolist())
            out += [InputPartition((n, at)) for at in range(0, max(size, 1), self.entries)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, at = partition.value
        with zipfile.ZipFile(name) as z:
            for info in z.infolist()[at : at + self.entries]:
                reason = skip_reason(info.filename)
                yield name, info.filename, info.file_size, reason, z.read(info) if self.content and reason is None else None


def unzip(archives: DataFrame) -> DataFrame:
    """The entries of ``archives`` (archive, data), as :class:`ZipSource` gives them, from any storage that Spark reads binary files of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "entry", "size", "skipped", "data"]
        for b in batches:
            for name, data in zip(b.archive, b["data"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        for info in z.infolist():
                            reason = skip_reason(info.filename)
                            yield pd.DataFrame([(name, info.filename, info.file_size, reason, None if reason else z.read(info))], columns=columns)
                except (zipfile.BadZipFile, TypeError):
                    yield pd.DataFrame([(name, None, None, "damaged archive", None)], columns=columns)

    return archives.select("archive", "data").mapInPandas(run, "archive string, entry string, size long, skipped string, data binary")


def zip_plan(entries: DataFrame, done: DataFrame | None = None, include: list[str] | None = None, exclude: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entries to read: not skipped, with the wanted parts in their name, not in the checkpoint, the first ``limit``."""
    rows = entries.filter("skipped is null")
    for part in include or []:
        rows = rows.filter(F.contains(F.lower("entry"), F.lit(part.lower())))
    for part in exclude or []:
        rows = rows.filter(~F.contains(F.lower("entry"), F.lit(part.lower())))
    if done is not None:
        rows = rows.join(done.select("archive", "entry").distinct(), ["archive", "entry"], "left_anti")
    return rows.orderBy("archive", "entry").limit(limit) if limit is not None else rows


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """Add (archive, entry, status, detail) as JSON lines."""
    rows.select("archive", "entry", "status", "detail").write.mode("append").json(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The latest checkpoint, empty if there is none; errors may be tried again and are left out."""
    schema = "archive string, entry string, status string, detail string"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).filter("status in ('done', 'duplicate')").select("archive", "entry").distinct()


def sse_encode(event: str, data: object) -> str:
    """One server-sent event; a value of several lines gets a prefix a line."""
    text = data if isinstance(data, str) else json.dumps(data, ensure_ascii=False)
    return f"event: {event}\n" + "".join(f"data: {line}\n" for line in text.split("\n")) + "\n"


def sse_decode(text: str) -> list[tuple[str, str]]:
    out = []
    for block in text.replace("\r\n", "\n").split("\n\n"):
        event, data = "message", []
        for line in block.split("\n"):
            if line.startswith("event:"):
                event = line[6:].strip()
            elif line.startswith("data:"):
                data.append(line[5:].removeprefix(" "))
        if data:
            out.append((event, "\n".join(data)))
    return out


def assemble_calls(fragments: DataFrame) -> DataFrame:
    """``(turn_id, call_index, call_id, name, arguments)`` from a stream's fragments (turn_id, seq, call_index, call_id, name, arguments)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a"))))
    return fragments.groupBy("turn_id", "call_index").agg(
        F.min_by("call_id", F.when(F.col("call_id").isNotNull(), F.col("seq"))).alias("call_id"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"),
        F.array_join(F.transform(ordered, lambda x: x["a"]), "").alias("arguments"),
    )
