"""Streams: chart blocks held back per turn, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.charts import ChartFilter
from tessera.operators.mutation import SnapshotStore

_STATE = "pending string, block string, begun boolean, indent string, charts int, dropped int"
_OUT = "turn_id string, seq long, text string, charts int, dropped int, warnings array<string>, ended boolean"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    f = ChartFilter()
    if state.exists:
        f.pending, f.block, f.begun, f.indent, f.charts, f.dropped = state.get
    rows = pd.concat(list(batches)).sort_values("seq")
    out, ended = [], False
    for seq, token, last, sources in zip(rows["seq"], rows["token"], rows["last"], rows["sources"]):
        f.sources, f.warnings = [] if sources is None else list(sources), []
        text = f.feed(token if isinstance(token, str) else "")
        if bool(last):
            text, ended = text + f.finish(), True
        if text or ended:
            out.append((key[0], int(seq), text, f.charts, f.dropped, f.warnings, ended))
        if ended:
            break
    if ended:
        state.remove()
    else:
        state.update(f.state())
    yield pd.DataFrame(out, columns=["turn_id", "seq", "text", "charts", "dropped", "warnings", "ended"])


def filter_charts(tokens: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Stream (turn_id string, seq long, token string, last boolean) with chart blocks checked and written anew.

    ``sources`` (turn_id, sources) has the contents that a turn may cite; charts are held against them. A
    turn's state is a few lines; the row with ``last`` set flushes and removes it. Within a micro-batch
    tokens are put in order of ``seq``.
    """
    none = F.lit(None).cast("array<string>")
    rows = tokens.withColumn("sources", none) if sources is None else tokens.join(sources.select("turn_id", "sources"), "turn_id", "left")
    return rows.groupBy("turn_id").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def split_turns(events: DataFrame) -> DataFrame:
    """``(turn_id, thinking, answer)`` of ended turns from events (turn_id, seq, type, text)."""
    def said(kind: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("seq", "text")))), lambda x: x["text"]), "")

    return events.groupBy("turn_id").agg(said("thinking").alias("thinking"), said("answer").alias("answer"), F.max(F.col("type") == "done").alias("ended")).filter("ended").drop("ended")


def ingest_stream(source: DataFrame, store: SnapshotStore, checkpoint: str, name: str = "chunks"):
    """Start a query that replaces each arriving file in the store, then stops when nothing is left; resumable by its checkpoint.

    Only the buckets of files that arrive are written anew; :meth:`SnapshotStore.read_buckets` reads the table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            store.replace_files(name, kept)
        finally:
            kept.unpersist()

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``(start, event_type, events, value)`` over event time, late rows up to ``late`` counted."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def progress(finished: DataFrame) -> DataFrame:
    """``(job, item, done, total, share)``: how far each job was when an item (job, item, at) was finished; ties go by item."""
    from tessera.operators.ranking import running_offset

    rows = running_offset(finished.select("job", "item", "at"), ["job"], ["at", "item"], F.lit(1), "before")
    total = finished.groupBy("job").agg(F.count("*").alias("total"))
    return rows.join(total, "job").select("job", "item", (F.col("before") + 1).alias("done"), "total", F.round((F.col("before") + 1) / F.col("total"), 6).alias("share"))


def time_left(finished: DataFrame, planned: int) -> DataFrame:
    """``(stage, done, per_second, seconds_left)`` at the pace so far of items (stage, at), ``planned`` in all."""
    at = F.unix_micros(F.col("at").cast("timestamp")) / 1e6
    rows = finished.groupBy("stage").agg(F.count("*").alias("done"), (F.max(at) - F.min(at)).alias("seconds"))
    pace = F.round(F.try_divide("done", F.nullif(F.col("seconds"), F.lit(0.0))), 6)
    return rows.select("stage", "done", pace.alias("per_second"), F.round(F.greatest(F.lit(planned) - F.col("done"), F.lit(0)) * F.col("seconds") / F.col("done"), 3).alias("seconds_left"))
