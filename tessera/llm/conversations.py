"""Problem 5: rebuild conversations from message rows.

The reply graph of a conversation is sorted topologically with Kahn's algorithm, ties broken by time;
nodes left over lie on a cycle or behind one and break the conversation. Positions by time are counted
by a range-partitioned running total, however long a conversation is. The conversation is then cut into
stretches of bounded length: where no reply crosses a cut backwards, every edge between two stretches
points forward, so each can be sorted on its own, and all of them run through Kahn's algorithm.
A stretch that backward replies make too long for one task is taken apart by joins first: a message
is ready once the latest of its ancestors was placed, which doubling finds in a logarithmic number of
rounds; what waits for one ancestor is a stretch of its own, placed right behind it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.ranking import running_offset
from tessera.session import parallelism, written

USER, UNKNOWN, ASSISTANT = 0, 1, 2
#: Positions between two cuts, and the most messages that one task sorts at once.
CUT, STRETCH = 1_000, 100_000


def speaker(role: Column) -> Column:
    """0 user, 1 unknown, 2 assistant, null for system and tool rows; case and outer white space do not count."""
    name = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (
        F.when(name.isin("user", "human"), USER).when(name.isin("assistant", "bot"), ASSISTANT).when(name.isin("system", "tool"), F.lit(None)).otherwise(UNKNOWN).cast("int")
    )


def turns(messages: DataFrame, *keep: Column) -> DataFrame:
    """``(conversation_id, message_id, parent_id, speaker, created_at, content, ...keep)`` of the rows that take part."""
    return (
        messages.select(
            F.col("conversation_id").cast("long").alias("conversation_id"),
            F.col("message_id").cast("long").alias("message_id"),
            F.col("parent_id").cast("long").alias("parent_id"),
            speaker(F.col("role")).alias("speaker"),
            "created_at",
            "content",
            *keep,
        )
        .filter("conversation_id is not null and speaker is not null")
    )


def kahn_order(ids: list, parents: dict, priority: dict) -> tuple[list, list]:
    """Topological order of ``ids`` with the smallest priority first among the ready, and the nodes left on cycles."""
    inside = set(ids)
    waiting = {i: 0 for i in ids}
    children: dict = {}
    for child in ids:
        for parent in parents.get(child, ()):
            if parent in inside:
                waiting[child] += 1
                children.setdefault(parent, []).append(child)
    ready = [(priority[i], i) for i in ids if not waiting[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, node = heapq.heappop(ready)
        out.append(node)
        for child in children.get(node, ()):
            waiting[child] -= 1
            if not waiting[child]:
                heapq.heappush(ready, (priority[child], child))
    return out, [i for i in ids if waiting[i]]


def _sorted_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kahn's algorithm on each stretch (conversation_id, stretch, message_id, pos, parent); rows come sorted by stretch."""
    now, rows = None, []

    def order_of() -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        order, left = kahn_order(ids, {m: (p,) for m, _, p in rows if p is not None}, {m: at for m, at, _ in rows})
        n = len(rows)
        columns = [pa.array([now[0]] * n, pa.int64()), pa.array(order + left, pa.int64()), pa.array(range(n), pa.int64()), pa.array([False] * len(order) + [True] * len(left), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["conversation_id", "message_id", "place", "cyclic"])

    for batch in batches:
        for conversation, stretch, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (conversation, stretch) != now:
                if rows:
                    yield order_of()
                now, rows = (conversation, stretch), []
            rows.append(row)
    if rows:
        yield order_of()


def _ancestors(nodes: DataFrame) -> DataFrame:
    """(conversation_id, message_id, latest, cyclic): the latest position among the node and its ancestors, by doubling."""
    keys = ["conversation_id", "message_id"]
    state = nodes.select(*keys, F.col("parent").alias("up"), F.col("pos").alias("latest"))
    size = nodes.groupBy("conversation_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(size).bit_length())):
        above = state.select("conversation_id", F.col("message_id").alias("up"), F.col("up").alias("further"), F.col("latest").alias("above"))
        state = state.join(above, ["conversation_id", "up"], "left").select(*keys, F.col("further").alias("up"), F.greatest("latest", F.coalesce("above", "latest")).alias("latest"))
        state = written(state, "ancestors")
    return state.select(*keys, "latest", F.col("up").isNotNull().alias("cyclic"))


def sort_stretches(nodes: DataFrame, most: int = STRETCH) -> DataFrame:
    """``(conversation_id, message_id, key, cyclic)`` of ``nodes`` (conversation_id, stretch, message_id, pos, parent).

    ``key`` (array of numbers) orders the messages of a stretch; those on or behind a cycle come last.
    ``parent`` is null or a message of the same stretch.
    """
    keys = ["conversation_id", "stretch"]
    done: list[DataFrame] = []
    rest = nodes.select(*keys, "message_id", "pos", "parent", F.array().cast("array<long>").alias("prefix"))
    while True:
        sizes = rest.groupBy(*keys).agg((F.count("*") > most).alias("long"))
        rest = written(rest.join(sizes, keys), "stretches")
        short = rest.filter("not long")
        sorted_ = short.select(*keys, "message_id", "pos", "parent").repartition(parallelism(rest.sparkSession), *keys).sortWithinPartitions(*keys)
        sorted_ = sorted_.mapInArrow(_sorted_stretches, "conversation_id long, message_id long, place long, cyclic boolean")
        placed = short.select("conversation_id", "message_id", "prefix").join(sorted_, ["conversation_id", "message_id"])
        done.append(placed.select("conversation_id", "message_id", F.concat("prefix", F.array("place")).alias("key"), "cyclic"))
        long = rest.filter("long").drop("long")
        if long.isEmpty():
            break
        found = long.join(_ancestors(long), ["conversation_id", "message_id"])
        last = F.lit(2**62)
        stays = found.filter(F.col("cyclic") | (F.col("latest") == F.col("pos")))
        key = F.when(F.col("cyclic"), F.array(last, F.col("pos"))).otherwise(F.array(F.col("pos"), F.lit(0).cast("long")))
        done.append(stays.select("conversation_id", "message_id", F.concat("prefix", key).alias("key"), "cyclic"))
        # what waits for one message is a stretch of its own, right behind it
        waits = found.filter(~F.col("cyclic") & (F.col("latest") > F.col("pos")))
        inside = waits.select("conversation_id", F.col("latest").alias("of"), F.col("message_id").alias("parent"))
        waits = waits.withColumn("of", F.col("latest")).join(inside.withColumn("_in", F.lit(True)), ["conversation_id", "of", "parent"], "left")
        prefix = F.concat("prefix", F.array(F.col("latest"), F.lit(1).cast("long")))
        rest = waits.select("conversation_id", F.col("latest").alias("stretch"), "message_id", "pos", F.when(F.col("_in"), F.col("parent")).alias("parent"), prefix.alias("prefix"))
    out = done[0]
    for some in done[1:]:
        out = out.unionByName(some)
    return out


def reply_order(messages: DataFrame, cut: int = CUT, most: int = STRETCH) -> DataFrame:
    """``(conversation_id, message_id, speaker, has_text, pos, cyclic)``, ``pos`` from 0 in reply order.

    Rows without conversation or time and system and tool rows take no part; of rows that agree in
    conversation, speaker, content and time the smallest id stays, and replies to the others count as
    replies to it; of several parents that rows which agree have, the latest counts. A parent that is
    missing or in another conversation is no edge. ``cyclic`` are messages on a cycle of replies or behind
    one; a message that replies to itself lies on a cycle.
    """
    text = F.coalesce(F.col("content").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("has_text")
    prints = [F.xxhash64("content").alias("c1"), F.hash("content").alias("c2"), F.length("content").alias("c3"), F.col("content").isNull().alias("c4")]
    rows = written(turns(messages, text, *prints).drop("content").filter("created_at is not null"), "turns")
    same = ["conversation_id", "speaker", "created_at", "c1", "c2", "c3", "c4"]
    kept = rows.groupBy(*same).agg(F.min("message_id").alias("message_id"), F.max("has_text").alias("has_text"))
    placed = written(running_offset(kept.select("conversation_id", "speaker", "created_at", "message_id", "has_text"), ["conversation_id"], ["created_at", "speaker", "message_id"], F.lit(1), "pos"), "placed")

    # replies, with both ends moved to the row that stayed
    holder = kept.select(*(F.col(c).alias(f"kept_{c}") for c in same), F.col("message_id").alias("kept_id"))
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    alias = rows.join(holder, agree).select("conversation_id", "message_id", "parent_id", "kept_id")
    alias = written(alias.distinct(), "alias")
    to = alias.select("conversation_id", F.col("message_id").alias("parent_id"), F.col("kept_id").alias("parent")).distinct()
    edges = alias.filter("parent_id is not null").join(to, ["conversation_id", "parent_id"]).select("conversation_id", F.col("kept_id").alias("message_id"), "parent").distinct()
    parents = edges.join(placed.select("conversation_id", F.col("message_id").alias("parent"), F.col("pos").alias("parent_pos")), ["conversation_id", "parent"])
    parents = parents.groupBy("conversation_id", "message_id").agg(F.max_by("parent", "parent_pos").alias("parent"), F.max("parent_pos").alias("parent_pos"))
    nodes = written(placed.select("conversation_id", "message_id", "pos").join(parents, ["conversation_id", "message_id"], "left"), "nodes")

    # cuts that a reply crosses backwards are none; one row for each cut at most
    block = lambda c: F.floor(F.col(c) / cut)
    back = nodes.filter("parent_pos > pos").groupBy("conversation_id", block("pos").alias("lo")).agg(F.max(block("parent_pos")).alias("hi")).filter("hi > lo")
    in_time = Window.partitionBy("conversation_id").orderBy("lo")
    reach = F.max("hi").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    islands = back.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), F.col("lo"))).withColumn("first", F.max("new").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("conversation_id", "first").agg(F.max("hi").alias("hi")).select("conversation_id", "first", F.explode(F.sequence("first", "hi")).alias("block"))
    blocks = nodes.withColumn("block", block("pos")).join(islands, ["conversation_id", "block"], "left")
    start = (F.coalesce("first", "block") * cut).alias("stretch")
    blocks = blocks.select("conversation_id", start, "message_id", "pos", "parent", "parent_pos")
    blocks = blocks.withColumn("parent", F.when(F.col("parent_pos") >= F.col("stretch"), F.col("parent"))).drop("parent_pos")
    keys = sort_stretches(blocks, most)
    keyed = blocks.select("conversation_id", "stretch", "message_id").join(keys, ["conversation_id", "message_id"])
    if nodes.filter("parent_pos >= pos").isEmpty():  # stretches are whole blocks, and a key is the place in its stretch
        keyed = keyed.withColumn("new_pos", F.col("stretch") + F.col("key")[0])
    else:
        keyed = written(running_offset(keyed, ["conversation_id"], ["stretch", "key"], F.lit(1), "new_pos"), "keyed")
        broken = keyed.filter("cyclic").select("conversation_id").distinct()
        if not broken.isEmpty():  # what comes behind a cycle may lie in later stretches
            behind = _ancestors(nodes.join(broken, "conversation_id", "left_semi")).select("conversation_id", "message_id", F.col("cyclic").alias("behind"))
            keyed = keyed.join(behind, ["conversation_id", "message_id"], "left").withColumn("cyclic", F.coalesce("behind", "cyclic")).drop("behind")
    return placed.drop("pos").join(keyed.select("conversation_id", "message_id", F.col("new_pos").alias("pos"), "cyclic"), ["conversation_id", "message_id"])


def cyclic_messages(messages: DataFrame) -> DataFrame:
    """``(conversation_id, message_id)`` of the messages that Kahn's algorithm leaves over; see :func:`reply_order`."""
    return reply_order(messages).filter("cyclic").select("conversation_id", "message_id")


def whole_conversations(messages: DataFrame) -> DataFrame:
    """``(conversation_id, turn_no, message_id)`` of conversations that alternate from a user to a last assistant turn.

    Dropped are conversations with a row without time, an unknown speaker, a content without letter or
    digit (null and empty included), a cycle of replies, or a turn out of place. Extra columns are not
    read; an empty table gives no rows.
    """
    ordered = written(reply_order(messages), "ordered")
    in_place = ((F.col("speaker") == USER) & (F.col("pos") % 2 == 0)) | ((F.col("speaker") == ASSISTANT) & (F.col("pos") % 2 == 1))
    good = ordered.groupBy("conversation_id").agg(F.min(in_place & F.col("has_text") & ~F.col("cyclic")).alias("ok"), F.count("*").alias("n")).filter("ok and n % 2 = 0")
    timeless = turns(messages).filter("created_at is null").select("conversation_id").distinct()
    good = good.join(timeless, "conversation_id", "left_anti").select("conversation_id")
    return ordered.join(good, "conversation_id", "left_semi").select("conversation_id", (F.col("pos") + 1).cast("int").alias("turn_no"), "message_id")
