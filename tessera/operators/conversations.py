"""The branching conversation store: paths, lists, turns and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import cursor_encode
from tessera.operators.ranking import running_offset
from tessera.session import written


def backfill_parents(messages: DataFrame) -> DataFrame:
    """``(message_id, parent_id)``: messages without a parent get the one before in their conversation.

    Rows are numbered over ranges of conversation and time, so a conversation with most of the rows is spread
    over many tasks, and each meets the row numbered before it.
    """
    rows = messages.filter("conversation_id is not null and created_at is not null").select("message_id", "conversation_id", "parent_id", "created_at")
    placed = written(running_offset(rows, ["conversation_id"], ["created_at", "message_id"], F.lit(1), "place"), "placed")
    before = placed.select("conversation_id", (F.col("place") + 1).alias("place"), F.col("message_id").alias("before"))
    return placed.join(before, ["conversation_id", "place"], "left").select("message_id", F.coalesce("parent_id", "before").alias("parent_id"))


def active_leaves(messages: DataFrame) -> DataFrame:
    """``(conversation_id, active_id)``: the latest message of each conversation."""
    rows = messages.filter("conversation_id is not null and created_at is not null")
    return rows.groupBy("conversation_id").agg(F.max(F.struct("created_at", "message_id"))["message_id"].alias("active_id"))


def paths_to_root(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(leaf_id, message_id, depth)`` from each leaf up to its root, all leaves at once.

    Paths double: each round joins the pointers with themselves, so a path of n messages takes about
    log2(n) rounds, whatever its length. Missing parents end a path; on a cycle it ends once round, and each
    message has its least depth.
    """
    parent = messages.select("message_id", "parent_id").filter("message_id is not null").groupBy("message_id").agg(F.max("parent_id").alias("parent_id"))
    known = parent.select(F.col("message_id").alias("parent_id"))
    hop = written(parent.filter("parent_id is not null and parent_id != message_id").join(known, "parent_id", "left_semi").select("message_id", "parent_id"), "hops")
    reached = leaves.select(F.col("message_id").alias("leaf_id"), "message_id", F.lit(0).cast("long").alias("depth")).distinct()
    length, size = 1, -1
    while True:
        far = reached.join(hop, "message_id").select("leaf_id", F.col("parent_id").alias("message_id"), (F.col("depth") + length).alias("depth"))
        reached = written(reached.unionByName(far).groupBy("leaf_id", "message_id").agg(F.min("depth").alias("depth")), "paths")
        now = reached.count()
        if now == size:  # nothing new was reached, on cycles either
            return reached
        size = now
        hop = written(hop.select("message_id", F.col("parent_id").alias("m")).join(hop.select(F.col("message_id").alias("m"), "parent_id"), "m").select("message_id", "parent_id"), "hops")
        length *= 2


def list_conversations(messages: DataFrame, limit: int, after: tuple[str, int] | None = None, search: str | None = None) -> DataFrame:
    """One page ``(conversation_id, updated_at, title, cursor)``, latest first, with a row more if there is a next page.

    ``after`` is the last row's time and id. The title is the first question. Conversations without a
    user message do not come; ``search`` keeps those in which one holds the text, taken literally.
    """
    rows = messages.filter("conversation_id is not null and created_at is not null")
    asked = rows.filter(F.lower(F.trim("role")).isin("user", "human") & F.col("content").isNotNull())
    title = asked.groupBy("conversation_id").agg(F.min(F.struct("created_at", "message_id", "content"))["content"].alias("title"))
    page = rows.groupBy("conversation_id").agg(F.max("created_at").alias("updated_at")).join(title, "conversation_id")
    if search:
        hit = asked.filter(F.contains(F.lower("content"), F.lit(search.lower()))).select("conversation_id").distinct()
        page = page.join(hit, "conversation_id", "left_semi")
    if after:
        page = page.filter(F.struct("updated_at", "conversation_id") < F.struct(F.lit(after[0]).cast("timestamp"), F.lit(after[1]).cast("long")))
    page = page.orderBy(F.desc("updated_at"), F.desc("conversation_id")).limit(limit + 1)
    return page.withColumn("cursor", cursor_encode("updated_at", "conversation_id"))


def rename(conversations: DataFrame, conversation_id: int, title: str, owner: str | None = None) -> DataFrame:
    """New snapshot with the title set; the time of the last change stays. Another owner's row is not touched."""
    mine: Column = F.col("conversation_id") == conversation_id
    if owner is not None:
        mine = mine & (F.col("owner_id") == owner)
    return conversations.withColumn("title", F.when(mine, F.lit(title)).otherwise(F.col("title")))


def rename_all(conversations: DataFrame, wanted: DataFrame) -> DataFrame:
    """New snapshot after the renamings of ``wanted`` (conversation_id, owner_id, title); those of other owners change nothing."""
    new = wanted.groupBy("conversation_id", "owner_id").agg(F.max("title").alias("_new"))
    return conversations.join(new, ["conversation_id", "owner_id"], "left").withColumn("title", F.coalesce("_new", "title")).drop("_new")


def exists_for(asked: DataFrame, conversations: DataFrame, owner: str) -> DataFrame:
    """``asked`` (conversation_id, ...) with ``mine``: whether the conversation is there and of this owner."""
    own = conversations.filter(F.col("owner_id") == owner).select("conversation_id").distinct().withColumn("_mine", F.lit(True))
    return asked.join(own, "conversation_id", "left").withColumn("mine", F.coalesce("_mine", F.lit(False))).drop("_mine")


def append_turn(messages: DataFrame, conversations: DataFrame, turn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, conversations) after turns (conversation_id, question_id, answer_id, parent, question, answer, created_at).

    ``parent`` null means the active leaf, -1 the root, another id a fork from there.
    """
    located = turn.join(conversations.select("conversation_id", "active_id"), "conversation_id", "left")
    start = F.when(F.col("parent").isNull(), F.col("active_id")).when(F.col("parent") == -1, F.lit(None)).otherwise(F.col("parent"))
    asked = located.select(F.col("question_id").alias("message_id"), "conversation_id", start.cast("long").alias("parent_id"), F.lit("user").alias("role"), F.col("question").alias("content"), "created_at")
    told = located.select(F.col("answer_id").alias("message_id"), "conversation_id", F.col("question_id").alias("parent_id"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), "created_at")
    leaf = turn.groupBy("conversation_id").agg(F.max(F.struct("created_at", "answer_id")).alias("l"))
    updated = conversations.join(leaf, "conversation_id", "left").withColumn("active_id", F.coalesce("l.answer_id", "active_id")).withColumn("updated_at", F.coalesce("l.created_at", "updated_at")).drop("l")
    return messages.select("message_id", "conversation_id", "parent_id", "role", "content", "created_at").unionByName(asked).unionByName(told), updated


def delete_conversations(messages: DataFrame, conversations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, conversations) without those of ``gone`` (conversation_id, and owner_id: then only the owner's own)."""
    keys = [c for c in ("conversation_id", "owner_id") if c in gone.columns]
    lost = conversations.join(gone.select(*keys).distinct(), keys, "left_semi").select("conversation_id").distinct()
    return messages.join(lost, "conversation_id", "left_anti"), conversations.join(lost, "conversation_id", "left_anti")
