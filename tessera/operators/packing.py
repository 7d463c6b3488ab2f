"""Token budgets: cutting, batching, numbering and rendering ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import BROADCAST_ROWS, written


def budget_cut(rows: DataFrame, group: str, order: str, cost: Column, budget: int) -> DataFrame:
    """Rows kept while the running sum of their cost stays within the budget; costs are not negative."""
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(cost).over(running)).filter(F.col("used") <= budget)


def next_fit(rows: DataFrame, group: str, order: str, cost: Column, limit: int, separator: int = 20) -> DataFrame:
    """``(group, order, batch_no)``: items in order, a new batch where the next would not fit; an oversized one stands alone.

    The fold is sequential by nature; it runs over one group's ordered sizes inside the JVM.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), cost.cast("long").alias("c"))))
    item = "struct<o:bigint,b:int>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("batch"), F.lit(None).cast(f"array<{item}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["batch"] >= 0) & (acc["used"] + x["c"] + separator <= limit)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        used = F.when(fits, acc["used"] + x["c"] + separator).otherwise(x["c"] + separator)
        one = F.array(F.struct(x["o"].alias("o"), batch.alias("b")))
        return F.struct(used.cast("long").alias("used"), batch.cast("int").alias("batch"), F.concat(F.coalesce(acc["out"], F.array().cast(f"array<{item}>")), one.cast(f"array<{item}>")).alias("out"))

    folded = rows.groupBy(group).agg(F.aggregate(pairs, start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select(group, F.explode("out").alias("x")).select(group, F.col("x.o").alias(order), (F.col("x.b") + 1).alias("batch_no"))


def number_sources(rows: DataFrame, group: str, order: str, key: Column, offset: int = 0) -> DataFrame:
    """Adds ``number`` from 1 and ``pointer``, true where an equal source was numbered before and is only pointed at.

    Keys may be whole texts; their digests are shuffled.
    """
    keyed = rows.withColumn("_key", F.coalesce(F.unhex(F.sha2(key.cast("string").cast("binary"), 256)), F.lit(b"")))
    first = Window.partitionBy(group, "_key").orderBy(order)
    marked = keyed.withColumn("_first", F.first(order).over(first))
    numbered = marked.withColumn("number", F.dense_rank().over(Window.partitionBy(group).orderBy("_first", "_key")) + offset)
    return numbered.withColumn("pointer", F.col(order) != F.col("_first")).drop("_key", "_first")


def _pointer_line() -> Column:
    return F.format_string("[%d] (same passage as [%d] above)", "number", "number")


def place_within(rows: DataFrame, group: str, order: str, key: Column, length: Column, offset: int = 0, separator: int = 3) -> DataFrame:
    """Adds ``number``, ``pointer``, ``place`` from 1 and ``used``, the tokens up to and with this line, for texts of ``length``
    characters, which need not be there."""
    marked = number_sources(rows.withColumn("_length", length), group, order, key, offset)
    chars = F.when(F.col("pointer"), F.length(_pointer_line())).otherwise(F.length(F.format_string("[%d] ", "number")) + F.coalesce("_length", F.lit(0)))
    cost = F.floor(chars / 1.5) + 1 + separator
    running = Window.partitionBy(group).orderBy(order)
    placed = marked.withColumn("used", F.sum(cost).over(running.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(running))
    return placed.drop("_length")


def fitting_lines(placed: DataFrame, group: str, room: int, texts: DataFrame, on: str) -> DataFrame:
    """``(group, place, number, pointer, line)`` of :func:`place_within`: only what fits in ``room`` tokens is given its text, from ``texts`` (on, text)."""
    placed = written(placed.select(group, on, "place", "number", "pointer", "used"), "placed")
    kept = placed.filter(F.col("used") <= room)
    few = kept.count() <= BROADCAST_ROWS
    kept = texts.join(F.broadcast(kept), on, "right") if few else kept.join(texts, on, "left")
    return _lines(kept, placed, group, room)


def _lines(kept: DataFrame, placed: DataFrame, group: str, room: int) -> DataFrame:
    line = F.when(F.col("pointer"), _pointer_line()).otherwise(F.concat(F.format_string("[%d] ", "number"), F.coalesce("text", F.lit(""))))
    rest = placed.filter(F.col("used") > room).groupBy(group).agg(F.count("*").alias("n"), F.min("place").alias("place"))
    notice = rest.select(group, "place", F.lit(None).cast("int").alias("number"), F.lit(None).cast("boolean").alias("pointer"), F.format_string("(%d more results did not fit and were left out.)", "n").alias("line"))
    return kept.select(group, "place", "number", "pointer", line.alias("line")).unionByName(notice)


def number_within(rows: DataFrame, group: str, order: str, key: Column, text: Column, room: int, offset: int = 0, separator: int = 3) -> DataFrame:
    """``(group, place, number, pointer, line)``: numbered results as a model reads them, as many whole ones as fit in ``room`` tokens.

    A source seen before comes as a line that points at its number. Each line costs its tokens and a
    separator. What is left out is said in a last line, without number. For rows that hold their texts; where many
    groups have the same text, :func:`place_within` and :func:`fitting_lines` give the same lines and move it last.
    """
    placed = place_within(rows.withColumn("text", text), group, order, key, F.length("text"), offset, separator)
    return _lines(placed.filter(F.col("used") <= room), placed, group, room)


def spread_sample(chunks: DataFrame, slots: int = 40) -> DataFrame:
    """``(filename, chunk_id, place)``: the text chunks that a summary is written from.

    All of them but for spreadsheets of more than ``slots``: of these the first of each sheet (page), however many,
    and an even spread of the rest over the slots that are left.
    """
    text = chunks.filter("source_type = 'text'").select("filename", "chunk_id", "chunk_index", "page_number", (F.col("source_format") == "xlsx").alias("sheet"))
    sizes = text.groupBy("filename").agg(F.count("*").alias("n"), F.count_distinct(F.struct("page_number")).alias("heads"), F.max("sheet").alias("sheet"))
    big = sizes.filter((F.col("n") > slots) & F.col("sheet"))
    cols = ["filename", "chunk_id", "chunk_index"]
    small = text.join(big, "filename", "left_anti").select(cols)
    page = Window.partitionBy("filename", "page_number").orderBy("chunk_index", "chunk_id")
    rows = text.drop("sheet").join(big.select("filename", "n", "heads"), "filename").withColumn("first", F.row_number().over(page) == 1)
    whole = Window.partitionBy("filename").orderBy("chunk_index", "chunk_id")
    rest = rows.filter("not first").withColumn("i", F.row_number().over(whole) - 1)
    left = F.greatest(F.lit(slots) - F.col("heads"), F.lit(0))
    spread = big.filter((F.col("n") > F.col("heads")) & (left > 0)).select("filename", F.explode(F.sequence(F.lit(0).cast("long"), left.cast("long") - 1)).alias("k"), ((F.col("n") - F.col("heads")) / left).alias("step"))
    even = rest.join(spread.select("filename", F.floor(F.col("k") * F.col("step")).cast("int").alias("i")).distinct(), ["filename", "i"])
    every = small.unionByName(rows.filter("first").select(cols)).unionByName(even.select(cols))
    return every.withColumn("place", F.row_number().over(whole)).select("filename", "chunk_id", "place")


def render_notes(notes: DataFrame, budget: int) -> DataFrame:
    """``(query_id, number, filename, notes, used, block)``: notes as a model reads them, file by file, cut to ``budget`` tokens.

    ``notes`` has (query_id, note_no, filename, excerpt, label, claim, position). Files with most notes come
    first, of equals the one named first; within a file notes go by position. An excerpt is numbered from 1 by
    its first use in that order. Files from the first that does not fit on fall away.
    """
    files = notes.groupBy("query_id", "filename").agg(F.count("*").alias("notes"), F.min("note_no").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("notes"), "first", "filename")
    ranked = files.withColumn("number", F.row_number().over(order)).drop("first")
    rows = notes.join(ranked, ["query_id", "filename"])
    reading = F.struct("number", "position", "note_no")
    first_use = rows.groupBy("query_id", "filename", "excerpt").agg(F.min(reading).alias("use"))
    cited = first_use.withColumn("cite", F.row_number().over(Window.partitionBy("query_id").orderBy("use", "excerpt"))).drop("use")
    line = F.concat(F.lit("- ["), F.col("cite").cast("string"), F.lit("] ("), F.coalesce("label", F.lit("text")), F.lit(") "), F.coalesce("claim", F.lit("")))
    blocks = rows.join(cited, ["query_id", "filename", "excerpt"]).groupBy("query_id", "number", "filename", "notes").agg(F.array_sort(F.collect_list(F.struct("position", "note_no", line.alias("line")))).alias("rows"))
    blocks = blocks.withColumn("block", F.concat(F.lit("## "), F.col("filename"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))).drop("rows")
    so_far = Window.partitionBy("query_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    cut = blocks.withColumn("used", F.sum(F.floor(F.length("block") / 1.5) + 1).over(so_far)).filter(F.col("used") <= budget)
    return cut.select("query_id", "number", "filename", "notes", "used", "block")
