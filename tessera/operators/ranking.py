"""Running totals and ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import parallelism, written


def running_offset(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group, 0 for the first.

    Rows are range-partitioned by group and order, so one group with most of the rows is spread over
    many tasks; each task sums its share, and the shares' totals (one row per group and partition)
    give the offsets. ``order`` must order the rows of a group totally. Null keys form one group;
    nulls in ``order`` come first. An empty table stays empty.
    """
    n = parts or parallelism(df.sparkSession)
    cut = df.withColumn("_value", value.cast("long")).repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id())
    cut = written(cut, "ranges")  # the partition number must not change when a task is run again
    share = Window.partitionBy("_part", *keys).orderBy(*order)
    inner = cut.withColumn("_inner", F.sum("_value").over(share.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_part", *keys).agg(F.sum("_value").alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    right = totals.select("_part", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before").withColumnRenamed("_part", "_p")
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = inner.join(right, on).withColumn(out, F.col("_inner") + F.col("_before"))
    return joined.select(*df.columns, out)
