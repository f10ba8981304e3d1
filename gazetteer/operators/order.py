"""Ordered work per group that never needs a whole group in one task.

* The first row or the top k of a group use ``row_number() <= k``, which Spark
  plans with a ``WindowGroupLimit`` before the shuffle: each task passes on at
  most k rows of a group, however large the group is.
* A full rank or running sum splits every group into buckets of its order
  column.  Buckets are ranked on their own, bucket totals (one row per bucket)
  give the offsets, and one equi join puts the two together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetteer.session import cut_lineage

BUCKET = 100_000


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per group: the first by ``order``."""
    return top_per(df, keys, list(order), 1).drop("_rn")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``_rn``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)


def cap_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, reason: str, out: str = "reason"
) -> DataFrame:
    """Mark every row past the first ``k`` of its group with a reason.

    ``order`` columns must ascend.  The k-th order value of each group is its
    limit; comparing rows with that one value per group avoids ranking the rest.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    marked = df.withColumn("_place", place)
    limits = (
        top_per(marked.select(*keys, "_place"), keys, [F.col("_place")], k)
        .groupBy(*keys)
        .agg(F.max("_place").alias("_limit"))
    )
    limits = limits.withColumnsRenamed({key: f"_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    joined = marked.join(limits, same, "left")
    past = F.col("_place") > F.col("_limit")
    return joined.withColumn(out, F.when(past, F.lit(reason))).drop(
        "_place", "_limit", *[f"_{key}" for key in keys]
    )


def _offsets(totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str = "running",
    bucket: int = BUCKET,
) -> DataFrame:
    """Sum of ``value`` over the rows of the group before this one, plus its own.

    ``order`` is a long column without ties inside a group; keys are not null.
    """
    df = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket))).withColumn("_value", value)
    totals = df.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    offsets = _offsets(totals, keys, "_total").drop("_total")
    local = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        df.withColumn("_local", F.sum("_value").over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_value", "_local", "_before")
    )


def exact_rank(
    df: DataFrame, keys: list[str], order: str, out: str = "rank", bucket: int = BUCKET
) -> DataFrame:
    """``row_number`` of every row of every group, 1-based."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, bucket)


def global_rank(df: DataFrame, order: str, out: str = "rank", bucket: int = BUCKET) -> DataFrame:
    """``row_number`` over a whole table, by ranges of about ``bucket`` rows.

    Ranges come from the values themselves, so sparse, hashed or crowded numbers
    fill them alike; only one total a range meets in one task.  The ranged rows
    are stored, which fixes the ranges for both passes over them.
    """
    ranges = max(1, -(-df.count() // bucket))
    ranged = cut_lineage(df.repartitionByRange(ranges, order).withColumn("_bucket", F.spark_partition_id().cast("bigint")))
    totals = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_total"))
    before = _offsets(totals.withColumn("_all", F.lit(0)), ["_all"], "_total").select("_bucket", "_before")
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    return ranged.withColumn("_local", local).join(before, "_bucket").withColumn(
        out, F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def cap_with_total(
    df: DataFrame, keys: list[str], order: list[Column], n: int, total: str = "total"
) -> DataFrame:
    """The first ``n`` rows of each group, each with the full group size."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    return top_per(df, keys, order, n).join(totals, keys)


def union_in_order(sources: list[DataFrame], keys: list[str], item: str, position: str) -> DataFrame:
    """Union of sources, earlier sources first, each item once per group."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    everything = reduce(lambda a, b: a.unionByName(b), ranked)
    return first_per(everything, [*keys, item], F.col("source_rank"), F.col(position))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")
