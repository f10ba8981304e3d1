"""Cached, budgeted enrichment: what was answered is never asked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.operators.order import first_per, global_rank
from gazetteer.session import cut_lineage


def cache_key(columns: list[str]) -> Column:
    """Content address of a request."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def apply_budget(
    todo: DataFrame, order: str = "_ord", max_calls: int = vocab.CALL_BUDGET,
    per_minute: int = vocab.CALLS_PER_MINUTE,
) -> DataFrame:
    """Number the calls and give each its minute; past the budget ``slot`` is null."""
    ranked = global_rank(todo, order, "call_no")
    return ranked.withColumn("slot", F.when(
        F.col("call_no") <= max_calls, F.floor((F.col("call_no") - 1) / per_minute)))


def cached_enrich(
    todo: DataFrame, cache: DataFrame, key_columns: list[str],
    produce: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], Column],
) -> tuple[DataFrame, DataFrame]:
    """Answers for every request, and the new entries worth storing.

    ``cache`` has ``key``, ``stored_at`` and the value columns.  The keep rule
    judges entries when read and when written, so an entry it would not store
    today counts as a miss.  Each distinct request is produced once, by its
    first row: the produced rows are stored before both results read them.
    """
    asked = todo.withColumn("key", cache_key(key_columns))
    usable = first_per(cache.where(keep(cache)), ["key"], F.desc("stored_at"))
    values = [c for c in usable.columns if c not in ("key", "stored_at")]
    order = ["_ord"] if "_ord" in asked.columns else key_columns
    misses = first_per(asked.join(usable, "key", "left_anti"), ["key"], *[F.col(c) for c in order])
    produced = cut_lineage(produce(misses).select("key", *values))
    answers = usable.select("key", *values, F.lit(True).alias("from_cache")).unionByName(
        produced.withColumn("from_cache", F.lit(False)))
    return asked.join(answers, "key"), produced.where(keep(produced))


def score(
    df: DataFrame, fn: Callable, schema: str, cache: DataFrame, key_columns: list[str],
    keep: Callable[[DataFrame], Column], max_calls: int = vocab.CALL_BUDGET,
) -> tuple[DataFrame, DataFrame]:
    """Run a caller's scorer over Arrow batches, behind the cache and the budget.

    ``fn`` maps an iterator of pandas batches; ``schema`` names ``key`` and the
    values.  Rows the budget leaves out get no answer and wait for the next run.
    """
    def produce(misses: DataFrame) -> DataFrame:
        within = apply_budget(misses, max_calls=max_calls).where("slot IS NOT NULL")
        return within.drop("slot", "call_no").mapInPandas(fn, schema)

    return cached_enrich(df, cache, key_columns, produce, keep)
