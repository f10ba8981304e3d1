"""Incremental refresh: new pages arrive as a stream, changed organisations are redone.

State lies in buckets by a hash of the organisation.  A batch reads and rewrites
only the buckets that its pages fall into, as ``<table>/epoch=<batch>/bucket=<n>``;
``index`` names the batches' buckets and is written last.  So a batch costs as
much as the buckets it touches hold, however many batches came before (of those
it reads the index alone, at most ``buckets`` short rows each), an unfinished
batch is invisible, and a repeated one replaces itself.  Versions the index no
longer names last may be deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetteer.operators.order import first_per
from gazetteer.sources.files import read_or_empty

PAGES = "provider string, url string, text string, _ord bigint, content string, bucket int"
BUCKETS = 64


def _index(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, f"{out}/index", "bucket int, epoch bigint")


def _state(spark: SparkSession, out: str, table: str, schema: str, newest: dict[int, int]) -> DataFrame:
    """The named buckets of a table, each as its newest batch left it."""
    if not newest:
        return spark.createDataFrame([], schema)
    paths = [f"{out}/{table}/epoch={e}" for e in sorted(set(newest.values()))]
    wanted = F.concat_ws("/", "epoch", "bucket").isin([f"{e}/{b}" for b, e in newest.items()])  # prunes folders
    rows = spark.read.schema(f"{schema}, epoch bigint").option("basePath", f"{out}/{table}").parquet(*paths)
    return rows.where(wanted).drop("epoch")


def _newest(index: DataFrame) -> dict[int, int]:
    """Batch that wrote each bucket last; as many entries as there are buckets."""
    return {r["bucket"]: r["epoch"] for r in index.groupBy("bucket").agg(F.max("epoch").alias("epoch")).collect()}


def _written(df: DataFrame, path: str, schema: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def refresh_batch(
    pages: DataFrame, epoch: int, out: str, extract: Callable[[DataFrame], DataFrame], facts_schema: str,
    buckets: int = BUCKETS,
) -> None:
    """One micro-batch: pages with new content, then the facts of their organisations.

    Of several rows of one page the last by ``_ord`` counts; rows without an
    organisation or a URL are left out.  ``buckets`` must stay the same for one ``out``.
    """
    spark = pages.sparkSession
    facts_schema = f"{facts_schema}, bucket int"
    bucket = F.pmod(F.xxhash64("provider"), F.lit(buckets)).cast("int").alias("bucket")
    arrived = first_per(pages.where("provider IS NOT NULL AND url IS NOT NULL"), ["provider", "url"], F.desc("_ord"))
    arrived = _written(
        arrived.select("provider", "url", "text", "_ord", F.sha2("text", 256).alias("content"), bucket),
        f"{out}/arrived/epoch={epoch}", PAGES)
    met = {r["bucket"] for r in arrived.select("bucket").distinct().collect()}  # at most ``buckets``
    newest = {b: e for b, e in _newest(_index(spark, out).where(F.col("epoch") < epoch)).items() if b in met}
    known = _state(spark, out, "pages", PAGES, newest)
    same = known.select("provider", "url", F.col("content").alias("_content"), F.lit(True).alias("_known"))
    changed = _written(
        arrived.join(same, ["provider", "url"], "left")
        .where(F.col("_known").isNull() | ~F.col("content").eqNullSafe(F.col("_content")))
        .drop("_content", "_known"),
        f"{out}/changed/epoch={epoch}", PAGES)
    redone = {r["bucket"] for r in changed.select("bucket").distinct().collect()}
    newest = {b: e for b, e in newest.items() if b in redone}
    kept = _state(spark, out, "pages", PAGES, newest).join(
        changed.select("provider", "url"), ["provider", "url"], "left_anti")
    latest = _written(kept.unionByName(changed), f"{out}/pages/epoch={epoch}", PAGES)
    touched = changed.select("provider").distinct()
    facts = _written(
        extract(latest.drop("bucket").join(touched, "provider", "left_semi")).withColumn("bucket", bucket),
        f"{out}/facts/epoch={epoch}", facts_schema)
    others = _state(spark, out, "current", facts_schema, newest).join(touched, "provider", "left_anti")
    _written(others.unionByName(facts), f"{out}/current/epoch={epoch}", facts_schema)
    spark.createDataFrame([(b,) for b in sorted(redone)], "bucket int").coalesce(1).write.mode(
        "overwrite").parquet(f"{out}/index/epoch={epoch}")


def refresh(
    stream: DataFrame, out: str, extract: Callable[[DataFrame], DataFrame], facts_schema: str,
    buckets: int = BUCKETS,
):
    """Start the refresh over everything available; returns the streaming query."""
    return (
        stream.writeStream.foreachBatch(
            lambda df, epoch: refresh_batch(df, epoch, out, extract, facts_schema, buckets))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )


def current_facts(spark: SparkSession, out: str, facts_schema: str) -> DataFrame:
    """The newest facts of each organisation."""
    return _state(spark, out, "current", f"{facts_schema}, bucket int", _newest(_index(spark, out))).drop("bucket")
