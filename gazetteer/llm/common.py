"""Helpers the operators share: batches of bounded size, words, running sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetteer.session import shared_dir

# What separates words, and the words themselves.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, for rows that hold whole texts."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text, as a long; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def bounded(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The texts of a batch with 64-bit offsets; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts as codes into the distinct words, with word offsets per text."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "")
    flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(texts)), out=starts[1:])
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, starts


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array and the byte offset of each text."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]: ends[-1]], ends - ends[0]


def running_start(df: DataFrame, by: list[str], order: list[str], value: str, out: str, rows: int,
                  per_chunk: int = 16384) -> DataFrame:
    """Add the sum of ``value`` over the rows before, within each ``by`` group.

    The order is by hash chunk, then by ``order``, which must tell all rows
    apart.  Chunks keep a group that holds most rows out of a single task: each
    is summed by itself and set off by the totals of the chunks before it.
    """
    chunks = max(1, -(-rows // per_chunk), min(64, -(-rows // 512)))
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    totals = df.groupBy(*by, "_chunk").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_chunk").alias("_of"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)] + [F.col("_chunk") == F.col("_of")]
    joined = df.join(totals, same)
    joined = joined.withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long"))
    return joined.drop("_chunk", "_of", "_offset", "_inside", *[f"_by{i}" for i in range(len(by))])
