"""Exact dedup: a two-pass Bloom filter finds possibly repeated hashes; only those rows shuffle.

Pass one hashes every text and counts the hash's cells; cells met twice or more
become bitmaps, at most ``max_bits`` / 8 bytes in all, which are broadcast.
Pass two looks each row's cells up in them.  A row with a cell that no other
row shares is unique and passes straight through.  The others meet by SHA-256,
aggregated within each task first, so a text that a third of all rows share is
a few rows per task; rows of the at most ``HOT_GROUPS`` groups above a
thousandth of all rows learn their group from a broadcast.  A filter that is too small lets more rows shuffle; it
never changes the result.

Defined cases: a null text counts as empty; an empty table gives an empty
table; a null id is smaller than any other; rows equal in text and id count
singly in ``group_size``, ``annotate`` marks all of them as kept when theirs is
the largest id, and ``keep_rows`` returns one of them.  Input columns travel
inside one struct, so their names cannot clash with the columns made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW = 16
MAX_BITS = 1 << 30
LEAST_BITS = 1 << 15
HOT_GROUPS = 1000


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """Cells of the filter: a power of two, sixteen a row or more up to the bound."""
    bits = LEAST_BITS
    while bits < BITS_PER_ROW * rows and bits < max_bits:
        bits *= 2
    return bits


def _cells(hashed: Column, bits: int) -> list[Column]:
    """Two cells from the two halves of a 64-bit hash."""
    return [hashed.bitwiseAND(F.lit(bits - 1).cast("long")),
            F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(bits - 1).cast("long"))]


def repeated_cells(hashes: DataFrame, hashed: str, bits: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the cells that two rows or more have hit."""
    cells = hashes.select(F.explode(F.array(*_cells(F.col(hashed), bits))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))


def _is_set(bitmap: str, cell: str) -> Column:
    """Whether the cell's bit is set in its bitmap; a missing bitmap has none."""
    return F.expr(
        f"coalesce(shiftright(cast(conv(hex(substring({bitmap}, cast(bitmap_bit_position({cell}) div 8 as int) + 1, 1)), 16, 10)"
        f" as int), cast(bitmap_bit_position({cell}) % 8 as int)) & 1, 0) = 1")


def flag_possible(df: DataFrame, hashed: str, out: str, expected_rows: int | None = None,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """Add ``out``: false only where no other row has the same hash."""
    bits = filter_bits(df.count() if expected_rows is None else expected_rows, max_bits)
    bitmaps = F.broadcast(repeated_cells(df.select(hashed), hashed, bits))  # at most bits / 8 bytes
    for i, cell in enumerate(_cells(F.col(hashed), bits)):
        df = df.withColumn(f"_cell{i}", cell)
        one = bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}"))
        df = df.join(one, F.expr(f"bitmap_bucket_number(_cell{i})") == F.col(f"_bucket{i}"), "left")
        df = df.withColumn(f"_set{i}", _is_set(f"_bits{i}", f"_cell{i}")).drop(f"_bucket{i}", f"_bits{i}")
    return df.withColumn(out, F.col("_set0") & F.col("_set1")).drop("_cell0", "_cell1", "_set0", "_set1")


def _prepared(df: DataFrame, text: str, key: str, expected_rows: int | None, max_bits: int) -> DataFrame:
    rows = df.select(
        F.struct("*").alias("row"), F.col(key).alias("_key"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_sha"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    return flag_possible(rows, "_hash", "_maybe", expected_rows, max_bits)


def annotate(df: DataFrame, text: str = "text", key: str = "doc_id", expected_rows: int | None = None,
             max_bits: int = MAX_BITS) -> DataFrame:
    """Every row as ``row``, with keep_id, group_size, kept and text_sha256."""
    expected_rows = df.count() if expected_rows is None else expected_rows
    rows = _prepared(df, text, key, expected_rows, max_bits)
    alone = rows.where("NOT _maybe").select(
        "row", F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    maybe = rows.where("_maybe").select("row", "_key", "_sha")
    groups = maybe.groupBy(F.col("_sha").alias("_group")).agg(
        F.max("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Groups above a share of all rows: at most HOT_GROUPS of them, so their rows need not meet by key.
    large = F.col("group_size") * HOT_GROUPS > expected_rows
    hot = F.broadcast(groups.where(large).withColumnsRenamed({c: f"_hot_{c}" for c in groups.columns}))
    maybe = maybe.join(hot, F.col("_sha") == F.col("_hot__group"), "left")
    out = ["row", "keep_id", "group_size", F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"),
           F.col("_sha").alias("text_sha256")]
    near = maybe.where("_hot__group IS NOT NULL").withColumnsRenamed(
        {"_hot_keep_id": "keep_id", "_hot_group_size": "group_size"}).select(*out)
    met = maybe.where("_hot__group IS NULL").select("row", "_key", "_sha").join(
        groups.where(~large), F.col("_sha") == F.col("_group")).select(*out)
    return alone.unionByName(near).unionByName(met)


def keep_rows(df: DataFrame, text: str = "text", key: str = "doc_id", expected_rows: int | None = None,
              max_bits: int = MAX_BITS) -> DataFrame:
    """One row per distinct text, the one with the largest id, with the input's columns."""
    rows = _prepared(df, text, key, expected_rows, max_bits)
    best = rows.where("_maybe").groupBy("_sha").agg(
        F.max_by("row", F.struct("_key", F.xxhash64("row"))).alias("row"))
    return rows.where("NOT _maybe").select("row").unionByName(best.select("row")).select("row.*")
