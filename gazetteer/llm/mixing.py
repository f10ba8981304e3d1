"""Mixing sources to target weights in fixed-length blocks.

The words of each source, its documents one after another, are packed into
blocks of a fixed length.  Output shards draw how many of their slots go to
each source from a multinomial law; what a source draws beyond its target is
cut and one last shard holds what sources still lack, so totals are exact.
The j-th slot of a source takes block ``permute(j mod blocks)``, with a fresh
pseudorandom permutation for each pass over the source, and slots meet blocks
in an equi join on (source, block).  The last slot of a source is cut to the
words still wanted.  No block is taken more often than passes begin, which the
limit on targets bounds at ``max_repeat``.

Sources weigh ``WEIGHTS``, repeating in code point order with null last, and
share all words; a target stops at ``max_repeat`` times its source's size and
the excess is shared by weight among the rest until none is above.

Only the table of sources (name and size) visits the driver; it grows with the
number of sources, not with documents.  Positions inside a source come from
chunked running sums, so a source with most rows is spread over tasks.

Defined cases: a null text has no words; a null source is a source of its own;
documents without words and empty tables take part with nothing taken; rows
equal in every column are different documents.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetteer.llm.common import running_start, word_count, written
from gazetteer.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
MAX_TASKS = 20_000
SEED = 20240601

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1: a Feistel network, walked until it lands below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = [np.uint64(((key * 4 + r + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)) for r in range(4)]
    x = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> shift, x[todo] & mask
            for r in reversed(rounds) if inverse else rounds:
                if inverse:
                    left, right = right ^ (_scramble(left * _MIX + r) & mask), left
                else:
                    left, right = right, left ^ (_scramble(right * _MIX + r) & mask)
            x[todo] = (left << shift) | right
            todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def targets(sizes: list[int], weights: list[float], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Words each source should give: shares by weight, none above its limit."""
    wanted, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        share = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if share * weights[i] > max_repeat * sizes[i]]
        if not over:
            for i in open_:
                wanted[i] = share * weights[i]
            break
        for i in over:
            wanted[i] = float(max_repeat * sizes[i])
            rest -= wanted[i]
        open_ = [i for i in open_ if i not in set(over)]
    return wanted


class Source:
    """Draw of one source: how many slots, and how many words the last one takes."""

    def __init__(self, index: int, size: int, target: float, block: int, max_repeat: int):
        self.index, self.size, self.block = index, size, block
        self.blocks = -(-size // block)
        words = min(int(target + 0.5), max_repeat * size)
        passes, rest = divmod(words, size) if size else (0, 0)
        self.slots, self.last = passes * self.blocks, block
        if rest:
            tail = size - (self.blocks - 1) * block
            at = int(permute(np.array([self.blocks - 1]), self.blocks, self.key(passes), inverse=True)[0])
            filled = lambda k: k * block - (block - tail if at < k else 0)  # noqa: E731  words of the first k slots
            need = -(-rest // block)
            need += filled(need) < rest
            self.slots += need
            self.last = rest - filled(need - 1)

    def key(self, turn: int) -> int:
        return SEED + 1_000_003 * (self.index + 1) + turn


def _draw(shares: list[float], slots: int, total: int):
    """Per shard: how many of its slots go to each source."""
    p = np.array(shares) / sum(shares)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            drawn = np.stack([np.random.default_rng([SEED, int(k)]).multinomial(min(slots, total - int(k) * slots), p)
                              for k in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(p))), pa.array(np.tile(np.arange(len(p)), len(ids))),
                 pa.array(drawn.ravel())], names=["shard", "src", "n"])

    return draw


def _expand(sources: list[Source]):
    """One row per slot: the block it takes and how many words of it at most."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = sources[row["src"]]
                for low in range(0, row["n"], 1 << 16):
                    i = np.arange(low, min(row["n"], low + (1 << 16)), dtype=np.int64)
                    j = row["start"] + i
                    turn, at = j // of.blocks, j % of.blocks
                    block = np.empty_like(j)
                    for t in np.unique(turn):
                        here = turn == t
                        block[here] = permute(at[here], of.blocks, of.key(int(t)))
                    slot = permute(row["offset"] + i, row["shard_slots"], SEED ^ (row["shard"] + 1))
                    most = np.where(j == of.slots - 1, of.last, of.block)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(j), row["shard"], np.int64)), pa.array(slot),
                         pa.array(np.full(len(j), of.index, np.int64)), pa.array(turn), pa.array(block), pa.array(most)],
                        names=["shard", "slot", "src", "turn", "block", "most"])

    return expand


def plan(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
         block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
         max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """The documents with sizes and targets, and the pieces that the mix takes.

    Documents: row_id, doc_id, source, size, source_size, target.  Pieces:
    shard, slot, turn (pass over the source), block, row_id, first (word of the
    document where the piece starts), words.
    """
    spark = df.sparkSession
    docs = cut_lineage(df.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("doc_id"),
        F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    found = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], max_repeat)
    sources = [Source(i, n, t, block_words, max_repeat) for i, (n, t) in enumerate(zip(sizes, wanted, strict=True))]
    facts = spark.createDataFrame(
        [(r["source"], i, n, t) for i, (r, n, t) in enumerate(zip(found, sizes, wanted, strict=True))],
        "_name string, src long, source_size long, target double")
    docs = docs.join(facts, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")

    total = sum(s.slots for s in sources)
    shards = -(-total // shard_slots)
    drawn = spark.range(shards).mapInArrow(
        _draw([s.slots for s in sources] if total else [1.0], shard_slots, total), "shard long, src long, n long")
    limits = spark.createDataFrame([(s.index, s.slots) for s in sources], "_src long, most long")
    earlier = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    drawn = drawn.join(limits, F.col("src") == F.col("_src")).drop("_src")
    lacking = drawn.groupBy("src").agg(F.sum("n").alias("n"), F.first("most").alias("most")).where("n < most")
    drawn = drawn.withColumn("n", F.greatest(F.lit(0), F.least("n", F.col("most") - F.col("start"))))
    drawn = drawn.select("shard", "src", "n", "start").unionByName(lacking.select(
        F.lit(shards).cast("long").alias("shard"), "src", (F.col("most") - F.col("n")).alias("n"), F.col("n").alias("start")))
    inside = Window.partitionBy("shard").orderBy("src")
    drawn = drawn.where("n > 0").withColumn(
        "offset", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("shard_slots", F.sum("n").over(Window.partitionBy("shard")))
    slots = drawn.repartition(min(shards + 1, MAX_TASKS), "shard").mapInArrow(_expand(sources), "shard long, slot long, src long, turn long, block long, most long")

    rows = sum(r["n"] for r in found)
    placed = running_start(docs.where("size > 0"), ["src"], ["doc_id", "size", "row_id"], "size", "at", rows)
    parts = placed.select("row_id", "src", "at", "size", F.explode(F.sequence(
        F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))).alias("block"))
    low = F.greatest(F.col("at"), F.col("block") * block_words)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    parts = parts.select("row_id", "src", "block", (low - F.col("at")).alias("first"),
                         (low - F.col("block") * block_words).alias("low"),
                         (high - F.col("block") * block_words).alias("high"))
    # a merge join, as slots grow with the input
    pieces = slots.join(parts.hint("merge"), ["src", "block"]).where("low < most")
    pieces = pieces.select("shard", "slot", "turn", "block", "row_id", "first",
                           (F.least("high", "most") - F.col("low")).alias("words"))
    return docs, pieces


def taken(df: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words that the mix takes."""
    docs, pieces = plan(df, **options)
    sums = pieces.groupBy(F.col("row_id").alias("_row")).agg(F.sum("words").alias("taken"))
    return docs.join(sums, F.col("row_id") == F.col("_row"), "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows of the input's columns: one per document, pass and unbroken run of words.

    A run that covers its document carries the text unchanged; a shorter one
    carries its words with the spaces between them.  Other columns are copied.
    """
    numbered = written(df.select(F.monotonically_increasing_id().alias("_id"), F.struct("*").alias("row")))
    docs, pieces = plan(numbered.select("_id", F.col(f"row.`{text}`").alias("text"), F.col(f"row.`{source}`").alias("source")),
                        key="_id", **options)
    pieces = pieces.join(docs.select("row_id", F.col("doc_id").alias("_of"), "size"), "row_id")
    order = Window.partitionBy("row_id", "turn").orderBy("first")
    joined = F.col("first") == F.lag(F.col("first") + F.col("words")).over(order)
    runs = pieces.withColumn("_new", F.when(joined, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(order))
    runs = runs.groupBy("row_id", "turn", "_run").agg(
        F.first("_of").alias("_of"), F.first("size").alias("size"), F.min("first").alias("first"), F.sum("words").alias("words"))
    met = numbered.join(runs, F.col("_id") == F.col("_of"))
    body = F.col(f"row.`{text}`")
    words = F.regexp_extract_all(body, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    part = F.btrim(F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), ""),
                   F.lit(" \t\n\x0b\x0c\r"))
    whole = F.when(F.col("words") == F.col("size"), body).otherwise(part)
    return met.select([whole.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
