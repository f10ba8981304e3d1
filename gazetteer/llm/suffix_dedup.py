"""Suffix-array dedup: longest-previous-factor arrays over strings that share an anchor.

Finds every byte covered by a string of ``LENGTH`` bytes that starts more than
once, inside documents, over all documents.

Anchors: each such string holds the position whose 64-byte hash is the
smallest in it (the leftmost among equals), which depends on the string's bytes
alone.  A document is thereby cut into items: an anchor, the consecutive starts
of strings that share it, and the bytes those strings cover (the context).
Equal strings lie in items with equal anchor hashes.

1. Anchor hashes are counted, with the least and greatest hash of a context.
   Hashes met twice or more become a bitmap of at most ``MAX_BITS`` bits; so do
   those with different contexts.  A bitmap that is too small lets more items
   through, which the joins and counts of later steps remove.
2. A second pass stores, once, the items whose anchor may be repeated; where
   its contexts may differ, one item of each context and batch brings the bytes.
   Where all contexts of an anchor are equal, every string in them repeats.
3. Other contexts, once each, are suffix-sorted together per anchor (ranks of
   doubled lengths up to LENGTH).  Previous and next smaller positions in suffix
   order give each string's earlier matches, and mirrored its later ones.
   Anchors with more than ``LARGE`` different contexts skip the sort, so that no
   task holds them: their strings are counted by 128-bit hashes, which
   aggregates within tasks first.
4. Starts go back to their documents and the covered bytes are cut.  Anchors and
   contexts with over a thousandth of all repeated items are dealt to numbered
   lots in the joins; there are at most ``SHARE`` of them.

``keep_first`` keeps the first copy of each string, by key, text hash and
position; otherwise all copies go.  Contexts are told apart by 128 bits of
hashes.

Defined cases: a null text is empty; documents shorter than LENGTH have no
strings; rows equal in key and text count as separate occurrences for removing
all copies and as one position for ``keep_first``; null keys are keys like any
other; an empty table gives an empty table.  Only key and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm.common import bounded, raw_bytes, texts_of, written
from gazetteer.session import cut_lineage

LENGTH, GRAM = 200, 64
MAX_BITS = 1 << 28
LARGE = 4096
SORT_BYTES = 1 << 20
SHARE = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POSITION = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    made = np.full(n, base, np.uint64)
    made[:1] = 1
    return np.multiply.accumulate(made)


class Hashes:
    """Hashes of any range of a byte array, from running sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, add: int = 1):
        self.back = _powers(_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(add)) * _powers(_BASE, len(data)), out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.back[low])

    def grams(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n])


def items(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Items of the texts in a byte array: text number, first start, starts, anchor hash, context hash."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    with np.errstate(over="ignore"):
        hashes = Hashes(data)
        grams = hashes.grams(gram)
        keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width, span = length - gram + 1, 1
        while span * 2 <= width:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < width:
            keys = np.minimum(keys[: len(keys) - (width - span)], keys[width - span:])
        anchor = (keys & _POSITION).astype(np.int64)
        sizes = np.maximum(np.diff(offsets) - length + 1, 0)
        start = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        own = anchor[start]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])) if len(own) else empty
        n = np.diff(np.append(first, len(own)))
        low = start[first]
        context = hashes.of(low, low + n - 1 + length) ^ _mix(((own[first] - low) * 1024 + n).astype(np.uint64))
        return doc[first], low, n, grams[own[first]], context


def _may(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes & np.uint64(len(bitmap) * 8 - 1)
    return bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 == 1


def _meet(rows: DataFrame, answers: DataFrame, by: list[str], hot: DataFrame) -> DataFrame:
    """Rows joined to the one answer of their ``by`` values.

    ``hot`` names values with over a ``SHARE``-th of all rows, at most SHARE of
    them, and their lots; rows of these are dealt to the lots, each with a copy
    of the answer.
    """
    hot = F.broadcast(hot)
    count = F.coalesce("lots", F.lit(1).cast("long"))
    rows = rows.join(hot, by, "left").withColumn("_lot", F.pmod(F.xxhash64("key", "th", "start"), count)).drop("lots")
    answers = answers.join(hot, by, "left").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("lots")
    return rows.join(answers, [*by, "_lot"]).drop("_lot")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of a column ``ah`` of hashes, at most ``bits`` / 8 bytes."""
    cell = F.col("ah").bitwiseAND(F.lit(bits - 1).cast("long")) + 1  # from one on, bucket 1 + cell / 32768 holds bit cell % 32768
    rows = hashes.select(cell.alias("cell")).groupBy(F.expr("bitmap_bucket_number(cell)").alias("b")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))
    made = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows.collect():
        made[r["b"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return made.ravel()


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position among the strings of ``length`` bytes; positions too near the end have none."""
    span = 1
    rank = data.astype(np.int64)
    while span < length:
        step = min(span, length - span)
        rank = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        span += step
        if span >= 4:  # up to four bytes the number itself is the rank
            rank = np.unique(rank, return_inverse=True)[1]
    return rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element that is smaller, or -1, by jumping along found candidates."""
    found = np.arange(len(values)) - 1
    todo = np.flatnonzero((found >= 0) & (values[found] > values))
    while len(todo):
        found[todo] = found[found[todo]]
        at = found[todo]
        todo = todo[(at >= 0) & (values[at] > values[todo])]
    return found


def previous_factors(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which strings have an equal one at a smaller position.

    ``rank`` orders strings; equal ranks are suffixes whose common prefix has
    the full length.  The longest previous factor reaches it where the previous
    or next smaller position in suffix order lies in the same run of ranks.
    """
    order = np.argsort(rank, kind="stable")
    run, place = rank[order], position[order]
    before = previous_smaller(place)
    after = len(place) - 1 - previous_smaller(place[::-1])[::-1]
    hit = ((before >= 0) & (run[before] == run)) | ((after < len(run)) & (run[np.minimum(after, len(run) - 1)] == run))
    result = np.zeros(len(rank), bool)
    result[order] = hit
    return result


def _runs(flag: np.ndarray, owner: np.ndarray, place: np.ndarray, owners: int) -> list[list[int]]:
    """Flat [first, count, ...] lists of the flagged places of each owner, in order."""
    at = np.flatnonzero(flag)
    out: list[list[int]] = [[] for _ in range(owners)]
    if not len(at):
        return out
    new = np.concatenate([[True], (np.diff(place[at]) != 1) | (np.diff(owner[at]) != 0)])
    first = np.flatnonzero(new)
    for o, s, n in zip(owner[at[first]].tolist(), place[at[first]].tolist(), np.diff(np.append(first, len(at))).tolist(), strict=True):
        out[o] += [s, n]
    return out


def _sort_contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated starts of contexts, sorted by anchor hash; whole anchors are held, up to about SORT_BYTES more."""
    def solve(table: pa.Table) -> pa.RecordBatch:
        contexts = table.column("ctx").combine_chunks().cast(pa.large_binary())
        data, offsets = raw_bytes(contexts)
        sizes = np.diff(offsets)
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rank = ranks(data, length)[offsets[:-1][owner] + place]
        times = table.column("n").to_numpy()
        first = np.argsort(np.argsort(table.column("first").to_numpy(), kind="stable"), kind="stable")
        position = first[owner] * (int(counts.max(initial=0)) + 1) + place
        earlier, later = previous_factors(rank, position), previous_factors(rank, -position)
        both = earlier | later | (times[owner] > 1)
        return pa.RecordBatch.from_arrays(
            [table.column("ah").combine_chunks(), table.column("ch").combine_chunks(),
             pa.array(_runs(both, owner, place, len(counts)), pa.list_(pa.int32())),
             pa.array(_runs(earlier, owner, place, len(counts)), pa.list_(pa.int32()))], names=["ah", "ch", "every", "later"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(batch.schema.get_field_index("ctx")).nbytes
        if size < SORT_BYTES:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("ah").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
        sizes = np.cumsum(np.array([len(x) for x in table.column("ctx").to_pylist()], np.int64))
        low = 0
        for edge in edges[:-1]:  # the last anchor may go on in the next batch
            if sizes[edge - 1] - (sizes[low - 1] if low else 0) >= SORT_BYTES or edge == edges[-2]:
                yield solve(table.slice(low, edge - low))
                low = int(edge)
        held = table.slice(low).combine_chunks().to_batches()
        size = sum(b.column(b.schema.get_field_index("ctx")).nbytes for b in held)
    if held:
        yield solve(pa.Table.from_batches(held))


def _hash_strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each string of a context as 128 bits of hashes."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                data, offsets = raw_bytes(part.column(part.schema.get_field_index("ctx")).cast(pa.large_binary()))
                counts = np.diff(offsets) - length + 1
                owner = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = offsets[:-1][owner] + place
                one, two = (Hashes(x).of(at, at + length) for x in (data, data ^ (data >> np.uint8(3)) ^ np.uint8(0x5A)))
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)).take(take) for c in ("ah", "ch", "n", "first")]
                    + [pa.array(place.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["ah", "ch", "n", "first", "place", "h1", "h2"])


def repeated_starts(rows: DataFrame, length: int = LENGTH, keep_first: bool = False, max_bits: int = MAX_BITS,
                    large: int = LARGE) -> DataFrame:
    """(key, th, spans) of documents with repeated strings; spans are flat [first start, starts, ...].

    ``rows`` has key, text and th, a hash of the text.
    """
    spark = rows.sparkSession

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            _, _, _, ah, ch = items(*raw_bytes(texts_of(batch, "text")), length)
            yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64))], names=["ah", "ch"])

    met = rows.select("text").mapInArrow(narrow, "ah long, ch long").groupBy("ah").agg(
        F.count(F.lit(1)).alias("n"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).where("n > 1")
    met = cut_lineage(met.selectExpr("ah", "n", "lo <> hi AS mixed"))
    n, total = met.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 1 << 15
    while bits < 16 * n and bits < max_bits:
        bits *= 2
    maps = spark.sparkContext.broadcast((_bitmap(met, bits), _bitmap(met.where("mixed"), bits)))  # two times bits / 8 bytes

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, mixed = maps.value
        for batch in bounded(batches, "text"):
            data, offsets = raw_bytes(texts_of(batch, "text"))
            doc, low, n, ah, ch = items(data, offsets, length)
            keep = np.flatnonzero(_may(repeated, ah))
            doc, low, n, ah, ch = doc[keep], low[keep], n[keep], ah[keep], ch[keep]
            sort = _may(mixed, ah)
            bring = np.zeros(len(ah), bool)  # one of each context of the batch brings its bytes
            some = np.flatnonzero(sort)
            order = some[np.lexsort((ch[some], ah[some]))]
            new = np.ones(len(order), bool)
            new[1:] = (ah[order][1:] != ah[order][:-1]) | (ch[order][1:] != ch[order][:-1])
            bring[order[new]] = True
            body = memoryview(data)
            contexts = [bytes(body[a: a + m - 1 + length]) if x else None
                        for a, m, x in zip(low.tolist(), n.tolist(), bring.tolist(), strict=True)]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(low - offsets[:-1][doc]), pa.array(n),
                 pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(sort), pa.array(contexts, pa.binary())],
                names=["key", "th", "start", "starts", "ah", "ch", "sort", "ctx"])

    found = written(rows.select("key", "text", "th").mapInArrow(wide, T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("th", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("starts", T.LongType()), T.StructField("ah", T.LongType()), T.StructField("ch", T.LongType()),
        T.StructField("sort", T.BooleanType()), T.StructField("ctx", T.BinaryType())])))
    lots = F.when(F.col("n") > 1, F.ceil(F.col("n") * SHARE / F.lit(max(total, 1)))).cast("long")
    where = F.struct("key", "th", "start")

    hot = met.where(~F.col("mixed") & (lots > 1)).select("ah", lots.alias("lots"))
    same = _meet(found.where("NOT sort").select("key", "th", "start", "starts", "ah"), met.select("ah"), ["ah"], hot)
    if keep_first:
        owner = same.groupBy("ah").agg(F.min(where).alias("own"))
        same = _meet(same, owner, ["ah"], hot).where(~where.eqNullSafe(F.col("own")))
    same = same.select("key", "th", F.array(F.col("start"), F.col("starts")).alias("spans"))

    mixed = found.where("sort")
    tally = mixed.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("n"))
    many = tally.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > large).select("ah")
    once = mixed.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("n"), F.first("ctx", ignorenulls=True).alias("ctx"),
                                         *([F.min(where).alias("own")] if keep_first else []))
    if keep_first:  # positions in the order of first occurrences, inside each anchor
        once = once.withColumn("first", F.row_number().over(Window.partitionBy("ah").orderBy("own")).cast("long"))
    else:
        once = once.withColumn("first", F.col("ch"))
    few = once.join(many, "ah", "left_anti").select("ah", "ch", "n", "first", "ctx")
    answer = "ah long, ch long, every array<int>, later array<int>"
    solved = few.repartition("ah").sortWithinPartitions("ah").mapInArrow(lambda b: _sort_contexts(b, length), answer)
    strings = once.join(many, "ah", "left_semi").select("ah", "ch", "n", "first", "ctx").mapInArrow(
        lambda b: _hash_strings(b, length), "ah long, ch long, n long, first long, place int, h1 long, h2 long")
    counts = strings.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(
        F.sum("n").alias("times"), F.min(F.struct("first", "ch", "place")).alias("head")).where("times > 1")
    hit = strings.join(counts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    one = F.array(F.col("place"), F.lit(1))
    is_head = F.struct("first", "ch", "place") == F.col("head")
    counted = hit.groupBy("ah", "ch").agg(
        F.flatten(F.collect_list(one)).alias("every"), F.flatten(F.collect_list(F.when(~is_head, one))).alias("later"))
    solved = solved.unionByName(counted).where((F.size("every") > 0) | (F.size("later") > 0))
    back = mixed.select("key", "th", "start", "ah", "ch")
    hot = tally.where(lots > 1).select("ah", "ch", lots.alias("lots"))
    if keep_first:
        back = _meet(back, once.select("ah", "ch", "own"), ["ah", "ch"], hot)
        chosen = F.when(where.eqNullSafe(F.col("own")), F.col("later")).otherwise(F.col("every"))
    else:
        chosen = F.col("every")
    back = _meet(back, solved, ["ah", "ch"], hot).select("key", "th", "start", chosen.alias("runs"))
    back = back.where(F.size("runs") > 0).select("key", "th", F.transform(
        "runs", lambda x, i: F.when(i % 2 == 0, x + F.col("start")).otherwise(x.cast("long"))).alias("spans"))
    return same.unionByName(back).groupBy("key", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def cut(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep_first: bool = False,
        **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    spans = repeated_starts(rows, length, keep_first, **options).withColumnsRenamed({"key": "_key", "th": "_th"})
    met = rows.join(spans, F.col("key").eqNullSafe(F.col("_key")) & (F.col("th") == F.col("_th")), "left").select("key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            out = []
            for body, own in zip(texts_of(batch, "text").cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not own:
                    out.append((len(body), 0, 0, hashlib.sha256(body).hexdigest(), body))
                    continue
                edge = np.zeros(len(body) + 1, np.int64)
                first, n = np.array(own[::2], np.int64), np.array(own[1::2], np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n - 1 + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                left = np.frombuffer(body, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(body), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3]), pa.array(cols[4], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return met.mapInArrow(run, T.StructType([
        T.StructField("doc_id", rows.schema["key"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]))
