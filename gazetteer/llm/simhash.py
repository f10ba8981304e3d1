"""SimHash near-dedup with pigeonring filtering.

Fingerprints: XXH64 of every four-word shingle, a bit is set where over half
of the hashes have it.  Two fingerprints link at four or fewer differing bits.

Candidates: the 64 bits form a ring of five segments.  By the pigeonring
principle two fingerprints within four bits have a starting segment from which
every chain of l consecutive segments differs in at most l * 4 / 5 bits.  The
first ``chain`` segments of that chain make the bucket key (the first equal,
later ones within their budgets, met by trying the allowed flips), so a key
of two segments holds 26 bits; the whole chain is checked before the full
Hamming distance.  A fingerprint has 21 to 37 keys at every size of the input,
so the shuffle grows in proportion.  A longer ``chain`` makes smaller buckets
and many more keys (667 at three segments); it never changes the links.

Buckets meet as sorted runs inside tasks.  Small ones compare their pairs; in a
large one labels spread over blocks of bounded size and only a star per
component leaves it, so rows out never exceed rows in.  Components come from
alternating star operations on the links, in joins and aggregates.

Defined cases: a null text counts as empty; a text without words has the
fingerprint zero and links like any other; fewer than four words make one
shingle; a null id is ignored where a smaller one exists; repeated rows get
the same component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm import graph
from gazetteer.llm.common import bounded, texts_of, written
from gazetteer.session import cut_lineage

SHINGLE, SEED, MAX_BITS = 4, 42, 4
CUTS = [0, 13, 26, 39, 52, 64]
SEGMENTS = len(CUTS) - 1
BUDGETS = [length * MAX_BITS // SEGMENTS for length in range(1, SEGMENTS + 1)]
CHAIN = 2
SMALL_PAIRS = 1 << 14
BLOCK_CELLS = 1 << 22


def fingerprint(text: str) -> int:
    """Fingerprint of one text, unsigned."""
    return int(_fingerprints([text])[0])


def _fingerprints(texts: list[str]) -> np.ndarray:
    hashed: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        last = ends[SHINGLE - 1:].tolist() or [len(joined)]
        before = len(hashed)
        hashed.extend([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)])
        counts[k] = len(hashed) - before
    result = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        array = np.array(hashed, np.uint64)
        at = np.concatenate([[0], np.cumsum(counts[full])])
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        low = 0
        while low < len(full):  # groups of texts with bounded bit tables, one text at least
            high = max(low + 1, int(np.searchsorted(at, at[low] + (1 << 16), side="right")) - 1)
            bits = np.unpackbits(array[at[low]: at[high]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, at[low:high] - at[low], axis=0, dtype=np.int32)
            over = 2 * ones > counts[full[low:high]][:, None]
            result[full[low:high]] = (over * weights).sum(axis=1, dtype=np.uint64)
            low = high
    return result


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns ``key`` and ``fp`` (the 64 bits as a long), one row per input row."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            fps = _fingerprints(texts_of(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(run, T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("fp", T.LongType())]))


def _segment(i: int) -> int:
    low, high = CUTS[i % SEGMENTS], CUTS[i % SEGMENTS + 1]
    return ((1 << high) - 1) ^ ((1 << low) - 1)


def _bits(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def flips(start: int, chain: int) -> list[int]:
    """Difference patterns over a chain that its budgets allow, apart from none."""
    found = [(0, 0)]
    for length in range(1, chain):
        spots = _bits(_segment(start + length))
        found = [(mask | sum(1 << b for b in extra), used + n) for mask, used in found
                 for n in range(BUDGETS[length] - used + 1) for extra in combinations(spots, n)]
    return [mask for mask, _ in found if mask]


def _key(masked: np.ndarray, start: int) -> np.ndarray:
    """Bucket key with a free lowest bit; keys that collide only add candidates."""
    with np.errstate(over="ignore"):
        x = (masked ^ np.uint64((start + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) & np.uint64(2**64 - 2)


def _keys(chain: int):
    """Rows (key, fp): one per start, and one per allowed flip with the lowest bit of the key set.

    Of two fingerprints that differ by a flip, the one with a zero at the
    flip's lowest bit tries it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(s, np.uint64(sum(_segment(s + i) for i in range(chain))),
                     [(np.uint64(m), np.uint64(m & -m)) for m in flips(s, chain)]) for s in range(SEGMENTS)]
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 14):
                fps = batch.column(0).slice(low, 1 << 14).to_numpy().view(np.uint64)
                keys, of = [], []
                for start, kept, masks in patterns:
                    masked = fps & kept
                    keys.append(_key(masked, start))
                    of.append(fps)
                    for mask, lowest in masks:
                        tries = (masked & lowest) == 0
                        keys.append(_key(masked[tries] ^ mask, start) | np.uint64(1))
                        of.append(fps[tries])
                        if sum(map(len, keys)) > 1 << 20:
                            yield _batch(keys, of)
                            keys, of = [], []
                yield _batch(keys, of)

    return run


def _batch(keys: list[np.ndarray], of: list[np.ndarray], names=("bucket", "fp")) -> pa.RecordBatch:
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(join(x).view(np.int64)) for x in (keys, of)], names=list(names))


_SEGMENT_MASKS = [np.uint64(_segment(i)) for i in range(SEGMENTS)]


def _linked(diff: np.ndarray) -> np.ndarray:
    """Pigeonring test, then the full distance."""
    parts = np.stack([np.bitwise_count(diff & m) for m in _SEGMENT_MASKS]).astype(np.int8)
    viable = np.zeros(len(diff), bool)
    for start in range(SEGMENTS):
        ok, used = np.ones(len(diff), bool), np.zeros(len(diff), np.int8)
        for length in range(SEGMENTS):
            used = used + parts[(start + length) % SEGMENTS]
            ok &= used <= BUDGETS[length]
        viable |= ok
    result = np.zeros(len(diff), bool)
    at = np.flatnonzero(viable)
    result[at] = np.bitwise_count(diff[at]) <= MAX_BITS
    return result


def _small(fps: np.ndarray, first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j): each position of ``first`` against the positions after it, up to ``stop``."""
    counts = stop - first - 1
    ends = np.cumsum(counts)
    low = 0
    while low < len(first):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + (1 << 20), side="right")))
        n = counts[low:high]
        left = np.repeat(first[low:high], n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = _linked(fps[left] ^ fps[right])
        yield left[near], right[near]
        low = high


def _large(fps: np.ndarray, indexed: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of one bucket's components: the first ``indexed`` rows against all, in blocks."""
    n = len(fps)
    label = np.arange(n)
    step = max(1, BLOCK_CELLS // n)
    while True:
        before = label.copy()
        for low in range(0, indexed, step):
            high = min(indexed, low + step)
            near = np.bitwise_count(fps[low:high, None] ^ fps[None, :]) <= MAX_BITS
            best = np.where(near, label[None, :], n).min(axis=1)
            label[low:high] = np.minimum(label[low:high], best)
            label = np.minimum(label, np.where(near, label[low:high, None], n).min(axis=0))
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(n))
    return label[linked], linked


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted buckets; the last bucket of a batch waits for the next one."""
    held_key, held_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def run(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        bucket = keys >> np.uint64(1)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end = np.append(begin[1:], len(keys))
        probe = (keys & np.uint64(1)).astype(np.int64)
        index_count = (end - begin) - np.add.reduceat(probe, begin)
        pairs = index_count * (end - begin)
        few = np.flatnonzero((index_count > 0) & (end - begin > 1) & (pairs <= SMALL_PAIRS))
        n = index_count[few]
        first = np.repeat(begin[few], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for a, b in _small(fps, first, np.repeat(end[few], n)):
            yield _batch([fps[a]], [fps[b]], ("a", "b"))
        for k in np.flatnonzero(pairs > SMALL_PAIRS):
            own = fps[begin[k]: end[k]]
            a, b = _large(own, int(index_count[k]))
            yield _batch([own[a]], [own[b]], ("a", "b"))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([held_key, batch.column(0).to_numpy().view(np.uint64)])
        fps = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.argmax(keys >> np.uint64(1) == keys[-1] >> np.uint64(1)))
        held_key, held_fp = keys[cut:], fps[cut:]
        yield from run(keys[:cut], fps[:cut])
    yield from run(held_key, held_fp)


def links(distinct: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Links (a, b) that connect every two of the given distinct fingerprints within the distance."""
    rows = distinct.select("fp").mapInArrow(_keys(chain), "bucket long, fp long")
    met = rows.repartition(F.shiftright("bucket", 1)).sortWithinPartitions("bucket")
    return met.mapInArrow(_links, "a long, b long").where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (a, b); the root is the component's smallest node."""
    return graph.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


def components_of(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's key, fp (long) and component_id, the smallest key that links reach."""
    prints = cut_lineage(fingerprints(df, text, key))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("least")))
    member = components(links(distinct))
    rooted = distinct.join(member, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    named = rooted.join(named, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("key", "fp", "component_id")


def hex_digits(fp):
    """Column: a fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component: that of the smallest key, of repeated keys the one stored first.

    A null key stays only where its component has no other.  The rows are stored
    with a number each, which tells rows with the same key apart.
    """
    rows = written(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")))
    place = F.struct(F.col("row")[key].isNull().alias("none"), F.col("row")[key].alias("key"), "number")
    found = components_of(rows.select(place.alias("place"), F.col("row")[text].alias("text")), "text", "place")
    stay = found.where(F.col("key") == F.col("component_id")).select(F.col("key.number").alias("number"))
    return rows.join(stay, "number", "left_semi").select("row.*")
