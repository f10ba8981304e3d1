"""Embedding near-dedup by lattice hashing on E8.

Equal vectors are folded into one first.  Each distinct vector becomes a sketch:
its direction in bytes, with a scale and a proven bound on the rounding.  Every
table projects the sketch on sixteen random orthonormal directions and decodes
the two halves to points of the lattice E8; the pair of points is its home cell.
From there the cells nearest to it among those reached over the 240 shortest
lattice vectors are probed.  Two vectors meet where one is at home and the other
is at home or probes.

In a bucket the sketches decide: with the bounds a pair is above the threshold
for sure, below it for sure, or undecided.  Undecided pairs meet again, in the
same buckets, with their whole vectors, and the cosine in double precision
decides.  A pair that meets several times counts in one place only: in the first
table where it meets, there in the home of the smaller node if the other comes to
it.  The cells that tell are worked out again from the sketches, in integers, so
they always agree.  What leaves a bucket are a count of links for each vector and
star edges for each component, never pairs.

A bucket of more than ``LIMIT`` rows is dealt into parts of about ``PART`` rows,
and every two parts meet in a task of their own, so no bucket has to fit a task.
Work there still grows with the square of a group of different vectors that are
all alike, and its rows are copied once for each part.

Recall depends on the angle alone.  With four tables of four probes it is about
0.97 for pairs at a cosine of 0.95 and over 0.99 from 0.97 on (see the tests).

Defined cases: vectors that are null, empty, zero or hold null or non-finite
entries link with nothing; vectors shorter than the longest are taken to end in
zeros; a null id is ignored where the component has another and kept where it has
none; rows that repeat an id each get their own row; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetteer.llm.common import written
from gazetteer.llm.graph import components

THRESHOLD = 0.95
TABLES, PROBES, SPACING = 4, 4, 0.25
DIRECTIONS = 16  # of a table: two points of E8
LIMIT, PART = 4096, 1024
UNIT = 4096  # the lattice's unit in fixed point
FEW_PAIRS, CELLS = 1 << 14, 1 << 20
ROUNDING = 1e-9


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            root = np.zeros(8, np.int64)
            root[[i, j]] = a, b
            found.append(root)
    found += [np.array(signs) for signs in product((1, -1), repeat=8) if np.prod(signs) == 1]
    return np.stack(found)


ROOTS = _roots()
_MIX = np.random.default_rng(8).integers(1, 2**63, DIRECTIONS, dtype=np.uint64) | np.uint64(1)


def projections(width: int, tables: int = TABLES, seed: int = 11) -> np.ndarray:
    """Whole-numbered orthonormal directions, scaled alike for vectors of any width: tables x width x 16."""
    rng = np.random.default_rng(seed)
    size = max(width, DIRECTIONS)
    turned = [np.linalg.qr(rng.standard_normal((size, DIRECTIONS)))[0][:width] for _ in range(tables)]
    return np.rint(np.stack(turned) * math.sqrt(size / 64) / SPACING * UNIT)


def _checkerboard(z: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole coordinates with an even sum."""
    whole = (z + UNIT // 2) // UNIT
    off = z - whole * UNIT
    odd = np.flatnonzero(whole.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    whole[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return whole


def nearest_points(z: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to fixed-point rows, doubled so that they are whole."""
    even, half = 2 * _checkerboard(z), 2 * _checkerboard(z - UNIT // 2) + 1
    far = lambda c: np.square(z - c * (UNIT // 2)).sum(axis=1)
    return np.where((far(even) <= far(half))[:, None], even, half)


def _steps(z: np.ndarray, points: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest moves to a neighbouring point: how much farther it is, and which root."""
    rest = (z - points * (UNIT // 2)).astype(np.float64)
    cost = (2 * UNIT * UNIT - UNIT * (rest @ ROOTS.T.astype(np.float64))).astype(np.int64)
    coded = cost * 256 + np.arange(len(ROOTS))  # no two alike, so the order never depends on the batch
    coded = np.sort(np.partition(coded, many, axis=1)[:, :many], axis=1)
    return coded >> 8, coded & 255


def _name(points: np.ndarray) -> np.ndarray:
    mixed = (points.astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64)


def cells(q: np.ndarray, scale: np.ndarray, turns: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Names of the cells of each sketch: rows x tables x (home, probes)."""
    result = np.zeros((len(q), len(turns), probes + 1), np.int64)
    at = np.arange(len(q))
    pairs = max(2, math.isqrt(probes))
    for t, turn in enumerate(turns):
        z = np.rint(q.astype(np.float64) @ turn * scale[:, None]).astype(np.int64)
        first, second = z[:, :8], z[:, 8:]
        a, b = nearest_points(first), nearest_points(second)
        (cost_a, root_a), (cost_b, root_b) = _steps(first, a, probes), _steps(second, b, probes)
        moves = [(i, -1) for i in range(probes)] + [(-1, j) for j in range(probes)] + list(product(range(pairs), repeat=2))
        moves = [(i, j) for i, j in moves if max(i, j) < probes]
        cost = np.stack([(cost_a[:, i] if i >= 0 else 0) + (cost_b[:, j] if j >= 0 else 0) for i, j in moves], axis=1)
        best = np.sort(cost * 64 + np.arange(len(moves)), axis=1)[:, :probes] & 63
        move_a, move_b = (np.array([m[k] for m in moves])[best] for k in (0, 1))
        result[:, t, 0] = _name(np.hstack([a, b]))
        for p in range(probes):
            go_a, go_b = move_a[:, p], move_b[:, p]
            near_a = a + np.where(go_a[:, None] >= 0, ROOTS[root_a[at, go_a]], 0)
            near_b = b + np.where(go_b[:, None] >= 0, ROOTS[root_b[at, go_b]], 0)
            result[:, t, p + 1] = _name(np.hstack([near_a, near_b]))
        result[:, t] |= t << 32
    return result


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    result = np.zeros((len(lengths), width))
    result[np.arange(width) < lengths[:, None]] = flat
    return result


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def sketch(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions as bytes, their scale, and a bound on the length of what rounding lost."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None])
    lost = np.linalg.norm(units - q * scale[:, None], axis=1) + ROUNDING
    return q.astype(np.int8), scale, lost


ROWS = "key long, probe boolean, node long, copies long, q binary, scale double, lost double"


def _sketched(batch: pa.RecordBatch, width: int):
    for low in range(0, batch.num_rows, 4096):
        part = batch.slice(low, 4096)
        yield part, sketch(_units(_matrix(part.column(part.schema.get_field_index("vector")), width)))


def _keys(width: int, turns: np.ndarray):
    """The names of all cells a vector comes to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, (q, scale, _lost) in _sketched(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(cells(q, scale, turns).ravel())], names=["key"])

    return run


def _rows(width: int, turns: np.ndarray):
    """One row for each cell a vector comes to, with its sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (q, scale, lost) in _sketched(batch, width):
                keys = cells(q, scale, turns)
                same = np.tril(np.ones((keys.shape[2],) * 2, bool), -1)
                once = ~((keys[..., :, None] == keys[..., None, :]) & same).any(axis=-1)
                each = pa.array(np.nonzero(once)[0])
                ends = pa.py_buffer(np.arange(len(q) + 1, dtype=np.int32) * width)
                body = pa.Array.from_buffers(pa.binary(), len(q), [None, ends, pa.py_buffer(np.ascontiguousarray(q))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[once]), pa.array(np.nonzero(once)[2] > 0), part.column(0).take(each), part.column(1).take(each),
                     body.take(each), pa.array(scale).take(each), pa.array(lost).take(each)],
                    names=["key", "probe", "node", "copies", "q", "scale", "lost"])

    return run


class _Group:
    """Rows of some whole buckets, homes first in each."""

    def __init__(self, table: pa.Table, turns: np.ndarray, width: int):
        self.table, self.turns, self.width = table, turns, width
        get = lambda name: table[name].to_numpy()
        self.key, self.pair, self.part, self.node, self.copies = map(get, ("key", "pair", "part", "node", "copies"))
        self.home = ~get("probe")
        self.scale, self.lost = get("scale"), get("lost")
        body = table["q"].combine_chunks()
        body = body if isinstance(body, pa.Array) else pa.concat_arrays(body.chunks)
        ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset: body.offset + len(body) + 1]
        self.q = np.frombuffer(body.buffers()[2], np.int8)[ends[0]: ends[-1]].reshape(-1, width)
        self.wide = self.q.astype(np.float32 if width < 1000 else np.float64)  # products stay whole numbers
        change = (self.key[1:] != self.key[:-1]) | (self.pair[1:] != self.pair[:-1])
        self.begin = np.flatnonzero(np.append(True, change))
        self.end = np.append(self.begin[1:], len(self.key))
        self.homes = np.add.reduceat(self.home.astype(np.int64), self.begin)
        self._cells = np.zeros((len(self.key), len(turns), PROBES + 1), np.int64)
        self._known = np.zeros(len(self.key), bool)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of a home row and a later row of its bucket, with their products, in bounded runs."""
        size = self.end - self.begin
        work = self.homes * size
        few = np.flatnonzero((self.homes > 0) & (size > 1) & (work <= FEW_PAIRS))
        n = self.homes[few]
        left = np.repeat(self.begin[few], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        after = np.repeat(self.end[few], n) - left - 1
        ends = np.cumsum(after)
        low = 0
        while low < len(left):
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + (1 << 17), side="right")))
            n = after[low:high]
            a = np.repeat(left[low:high], n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            yield a, b, np.einsum("ij,ij->i", self.wide[a], self.wide[b], dtype=np.float64)
            low = high
        for k in np.flatnonzero(work > FEW_PAIRS):
            begin, end = self.begin[k], self.end[k]
            step = max(1, CELLS // (end - begin))
            for low in range(begin, begin + self.homes[k], step):
                high = min(begin + self.homes[k], low + step)
                dots = (self.wide[low:high] @ self.wide[low:end].T).astype(np.float64)
                lost, others = self.lost[low:high, None], self.lost[None, low:end]
                most = dots * np.outer(self.scale[low:high], self.scale[low:end]) + lost + others + lost * others
                a, b = np.nonzero(most >= THRESHOLD - ROUNDING)
                later = b > a
                a, b = a[later], b[later]
                yield a + low, b + low, dots[a, b]

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs not surely below the threshold that count here, and whether they are surely above."""
        for a, b, dots in self.candidates():
            about = dots * (self.scale[a] * self.scale[b])
            slack = (self.lost[a] + self.lost[b]) + self.lost[a] * self.lost[b]
            kept = (about + slack >= THRESHOLD) & (self.node[a] != self.node[b])
            kept &= (self.pair[a] >> 32 == self.pair[a] & 0xFFFFFFFF) | (self.part[a] != self.part[b])
            a, b = a[kept], b[kept]
            sure = (about - slack >= THRESHOLD)[kept]
            here = self.counts_here(a, b)
            yield a[here], b[here], sure[here]

    def counts_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rows = np.unique(np.concatenate([a, b]))
        rows = rows[~self._known[rows]]
        for low in range(0, len(rows), 4096):
            some = rows[low: low + 4096]
            self._cells[some] = cells(self.q[some], self.scale[some], self.turns)
        self._known[rows] = True
        comes = lambda x, y, t: (self._cells[x, t, :1] == self._cells[y, t]).any(axis=1)  # y comes to x's home
        table = self.key[a] >> 32
        here = np.ones(len(a), bool)
        for t in range(len(self.turns)):
            at = np.flatnonzero(here & (table > t))
            here[at] = ~(comes(a[at], b[at], t) | comes(b[at], a[at], t))
            # In its own table a pair counts at the home of the smaller node, unless only the other is visited.
            at = np.flatnonzero(here & (table == t) & ~self.home[b] & (self.node[a] > self.node[b]))
            here[at] = ~comes(b[at], a[at], t)
        return here

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        units = _units(_matrix(self.table["vector"].combine_chunks(), self.width))
        result = np.zeros(len(a), bool)
        for low in range(0, len(a), 1 << 14):
            some = slice(low, low + (1 << 14))
            result[some] = np.einsum("ij,ij->i", units[a[some]], units[b[some]]) >= THRESHOLD
        return result


def _links(width: int, turns: np.ndarray, whole: bool):
    """(kind, a, b, c): links of a node, edges of stars, and nodes with undecided pairs in a bucket.

    With whole vectors, only the pairs that sketches leave undecided are counted.
    """
    names = ["kind", "a", "b", "c"]

    def rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        filled = [*columns, *[np.zeros(len(columns[0]), np.int64)] * (3 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, filled)], names=names)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = _Group(table, turns, width)
        size = len(group.key)
        links, open_rows, label = np.zeros(size, np.int64), np.zeros(size, bool), np.arange(size)
        for a, b, sure in group.near():
            if whole:
                a, b = a[~sure], b[~sure]
                found = group.exact(a, b)
            else:
                open_rows[a[~sure]] = open_rows[b[~sure]] = True
                found = sure
            a, b = a[found], b[found]
            np.add.at(links, a, group.copies[b])
            np.add.at(links, b, group.copies[a])
            while True:  # smallest row of a component, over the links of this run and those before
                low = np.minimum(label[a], label[b])
                before = label.copy()
                for x in (a, b, before[a], before[b]):
                    np.minimum.at(label, x, low)
                label = label[label]
                if (label == before).all():
                    break
        some = np.flatnonzero(links)
        yield rows(0, group.node[some], links[some])
        some = np.flatnonzero(group.node != group.node[label])
        yield rows(1, group.node[label[some]], group.node[some])
        some = np.flatnonzero(open_rows)
        yield rows(2, group.node[some], group.key[some], group.pair[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            both = pa.concat_tables(held)
            key, pair = both["key"].to_numpy(), both["pair"].to_numpy()
            cut = int(np.argmax((key == key[-1]) & (pair == pair[-1])))
            if cut:
                yield from work(both.slice(0, cut))
                held = [both.slice(cut)]
        if held:
            yield from work(pa.concat_tables(held))

    return run


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "probe")


def link(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows (key, n_links, component_id, kept), one per row of the table."""
    entries = F.col("vector")
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    usable = F.coalesce(usable & F.exists(entries, lambda c: c != 0), F.lit(False))
    all_rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    all_rows = all_rows.withColumn("usable", usable)
    named = all_rows.where("usable").select(
        "key", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))
    # A hash of 128 bits stands for a vector.
    distinct = named.groupBy("h1", "h2").agg(
        F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"))).alias("least"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()))
    width = distinct.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return all_rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    turns = projections(width)

    vectors = distinct.select("node", "copies", "vector")
    full = vectors.select("vector").mapInArrow(_keys(width, turns), "key long").groupBy("key").count()
    full = written(full.where(F.col("count") > LIMIT).select("key", F.ceil(F.col("count") / PART).alias("parts")))

    def placed(some: DataFrame) -> DataFrame:
        """A row for each bucket and, in dealt buckets, for each other part that a vector meets."""
        rows = some.mapInArrow(_rows(width, turns), ROWS).join(full, "key", "left")
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pair = F.shiftleft(F.least("part", "other"), 32) + F.greatest("part", "other")
        return rows.withColumn("pair", pair).drop("parts", "other")

    out = "kind int, a long, b long, c long"
    first = written(_met(placed(vectors)).mapInArrow(_links(width, turns, False), out))
    undecided = first.where("kind = 2").select(F.col("a").alias("_node"), F.col("b").alias("_key"), F.col("c").alias("_pair")).distinct()
    some = vectors.join(undecided, F.col("node") == F.col("_node"), "left_semi")
    again = placed(some).join(undecided, (F.col("key") == F.col("_key")) & (F.col("pair") == F.col("_pair"))
                              & (F.col("node") == F.col("_node")), "left_semi")
    again = again.join(some.select(F.col("node").alias("_node"), "vector"), F.col("node") == F.col("_node")).drop("_node")
    second = written(_met(again).mapInArrow(_links(width, turns, True), out))
    found = first.unionByName(second)

    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    nodes = distinct.select("node", F.struct("least.none", "least.id", "node").alias("at"))
    edges = found.where("kind = 1").select("a", "b").distinct()
    edges = edges.join(nodes.select(F.col("node").alias("a"), F.col("at").alias("u")), "a")
    edges = edges.join(nodes.select(F.col("node").alias("b"), F.col("at").alias("v")), "b").select("u", "v")
    rooted = components(edges).select(F.col("node.node").alias("node"), F.col("root.id").alias("root"), F.lit(True).alias("in"))

    done = distinct.select("h1", "h2", "copies", "least", "node").join(links, "node", "left").join(rooted, "node", "left")
    done = done.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
                       (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.when(F.col("in"), F.col("root")).otherwise(F.col("least.id")).alias("component_id"))
    linked = named.select("key", "h1", "h2").join(done, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    linked = linked.select("key", "n_links", "component_id")
    alone = all_rows.where(~F.col("usable")).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
