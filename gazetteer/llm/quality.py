"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays.

``statistics`` computes the numbers of a text in numpy over Arrow batches of
bounded size.  ``fit`` boosts shallow trees on them with histogram splits;
chosen features are monotone: a split whose children would break the sign, or
the bounds inherited from the splits above, is not taken.  The forest is five
arrays (feature, threshold, left, right, value) and scoring walks all rows of a
batch down a tree together.

Training takes at most ``TRAIN_ROWS`` labelled documents of each class, those
with the smallest hash of their id; their texts come by a join with that
bounded list.  Everything else covers every document.

Defined cases: a null or empty text has no words and fails the base rules; rows
without a label are not trained on; with labels of one class only, or none,
the base rules alone decide; repeated rows are judged one by one; an empty
table gives an empty table.  Input columns travel inside one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm.common import bounded, raw_bytes, split_words, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"  # fixed values of the base statistics

TRAIN_ROWS = 8000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 40, 3, 32, 0.2, 1.0, 20
KEEP_FROM = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate",
            "upper_rate", "digit_rate", "mark_rate", "distinct_rate", "line_words"]
# Sign of the effect on the chance to be good; 0 leaves a feature free.
MONOTONE = [0, 0, -1, -1, -1, 0, 0, 0, 0, 0]


def _class_counts(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per text: bytes whose entry in a table of 256 is set."""
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(wanted[data], out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def _table(chars: str) -> np.ndarray:
    made = np.zeros(256, np.int64)
    made[np.frombuffer(chars.encode(), np.uint8)] = 1
    return made


def _pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense codes of pairs; equal only for equal pairs."""
    wide = int(b.max(initial=0)) + 1
    if int(a.max(initial=0)) >= (1 << 62) // wide:
        a = np.unique(a, return_inverse=True)[1]
    return a * wide + b


def _repeat_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: words inside three-word windows that occur twice or more in it."""
    texts = len(starts) - 1
    owner = np.repeat(np.arange(texts), np.diff(starts))
    if len(codes) < 3:
        return np.zeros(texts, np.int64)
    inside = owner[2:] == owner[:-2]
    at = np.flatnonzero(inside)
    window = _pair_codes(_pair_codes(_pair_codes(owner[at], codes[at]), codes[at + 1]), codes[at + 2])
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[at[twice] + shift] = True
    return np.bincount(owner[covered], minlength=texts)


def _distinct(owner: np.ndarray, codes: np.ndarray, texts: int) -> np.ndarray:
    """Per text: number of distinct codes."""
    wide = int(codes.max(initial=0)) + 1
    return np.bincount(np.unique(owner * wide + codes) // wide, minlength=texts)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics (long) and model features (double) of each text."""
    n = len(texts)
    data, offsets = raw_bytes(texts)
    codes, _, starts = split_words(texts)
    n_words = np.diff(starts)
    owner = np.repeat(np.arange(n), n_words)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = chars - _class_counts(data, offsets, _table(" \t\n\x0b\x0c\r"))
    symbols = _class_counts(data, offsets, _table(SYMBOLS))
    upper = _class_counts(data, offsets, _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = _class_counts(data, offsets, _table("0123456789"))
    marks = _class_counts(data, offsets, _table("!?;:"))

    lists = pc.split_pattern(texts, "\n")
    lines, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(pc.ascii_trim(lines, " \t\n\x0b\x0c\r"), "")
    lines, of = lines.filter(full), of[full.to_numpy(zero_copy_only=False)]
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.bincount(of, minlength=n)
    dup_lines = n_lines - _distinct(of, line_codes, n)
    repeats = _repeat_words(codes, starts)
    base = np.stack([n_words, word_chars, symbols, dup_lines, repeats], 1).astype(np.int64)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack([
        np.log1p(n_words), word_chars / w, symbols / c, dup_lines / np.maximum(n_lines, 1), repeats / w,
        upper / c, digits / c, marks / c, _distinct(owner, codes, n) / w, n_words / np.maximum(n_lines, 1)], 1)
    return base, features.astype(np.float64)


@dataclass
class Forest:
    """Trees as node arrays; a leaf has feature -1.  ``roots`` are node numbers."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, and the start."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            total += self.value[node]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1 for each row, of a boosted forest."""
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost trees for the logistic loss with second-order steps and monotone features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    rate = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    start = float(np.log(rate / (1 - rate)))
    score = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows, g, h, level, low, high) -> int:
        G, H = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(np.clip(-G / (H + RIDGE), low, high)) * RATE])
        if level == depth or len(rows) < 2 * LEAST:
            return me
        best = (1e-9, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            vl = np.clip(-gl / (hl + RIDGE), low, high)
            vr = np.clip(-(G - gl) / (H - hl + RIDGE), low, high)
            gain = gl**2 / (hl + RIDGE) + (G - gl)**2 / (H - hl + RIDGE) - G**2 / (H + RIDGE)
            allowed = (nl >= LEAST) & (len(rows) - nl >= LEAST) & ((vr - vl) * monotone[j] >= 0)
            gain = np.where(allowed, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1] is None:
            return me
        j, k, vl, vr = best[1]
        go_left = binned[rows, j] <= k
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        (ll, lh), (rl, rh) = bounds[monotone[j]]
        nodes[me][0], nodes[me][1] = j, float(edges[j][k])
        nodes[me][2] = grow(rows[go_left], g, h, level + 1, ll, lh)
        nodes[me][3] = grow(rows[~go_left], g, h, level + 1, rl, rh)
        return me

    forest = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        flat = np.array(nodes[first:])
        shift = lambda c: np.where(flat[:, c] >= 0, flat[:, c] - first, -1).astype(np.int64)
        tree = Forest(0.0, np.array([0]), flat[:, 0].astype(np.int64), flat[:, 1], shift(2), shift(3), flat[:, 4])
        score += tree.raw(x)
    flat = np.array(nodes)
    forest = Forest(start, np.array(roots), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64),
                    flat[:, 3].astype(np.int64), flat[:, 4])
    return forest


def base_fails(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id",
                  most: int = TRAIN_ROWS, largest: int | None = None) -> DataFrame:
    """Texts and labels (id, x, y) of at most ``most`` labelled documents of each class, one row per key.

    Of rows that repeat a key, the text with the smallest hash stands for all.
    Texts of over ``largest`` bytes, where given, are left out of the sample.
    """
    votes = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(
        F.col(key).alias("_of")).agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("_of"), F.col("_of")]
    few = votes.where("y = 0").orderBy(*order).limit(most).unionByName(votes.where("y = 1").orderBy(*order).limit(most))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("x"))
    if largest is not None:
        rows = rows.where(F.octet_length(F.coalesce("x", F.lit(""))) <= largest)
    rows = rows.join(F.broadcast(few), F.col("_id") == F.col("_of"))  # at most two times ``most`` rows
    one = rows.groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x")).alias("least"))
    return one.select(F.col("_id").alias("id"), F.col("least.x").alias("x"), "y")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          most: int = TRAIN_ROWS) -> Forest | None:
    """Fit on a bounded labelled sample; None where the labels hold one class at most."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "x"):
            features = statistics(texts_of(batch, "x"))[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(features), pa.list_(pa.float64())), batch.column(batch.schema.get_field_index("y"))], names=["f", "y"])

    rows = training_rows(docs, labels, label, text, key, most).select("x", "y").mapInArrow(
        measure, "f array<double>, y int").collect()
    rows.sort(key=lambda r: (r["y"], r["f"]))
    y = np.array([r["y"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r["f"] for r in rows]), y, MONOTONE)


def judge(df: DataFrame, forest: Forest | None, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Every row as ``row``, with the base statistics, base_failed, score and kept."""
    rows = df.select(F.struct("*").alias("row"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)] + [T.StructField(c, T.LongType()) for c in BASE] + [
        T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text"):
            base, features = statistics(texts_of(batch, "_text"))
            failed = base_fails(base)
            score = np.ones(len(base)) if forest is None else forest.predict(features)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(score),
                 pa.array(~failed & (score >= keep_from))], names=["row", *BASE, "base_failed", "score", "kept"])

    return rows.mapInArrow(run, schema)
