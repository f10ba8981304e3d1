"""Secret scans: a random forest removes the false positives of a candidate pattern.

Candidates are
- unbroken runs of at least ``LEAST`` letters, digits and ``_+/=-``, long words and
  rules of dashes among them; a name that assigns the rest of its run is not part of it;
- whole values after a naming word and a sign, of at least ``LEAST_VALUE`` characters of
  any kind: in quotes to the closing quote of the line, else to white space or to the
  name of the next assignment;
- passwords of that length in ``scheme://user:password@host``.
A run that is no whole value is a candidate beside the value it lies in.

Features: length, kinds of characters, mean
log chance of the character transitions, share covered by dictionary words,
hashed words before and after, and the hashed path.  Transitions are counted
over all texts; the dictionary is the ``DICTIONARY`` most frequent lower-case
words of all texts.  The forest is grown in numpy on labelled findings, at most
``TRAIN_ROWS`` of each class by the hash of their place, and kept as flat node
arrays.

Findings are (doc_id, start, length) in code points.  Where nobody has labelled
any, ``weak_labels`` marks those that a naming word or a URL assigns or that carry a
known key prefix, and leaves the forest to judge by the other features.  A run farther
inside a value and a short word of letters without quotes ("password: required") get no
label: they are judged, and nothing is learnt from them.

Defined cases: a null or empty text has no findings; a null path is a path of
its own; labels of one class only score that class for all, none score 0;
repeated rows give repeated findings; an empty table gives an empty table.
Only key, text and path are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm.common import bounded, raw_bytes, split_words, texts_of
from gazetteer.llm.quality import Forest

LEAST, LEAST_VALUE = 16, 6
DICTIONARY, TRAIN_ROWS = 2000, 3000
TREES, DEPTH, LEAF, BINS = 40, 8, 3, 24
WORD_CELLS, PATH_CELLS = 24, 8
SEED = 11

# What a candidate is, the words that assign secrets, prefixes of issued keys.
CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{%d,}" % LEAST)
NAMING = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"'`]?\]?\s*[=:]+>?\s*")
NAMING_PARTS = ("password", "passwd", "pwd", "secret", "token", "key")
QUOTED = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*+(?={q})") for q in "\"'`"}
BARE = re.compile(r"\S+")
CREDENTIAL = re.compile(r"://[^\s/:@]*:([^\s/]+)@")
PREFIXED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|xox[abprs]-|sk_live_|AIza[A-Za-z0-9_-]{35}$")


def values(text: str) -> dict[tuple[int, int], bool | None]:
    """(start, end) of every assigned value and URL password; None for one that a weak label cannot be drawn from."""
    low, names = text.lower(), []
    if any(part in low for part in NAMING_PARTS):
        names = list(NAMING.finditer(text))
    found: dict[tuple[int, int], bool | None] = {}
    bare_end = run_end = 0
    for i, m in enumerate(names):
        start, quote = m.end(), text[m.end(): m.end() + 1]
        closed = QUOTED[quote].match(text, start + 1) if quote in QUOTED else None
        if closed:
            start, end = closed.span()
        else:
            start += quote in QUOTED
            if start >= run_end:
                bare = BARE.match(text, start)
                run_end = bare.end() if bare else start
            if m.start() < bare_end:  # without a separator it is part of the value around it
                continue
            end = bare_end = run_end
            floor, j = start, i + 1
            while j < len(names) and names[j].start() < end:
                at = names[j].start()
                while at > floor and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
                    at -= 1
                if at > floor:
                    end = bare_end = at - 1
                floor, j = names[j].end(), j + 1
        if end - start >= LEAST_VALUE:
            plain = not closed and end - start < LEAST and text[start:end].isalpha()
            found[start, end] = None if plain else True
    for m in CREDENTIAL.finditer(text):
        if m.end(1) - m.start(1) >= LEAST_VALUE:
            found[m.span(1)] = True
    return found


def marked(text: str) -> list[tuple[int, str, str, str, bool | None]]:
    """The candidates in order of place, each with its weak label."""
    spans = values(text)
    opened = sorted(spans)
    starts, edges, reach = [v for v, _ in opened], sorted({at for v in opened for at in v}), list(accumulate((v for _, v in opened), max))
    for m in CANDIDATE.finditer(text):
        cuts = [m.start(), *edges[bisect_right(edges, m.start()): bisect_left(edges, m.end())], m.end()]
        for start, end in pairwise(cuts):
            name, sign, value = text[start:end].partition("=")
            bare = sign and name.replace("_", "").replace("-", "").isalpha()
            if start == m.start() and end == m.end() and bare and len(value.strip("=")) >= LEAST // 2:
                start += len(name) + 1
            elif end - start < LEAST or bare and not value and end < m.end():
                continue
            if (start, end) not in spans:
                at = bisect_right(starts, start)
                inside = at > 0 and reach[at - 1] >= end
                known = PREFIXED.match(text[start:end]) or inside and starts[at - 1] == start
                spans[start, end] = True if known else None if inside else False
    return [(start, text[start:end], text[max(0, start - 64): start], text[end: end + 32], label)
            for (start, end), label in sorted(spans.items(), key=lambda x: x[0])]


def candidates(text: str) -> list[tuple[int, str, str, str]]:
    """(start, candidate, text before, text after) of every candidate."""
    return [c[:4] for c in marked(text)]


def transitions(docs: DataFrame, text: str) -> np.ndarray:
    """Log chance of each next byte after each byte, over all texts; at most 65,536 counts reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in bounded(batches, "text"):
            data, offsets = raw_bytes(texts_of(batch, "text"))
            inside = np.ones(max(len(data) - 1, 0), bool)
            edges = offsets[1:-1] - 1
            inside[edges[(edges >= 0) & (edges < len(inside))]] = False
            pairs = data[:-1].astype(np.int64) * 256 + data[1:]
            total += np.bincount(pairs[inside], minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    made = np.zeros(65536)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        made[r["pair"]] = r["n"]
    made = made.reshape(256, 256) + 0.5
    return np.log(made / made.sum(1, keepdims=True))


def dictionary(docs: DataFrame, text: str) -> list[str]:
    """The most frequent lower-case words of three letters or more, over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 8 << 20):
            codes, words, _ = split_words(texts_of(batch, "text"))
            n = pa.array(np.bincount(codes, minlength=len(words)))
            plain = pc.match_substring_regex(words, r"^[a-z]{3,12}$")
            yield pa.RecordBatch.from_arrays([words.filter(plain).cast(pa.string()), n.filter(plain)], names=["word", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect())


def _cell(word: str, cells: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % cells


def features(body: str, before: str, after: str, path: str | None, chances: np.ndarray, words: frozenset[str]) -> list[float]:
    """Numbers of one candidate."""
    raw = np.frombuffer(body.encode(), np.uint8)
    kinds = [sum(map(test, body)) / len(body) for test in (str.islower, str.isupper, str.isdigit)]
    changes = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(body, body[1:], strict=False))
    low, covered, at = body.lower(), 0, 0
    while at < len(low):
        hit = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at: at + n] in words), 0)
        covered, at = covered + hit, at + max(hit, 1)
    near = np.zeros(2 * WORD_CELLS + PATH_CELLS)
    for side, part in ((0, re.findall(r"[A-Za-z]+", before)[-2:]), (1, re.findall(r"[A-Za-z]+", after)[:1])):
        for w in part:
            near[side * WORD_CELLS + _cell(w.lower(), WORD_CELLS)] += 1
    near[2 * WORD_CELLS + _cell(path or "", PATH_CELLS)] = 1
    return [float(len(body)), *kinds, float(sum(c in "_+/=-" for c in body)),
            float(sum(not c.isalnum() and c not in "_+/=-" for c in body)), len(set(body)) / len(body), changes / len(body),
            float(chances[raw[:-1], raw[1:]].mean()), covered / len(low), float(before[-1:] in ("=", '"', "'", ":")), *near]


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Trees on bootstrap samples with random feature subsets, split by Gini impurity; leaves hold class shares."""
    g = np.random.default_rng(SEED)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    nodes: list[list[float]] = []
    tried = max(1, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, level: int) -> int:
        me, n, ones = len(nodes), len(rows), y[rows].sum()
        nodes.append([-1, 0.0, -1, -1, ones / n])
        if level == DEPTH or ones in (0, n) or n < 2 * LEAF:
            return me
        best, choice = 2 * ones * (n - ones) / n - 1e-9, None
        for j in g.choice(x.shape[1], tried, replace=False):
            if not len(edges[j]):
                continue
            b = binned[rows, j]
            left = np.cumsum(np.bincount(b, minlength=len(edges[j]) + 1))[:-1]
            hit = np.cumsum(np.bincount(b, y[rows], len(edges[j]) + 1))[:-1]
            right, miss = n - left, ones - hit
            impurity = 2 * hit * (left - hit) / np.maximum(left, 1) + 2 * miss * (right - miss) / np.maximum(right, 1)
            impurity = np.where((left >= LEAF) & (right >= LEAF), impurity, np.inf)
            k = int(impurity.argmin())
            if impurity[k] < best:
                best, choice = impurity[k], (int(j), k)
        if choice is None:
            return me
        j, k = choice
        down = binned[rows, j] <= k
        nodes[me][0], nodes[me][1] = j, float(edges[j][k])
        nodes[me][2] = grow(rows[down], level + 1)
        nodes[me][3] = grow(rows[~down], level + 1)
        return me

    roots = [grow(g.integers(0, len(y), len(y)), 0) for _ in range(trees)]
    flat = np.array(nodes)
    return Forest(0.0, np.array(roots), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64),
                  flat[:, 3].astype(np.int64), flat[:, 4])


def vote(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Mean class share over the trees."""
    return forest.raw(x) / len(forest.roots)


def findings(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start, candidate, before, after, path, assigned."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(path).cast("string").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found = [(i, *c) for i, t in enumerate(texts_of(batch, "text").to_pylist()) for c in marked(t)]
            doc, start, body, before, after, assigned = (list(x) for x in zip(*found, strict=True)) if found else ([] for _ in range(6))
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(start, pa.int64()), pa.array(body, pa.string()), pa.array(before, pa.string()),
                 pa.array(after, pa.string()), batch.column(2).take(take), pa.array(assigned, pa.bool_())],
                names=["doc_id", "start", "candidate", "before", "after", "path", "assigned"])

    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("start", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("candidate", "before", "after", "path")),
        T.StructField("assigned", T.BooleanType())]))


def weak_labels(found: DataFrame) -> DataFrame:
    """(doc_id, start, label): 1 where a naming word, a URL or a key prefix marks the finding, null where nothing is known."""
    return found.select("doc_id", "start", F.col("assigned").cast("int").alias("label"))


def train(found: DataFrame, labels: DataFrame, chances: np.ndarray, words: list[str], most: int = TRAIN_ROWS) -> Forest | float:
    """Grow the forest on at most ``most`` labelled places (doc_id, start, label) of each label, one finding a place."""
    place, known = F.xxhash64("_doc", "_start"), frozenset(words)
    marked = labels.where("label IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), "label")
    marked = marked.distinct()
    few = marked.where("label = 0").orderBy(place, "_doc", "_start").limit(most).unionByName(
        marked.where("label = 1").orderBy(place, "_doc", "_start").limit(most))
    rows = found.join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("start") == F.col("_start")))
    rows = rows.groupBy("_doc", "_start", "label").agg(F.min(F.struct("candidate", "before", "after", "path")).alias("least"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, label = (c.to_pylist() for c in batch.columns)
            made = [list(map(float, features(*row, chances, known))) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), pa.array(label, pa.int32())], names=["f", "y"])

    rows = rows.select("least.candidate", "least.before", "least.after", "least.path", F.col("label").cast("int")).mapInArrow(
        measure, "f array<double>, y int").collect()  # one row a place, numbers only
    rows = sorted((r["f"], r["y"]) for r in rows)
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.0
    return grow_forest(np.array([r[0] for r in rows]), y)


def judge(found: DataFrame, forest: Forest | float, chances: np.ndarray, words: list[str], threshold: float = 0.5) -> DataFrame:
    """Findings with score and is_secret."""
    known = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                columns = [c.to_pylist() for c in batch.columns[2:6]]
                chance = (np.full(batch.num_rows, forest) if isinstance(forest, float) else vote(
                    forest, np.array([features(*row, chances, known) for row in zip(*columns, strict=True)])))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pc.utf8_length(batch.column(2)).cast(pa.int64()), pa.array(chance), pa.array(chance >= threshold)],
                    names=["doc_id", "start", "candidate", "length", "score", "is_secret"])

    return found.select("doc_id", "start", "candidate", "before", "after", "path").mapInArrow(run, T.StructType([
        *[found.schema[c] for c in ("doc_id", "start", "candidate")], T.StructField("length", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("is_secret", T.BooleanType())]))
