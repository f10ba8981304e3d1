"""Source divergence audit by Gustavson row accumulation.

Terms are runs of letters A-Z, a-z and characters beyond ASCII; only A-Z are
lower-cased.  A language keeps the V terms that at least ``least_docs`` of its
documents hold.  A group (language and source) gives a kept term with ``count``
occurrences p = 1 + floor(10^9 (count + 2) / (N + 2 V)), where N sums its counts;
the language as a whole does the same.  Two groups differ at a term by
f(p, q) = floor((p - q)^2 / (p + q)).

Pairs of groups: a term that a group lacks has the group's baseline z, so with
all terms at their baselines a pair's sum is V f(z, z').  Terms of one group move
it by counts alone, taken from the group's histogram of counts; terms of both are
corrected one by one.  For these, tasks hold slices of the term-major index
(each term's postings lie together); every group scatters its terms of the slice
through the index into a dense accumulator over the slice's groups.  What leaves
a task is one sum per pair of groups and slice, never a pair of postings.

All sums are exact integers; N stays exact up to 9 * 10^15 words a group.
A slice holds about ``SLICE`` postings and at least one term, so a task holds no
more than a slice and one term's postings (at most one per source).

Defined cases: null text, language or source count as empty strings; a group
without terms, or without kept ones, has N = 0 and stays in all pairs; a language
without kept terms has the value 0 for its pairs and no term rows; a language
with one source has no pairs; repeated rows are documents of their own; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetteer.llm.common import bounded, raw_bytes, split_words, texts_of, written

LEAST_DOCS, TOP_TERMS = 10, 10
COUNT_BYTES = 8 << 20
SLICE, SCATTER = 1 << 17, 1 << 20

_FOLD = np.full(256, 32, np.uint8)  # separators become spaces, A-Z lower case
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a batch."""
    for batch in bounded(batches, "text", COUNT_BYTES):
        body, ends = raw_bytes(texts_of(batch, "text"))
        folded = pa.LargeStringArray.from_buffers(
            batch.num_rows, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(_FOLD[body]))
        codes, words, starts = split_words(folded)
        if not len(codes):
            continue
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        width = len(words)
        keys, n = np.unique(group[row] * width + codes, return_counts=True)
        once = np.unique(row * width + codes)
        docs = np.unique(group[once // width] * width + once % width, return_counts=True)[1]
        of, term = keys // width, keys % width
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(of // len(source.dictionary))),
             source.dictionary.take(pa.array(of % len(source.dictionary))),
             words.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)],
            names=["lang", "source", "term", "n", "docs"])


def kept_postings(df: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, total, lead) of kept terms; ``lead`` marks one row of each term."""
    found = df.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    first = F.row_number().over(term.orderBy("source")) == 1
    found = found.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("_docs"),
                         F.sum("n").over(term).alias("total"), first.alias("lead"))
    return found.where(F.col("_docs") >= least_docs).drop("_docs")


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)) by long division, three digits at a time."""
    whole = n + 2 * v
    rest, share = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        share, rest = share * 1000 + F.call_function("div", rest, whole), rest % whole
    return F.when(v > 0, share + 1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _np_apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cut sorted postings into slices that end where a term does."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < SLICE:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        last = pc.and_(pc.equal(whole["lang"], whole["lang"][rows - 1]), pc.equal(whole["term"], whole["term"][rows - 1]))
        cut = int(np.argmax(last.to_numpy()))
        if cut:
            yield whole.slice(0, cut)
        held, rows = [whole.slice(cut)], rows - cut
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs for the terms both groups hold, one row per pair of groups and slice."""
    for part in _slices(batches):
        lang, source = (part[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        lang, source = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lang, source))
        of = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, peer = np.unique(of, return_inverse=True)
        p, z = part["p"].to_numpy(), part["z"].to_numpy()
        new = np.ones(len(p), bool)
        for column in ("lang", "term"):
            values = part[column].combine_chunks()
            differs = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = differs if column == "lang" else new[1:] | differs
        starts = np.append(np.flatnonzero(new), len(p))
        term = np.cumsum(new) - 1
        order = np.argsort(peer, kind="stable")
        bounds = np.searchsorted(peer[order], np.arange(len(groups) + 1))
        left, right, sums = [], [], []
        for g in range(len(groups)):
            total = np.zeros(len(groups), np.int64)
            own = order[bounds[g]: bounds[g + 1]]
            sizes = starts[term[own] + 1] - starts[term[own]]
            ends = np.cumsum(sizes)
            low = 0
            while low < len(own):
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + SCATTER, side="right")))
                n, mine = sizes[low:high], own[low:high]
                at = np.repeat(starts[term[mine]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                mine = np.repeat(mine, n)
                move = (_np_apart(p[mine], p[at]) - _np_apart(p[mine], z[at])
                        - _np_apart(z[mine], p[at]) + _np_apart(z[mine], z[at]))
                np.add.at(total, peer[at], move)
                low = high
            total[g] = 0
            met = np.flatnonzero(total)
            left.append(np.full(len(met), g))
            right.append(met)
            sums.append(total[met])
        a, b = groups[np.concatenate(left)], groups[np.concatenate(right)]
        width = len(source.dictionary)
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(a // width)), source.dictionary.take(pa.array(a % width)),
             source.dictionary.take(pa.array(b % width)), pa.array(np.concatenate(sums))],
            names=["lang", "source", "item", "value"])


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of parts ``pair`` and ``term``."""
    rows = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))],
                     F.col(text).alias("text"))
    kept = written(kept_postings(rows, least_docs))
    # A group's histogram of counts gives its total and what its own terms move.
    hist = written(kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")))
    totals = hist.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("words"))
    langs = kept.where("lead").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_words"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("words", "v", "all_words")])
    groups = written(groups.withColumn("z", _share(F.lit(0).cast("long"), F.col("words"), F.col("v"))))

    own = hist.join(groups, ["lang", "source"]).groupBy("lang", "source").agg(F.collect_list(
        F.struct(_share(F.col("n"), F.col("words"), F.col("v")).alias("p"), "terms")).alias("own"))
    peers = groups.groupBy(F.col("lang").alias("_lang")).agg(F.collect_list(F.struct("source", "z")).alias("peers"))
    row = groups.join(own, ["lang", "source"], "left").join(peers, F.col("lang") == F.col("_lang"))

    def moved(peer: Column) -> Column:
        still = _apart(F.col("z"), peer["z"])
        return F.aggregate(F.coalesce("own", F.array().cast("array<struct<p:long,terms:long>>")), F.lit(0).cast("long"),
                           lambda sofar, h: sofar + h["terms"] * (_apart(h["p"], peer["z"]) - still))

    based = row.select("lang", "source", F.explode(F.transform("peers", lambda peer: F.struct(
        peer["source"].alias("item"), F.coalesce(moved(peer), F.lit(0)).alias("moved"),
        F.coalesce(F.col("v") * _apart(F.col("z"), peer["z"]), F.lit(0)).alias("still")))).alias("pair"))
    based = based.select("lang", "source", "pair.*").where("item <> source")

    placed = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("words"), F.col("v")))
    index = placed.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term")
    shared = index.mapInArrow(_scatter, "lang string, source string, item string, value long")
    pairs = based.select("lang", "source", "item", (F.col("moved") + F.col("still")).alias("value"))
    pairs = pairs.unionByName(based.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                                           F.col("moved").alias("value")))
    pairs = pairs.unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = _share(F.col("total"), F.col("all_words"), F.col("v"))
    terms = placed.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", _apart(F.col("p"), F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank"))
    return pairs.unionByName(terms.where(F.col("rank") <= top_terms))
