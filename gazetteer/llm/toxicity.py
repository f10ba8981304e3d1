"""Toxicity scores from a bidirectional gated recurrent network with attention, trained in numpy.

A word enters as two vectors: an embedding of the word, for words that
training met in several documents, and the mean embedding of its hashed
character trigrams.  A network with gated recurrent units reads each window of
words in both directions; attention pools its states into one vector and a
logistic unit scores it.  Overlapping windows start every ``STRIDE`` words, so
that a passage of up to 49 words lies whole in one of them; all are scored and
the text takes the largest logit.

Training takes at most ``TRAIN_ROWS`` labelled documents of each class (those
with the smallest hash of their id; texts over ``TRAIN_BYTES`` are left out of
this sample only), first on windows drawn at random, then on
each document's highest window.  The output is shifted to the share of class 1
among all labels that may be learned from.  Scoring reads the text alone, in
Arrow batches of bounded size; input projections are computed once per distinct
word of a batch.

Defined cases: a null or empty text has no window and scores what the network
gives an empty pool; labels of one class only, or none, score 0 or 1 for all
(0 without labels); a null id is not held out; repeated rows get equal scores;
an empty table gives an empty table.  Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm.common import bounded, raw_bytes, split_words, texts_of
from gazetteer.llm.quality import training_rows

TRAIN_ROWS, TRAIN_BYTES = 800, 1 << 16
VOCABULARY, LEAST_DOCUMENTS, TRIGRAMS = 20_000, 3, 4096
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 12, 12, 8, 8
WINDOW, STRIDE = 64, 16
RANDOM_STEPS, HIGHEST_STEPS, REFRESH, RATE, STEP = 60, 90, 30, 0.01, 128
CHUNK = 512
THRESHOLD = 0.3
SEED = 7
EDGES = ".,;:!?\"'()[]{}<>*_-"


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _bare(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), EDGES)


def _trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of ``^word$`` and where each word's begin."""
    framed = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x
                                           for x in ("^", words, "$", "")))
    data, offsets = raw_bytes(framed)
    big = data.astype(np.uint32)
    hashed = ((big[:-2] * 961 + big[1:-1] * 31 + big[2:]) * np.uint32(2654435761) >> np.uint32(20)) if len(big) > 2 else big[:0]
    counts = np.maximum(np.diff(offsets) - 2, 0)
    begin = np.cumsum(counts) - counts
    at = np.repeat(offsets[:-1] - begin, counts) + np.arange(counts.sum())
    # a lone "^$" has no trigram and borrows the first bucket
    if (counts == 0).any():
        grams = np.insert(hashed[at], begin[counts == 0], 0)
        begin = begin + np.cumsum(counts == 0) - (counts == 0)
        return grams.astype(np.int64), begin
    return hashed[at].astype(np.int64), begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    vocabulary: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    def __post_init__(self):
        if self.p:
            return
        g = np.random.default_rng(SEED)
        make = lambda *s, scale=0.1: (g.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "words": make(len(self.vocabulary) + 1, WORD_SIZE), "chars": make(TRIGRAMS, CHAR_SIZE),
            "input": make(2, WORD_SIZE + CHAR_SIZE, 3 * HIDDEN, scale=0.3), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "state": make(2, HIDDEN, 3 * HIDDEN, scale=0.3), "look": make(2 * HIDDEN, ATTENTION, scale=0.3),
            "weigh": make(ATTENTION, scale=0.3), "out": make(2 * HIDDEN, scale=0.3), "base": np.zeros(1, np.float32)}

    def word_rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary row (0: unknown) of each distinct word, its trigrams and where they begin."""
        bare = _bare(words)
        known = pc.fill_null(pc.index_in(bare, value_set=pa.array(self.vocabulary, bare.type)), -1)
        return known.to_numpy(zero_copy_only=False).astype(np.int64) + 1, *_trigrams(bare)

    def inputs(self, rows: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        if not len(rows):
            return np.zeros((0, WORD_SIZE + CHAR_SIZE), np.float32)
        counts = np.diff(np.append(begin, len(grams)))[:, None]
        chars = np.add.reduceat(self.p["chars"][grams], begin, axis=0) / counts
        return np.concatenate([self.p["words"][rows], chars], 1).astype(np.float32)

    def forward(self, codes: np.ndarray, lengths: np.ndarray, vectors: np.ndarray, keep: bool = False):
        """Logits of windows given as codes (n, t) into word vectors; positions past a length do not count."""
        p = self.p
        n, t = codes.shape
        table = np.matmul(vectors[None], p["input"]) + p["bias"]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((t, 2, n, HIDDEN), np.float32)
        ragged = bool((lengths < t).any())
        live = (np.arange(t)[None, :] < lengths[:, None])
        saved = []
        for i in range(t):
            j = t - 1 - i
            a = np.stack([table[0].take(codes[:, i], 0), table[1].take(codes[:, j], 0)])
            hu = np.matmul(h, p["state"])
            gates = _sigmoid(a[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
            z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
            new = np.tanh(a[..., 2 * HIDDEN:] + r * hu[..., 2 * HIDDEN:])
            nxt = new + z * (h - new)
            if ragged:
                on = np.stack([live[:, i], live[:, j]])[..., None]
                nxt = np.where(on, nxt, h)
            if keep:
                saved.append((h, z, r, new, hu[..., 2 * HIDDEN:], on if ragged else None))
            h = nxt
            states[i, 0], states[j, 1] = h[0], h[1]
        both = states.transpose(2, 0, 1, 3).reshape(n, t, 2 * HIDDEN)
        looked = np.tanh(both @ p["look"])
        score = np.where(live, looked @ p["weigh"], np.float32(-1e9))
        score = np.exp(score - score.max(1, keepdims=True)) * live
        share = score / np.maximum(score.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,ntk->nk", share, both)
        logit = pooled @ p["out"] + p["base"][0]
        return (logit, (saved, both, looked, share, pooled)) if keep else logit

    def full_windows(self, vectors: np.ndarray):
        """Function from codes (n, t) of windows without padding to logits; as ``forward``, in reused buffers."""
        p, size = self.p, HIDDEN
        table = np.matmul(vectors[None], p["input"]) + p["bias"]
        # a sigmoid is a tanh of half its input
        gate_table = np.ascontiguousarray(table[..., : 2 * size] * np.float32(0.5)).reshape(-1, 2 * size)
        new_table = np.ascontiguousarray(table[..., 2 * size:]).reshape(-1, size)
        gate_state = np.ascontiguousarray(p["state"][..., : 2 * size] * np.float32(0.5))
        new_state = np.ascontiguousarray(p["state"][..., 2 * size:])
        words, half = len(vectors), np.float32(0.5)

        def run(codes: np.ndarray) -> np.ndarray:
            n, t = codes.shape
            steps = np.stack([codes.T, codes.T[::-1] + words], 1)
            states = np.empty((t, 2, n, size), np.float32)
            gates, hidden = np.empty((2, n, 2 * size), np.float32), np.empty((2, n, 2 * size), np.float32)
            new, through = np.empty((2, n, size), np.float32), np.empty((2, n, size), np.float32)
            h = np.zeros((2, n, size), np.float32)
            for i in range(t):
                np.take(gate_table, steps[i], axis=0, out=gates, mode="clip")
                np.matmul(h, gate_state, out=hidden)
                gates += hidden
                np.tanh(gates, out=gates)
                gates *= half
                gates += half
                np.matmul(h, new_state, out=through)
                through *= gates[..., size:]
                np.take(new_table, steps[i], axis=0, out=new, mode="clip")
                new += through
                np.tanh(new, out=new)
                h -= new
                h *= gates[..., :size]
                h += new
                states[i, 0], states[t - 1 - i, 1] = h[0], h[1]
            looked = np.matmul(states[:, 0], p["look"][:size])
            looked += np.matmul(states[:, 1], p["look"][size:])
            np.tanh(looked, out=looked)
            weight = looked @ p["weigh"]
            weight = np.exp(weight - weight.max(0))
            value = states[:, 0] @ p["out"][:size] + states[:, 1] @ p["out"][size:]
            return (weight * value).sum(0) / weight.sum(0) + p["base"][0]

        return run

    def backward(self, codes, vectors, d_logit, memory) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all weights but the embeddings, and of the word vectors."""
        saved, both, looked, share, pooled = memory
        p, (n, t) = self.p, codes.shape
        g = {"out": pooled.T @ d_logit, "base": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_both = share[..., None] * d_pooled[:, None, :]
        d_share = np.einsum("ntk,nk->nt", both, d_pooled)
        d_score = share * (d_share - (d_share * share).sum(1, keepdims=True))
        g["weigh"] = np.einsum("nt,nta->a", d_score, looked)
        d_look = d_score[..., None] * p["weigh"] * (1 - looked**2)
        g["look"] = both.reshape(-1, 2 * HIDDEN).T @ d_look.reshape(-1, ATTENTION)
        d_both = d_both + d_look @ p["look"].T
        d_states = d_both.reshape(n, t, 2, HIDDEN)
        d_inputs = np.empty((2, n, t, 3 * HIDDEN), np.float32)
        g["state"] = np.zeros_like(p["state"])
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            j = t - 1 - i
            h, z, r, new, hun, on = saved[i]
            dh = dh + np.stack([d_states[:, i, 0], d_states[:, j, 1]])
            through = dh if on is None else dh * on
            d_new = through * (1 - z) * (1 - new**2)
            d_z = through * (h - new) * z * (1 - z)
            d_r = d_new * hun * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], -1)
            d_hu = np.concatenate([d_z, d_r, d_new * r], -1)
            g["state"] += np.matmul(h.transpose(0, 2, 1), d_hu)
            back = through * z + np.matmul(d_hu, p["state"].transpose(0, 2, 1))
            dh = back if on is None else np.where(on, back, dh)
            d_inputs[0, :, i], d_inputs[1, :, j] = d_in[0], d_in[1]
        order = np.argsort(codes, axis=None, kind="stable")
        first = np.flatnonzero(np.diff(codes.ravel()[order], prepend=-1))
        d_table = np.zeros((2, len(vectors), 3 * HIDDEN), np.float32)
        d_table[:, codes.ravel()[order[first]]] = np.add.reduceat(
            d_inputs.reshape(2, n * t, 3 * HIDDEN)[:, order], first, axis=1)
        g["bias"] = d_table.sum(1, keepdims=True)
        g["input"] = np.matmul(vectors.T[None], d_table)
        return g, np.matmul(d_table, p["input"].transpose(0, 2, 1)).sum(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Chance of class 1 for each text: its highest window's logit, shifted."""
        codes, words, starts = split_words(texts)
        vectors = self.inputs(*self.word_rows(words))
        best = np.full(len(texts), -np.inf, np.float32)
        sizes = np.diff(starts)
        best[sizes == 0] = self.p["base"][0]
        long = np.flatnonzero(sizes >= WINDOW)
        begins = [starts[d] + np.array(windows(int(sizes[d]))) for d in long]
        owner = np.repeat(long, [len(b) for b in begins])
        begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        logits = self.full_windows(vectors)
        for low in range(0, len(begin), CHUNK):
            own = begin[low: low + CHUNK, None] + np.arange(WINDOW)
            np.maximum.at(best, owner[low: low + CHUNK], logits(codes[own]))
        short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
        short = short[np.argsort(sizes[short], kind="stable")]
        for low in range(0, len(short), CHUNK):
            docs = short[low: low + CHUNK]
            n = sizes[docs]
            at = np.minimum(starts[docs][:, None] + np.arange(n.max()), len(codes) - 1)
            best[docs] = self.forward(codes[at], n, vectors)
        return 1 / (1 + np.exp(-(best.astype(np.float64) + self.shift)))


def fit(texts: list[str], labels: np.ndarray, share: float | None = None) -> Network:
    """Train on whole texts; ``share`` is the part of class 1 that scores should reflect."""
    array = pa.array(texts, pa.large_string())
    codes, words, starts = split_words(array)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    bare = _bare(words).dictionary_encode()
    name = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    met = np.bincount(np.unique(name[codes] * len(texts) + owner) // len(texts), minlength=len(bare.dictionary))
    often = np.lexsort((np.arange(len(met)), -met))[:VOCABULARY]
    network = Network([bare.dictionary[int(i)].as_py() for i in often if met[i] >= LEAST_DOCUMENTS])
    rows, grams, begin = network.word_rows(words)
    g = np.random.default_rng(SEED)
    docs = np.flatnonzero(np.diff(starts))
    spans = {int(d): starts[d] + np.array(windows(int(starts[d + 1] - starts[d]))) for d in docs}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    steps = 0

    def learn(at: np.ndarray, doc: np.ndarray) -> None:
        nonlocal steps
        n = np.minimum(WINDOW, starts[doc + 1] - at)
        own = codes[np.minimum(at[:, None] + np.arange(n.max()), len(codes) - 1)]
        used, own = np.unique(own, return_inverse=True)
        own = own.reshape(len(at), -1)
        counts = np.diff(np.append(begin, len(grams)))[used]
        pick = np.repeat(begin[used] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        own_begin = np.cumsum(counts) - counts
        vectors = network.inputs(rows[used], grams[pick], own_begin)
        logit, memory = network.forward(own, n, vectors, keep=True)
        d = ((_sigmoid(logit) - labels[doc]) / len(doc)).astype(np.float32)
        grad, d_vectors = network.backward(own, vectors, d, memory)
        grad["words"], grad["chars"] = np.zeros_like(network.p["words"]), np.zeros_like(network.p["chars"])
        np.add.at(grad["words"], rows[used], d_vectors[:, :WORD_SIZE])
        np.add.at(grad["chars"], grams[pick], np.repeat(d_vectors[:, WORD_SIZE:] / counts[:, None], counts, 0))
        steps += 1
        for k, v in network.p.items():
            m, s = moments[k]
            m += 0.1 * (grad[k] - m)
            s += 0.001 * (grad[k] ** 2 - s)
            v -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)

    while steps < RANDOM_STEPS + HIGHEST_STEPS and len(docs):
        for again in range(1 if steps < RANDOM_STEPS else -(-REFRESH * STEP // len(docs))):
            if steps < RANDOM_STEPS:
                at = np.array([spans[int(d)][g.integers(len(spans[int(d)]))] for d in docs])
            elif again == 0:
                at = _highest(network, codes, rows, grams, begin, spans, docs, starts)
            order = g.permutation(len(docs))
            for low in range(0, len(docs), STEP):
                part = order[low: low + STEP]
                learn(at[part], docs[part])
    own = float(labels.mean())
    if share is not None and 0 < share < 1:
        network.shift = float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return network


def _highest(network, codes, rows, grams, begin, spans, docs, starts) -> np.ndarray:
    """Start of each document's highest window."""
    vectors = network.inputs(rows, grams, begin)
    all_at = np.concatenate([spans[int(d)] for d in docs])
    of = np.repeat(docs, [len(spans[int(d)]) for d in docs])
    logit = np.empty(len(all_at), np.float32)
    for low in range(0, len(all_at), CHUNK):
        at = all_at[low: low + CHUNK]
        n = np.minimum(WINDOW, starts[of[low: low + CHUNK] + 1] - at)
        own = codes[np.minimum(at[:, None] + np.arange(n.max()), len(codes) - 1)]
        logit[low: low + CHUNK] = network.forward(own, n, vectors)
    order = np.lexsort((-logit, of))
    first = np.concatenate([[True], of[order][1:] != of[order][:-1]])
    return all_at[order[first]]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
          most: int = TRAIN_ROWS) -> Network | float:
    """Fit on a bounded sample outside the held-out fold; a constant where there is one class or none."""
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    counts = usable.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("ones")).first()
    rows = training_rows(docs, usable, label, text, key, most, TRAIN_BYTES).select("id", F.coalesce("x", F.lit("")).alias("x"), "y").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    y = np.array([r["y"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.0
    return fit([r["x"] for r in rows], y, counts["ones"] / counts["n"])


def score(df: DataFrame, network: Network | float, text: str = "text", key: str = "doc_id",
          threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(key)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts = texts_of(batch, "text")
            chance = np.full(len(texts), network) if isinstance(network, float) else network.score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(chance), pa.array((chance >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
