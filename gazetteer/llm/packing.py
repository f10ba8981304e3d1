"""Packing by power-of-two decomposition: no sequence crosses documents.

A document's tokens are cut into pieces whose lengths are powers of two: as
many of ``max_length`` as fit, then the binary digits of the rest, largest
first.  Each piece is a sequence of its own without padding; ``bucket`` is the
exponent of its length, and batches are drawn from one bucket, whose sequences
are all equally long.

Tokens are those of a byte-level BPE file of the tokenizers library; texts that
hold its special tokens go through that library, others through the same
merges in tiktoken, which gives the same ids.  The tokenizer's pre-tokens never cross a single space between two
characters that are not white space, so a text splits there and each distinct
chunk of a batch is encoded once and kept in a bounded cache.  A text with any
other space is encoded whole.

Defined cases: a null or empty text has the end token alone; repeated rows are
packed once each; an empty table gives an empty table; columns other than key
and text are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm.common import bounded, texts_of

MAX_LENGTH = 2048
END_TOKEN = 1
CACHE_ENTRIES = 200_000

# White space of the tokenizer's pattern, and a few controls beside it that only cost time.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{180E}\p{Z}]"


# Fixed value: the pattern of byte-level pre-tokenizers.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _merges(tokenizer) -> tiktoken.Encoding:
    """The tokenizer's vocabulary as merge ranks, which its ids are; several times as fast on short chunks.

    A byte-level vocabulary writes printable bytes as themselves and the others,
    in order, as the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    added = tokenizer.get_added_tokens_decoder()
    ranks = {bytes(byte[c] for c in word): i for word, i in tokenizer.get_vocab().items() if i not in added}
    return tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of many texts, through a cache of chunks.

    The cache keeps the first ``CACHE_ENTRIES`` chunks it meets; later ones
    are held for their batch alone.
    """

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = _merges(self.tokenizer)
        self.place: dict[str, int] = {}  # chunk -> row of sizes
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids one after another."""
        merge, special = self.merges.encode_ordinary, self.special
        found = [merge(t) for t in texts]
        together = "\0".join(texts)
        if any(x in together for x in special):
            for i, t in enumerate(texts):
                if any(x in t for x in special):
                    found[i] = self.tokenizer.encode(t, add_special_tokens=False).ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def _chunks(self, chunks: list[str], whole: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the chunks, then of the whole texts, in (sizes, ids)."""
        place = self.place
        rows = [place.get(c, -1) for c in chunks]
        new = [c for c, r in zip(chunks, rows, strict=True) if r < 0]
        rows = np.array(rows + [-1] * len(whole), np.int64)
        known = len(self.sizes)
        rows[rows < 0] = known + np.arange(len(new) + len(whole))
        sizes, ids = self._encoded(new + whole)
        stay = min(len(new), max(0, CACHE_ENTRIES - known))
        all_sizes, all_ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        place.update(zip(new[:stay], range(known, known + stay), strict=True))
        if stay:
            self.sizes, self.ids = all_sizes[: known + stay], all_ids[: len(self.ids) + int(sizes[:stay].sum())]
        return rows, all_sizes, all_ids

    def encode(self, texts: pa.Array, end_token: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end token, and where each text's begin (with the end)."""
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        bad_start, bad_end = (pc.match_substring_regex(flat.dictionary, p).to_numpy(zero_copy_only=False)
                              for p in (rf"\A(?:\z|{_SPACE})", rf"(?:\A|{_SPACE})\z"))
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
        bad = np.zeros(len(code), bool)
        bad[1:] = ~fresh[1:] & (bad_start[code[1:]] | bad_end[code[:-1]])
        odd = np.zeros(len(texts), bool)
        odd[owner[bad]] = True

        form = code * 2 + ~fresh  # the same piece with and without a space before it
        seen = np.zeros(2 * len(flat.dictionary), bool)
        whole = np.flatnonzero(odd)
        if len(whole):
            keep = ~odd[owner]
            form, owner = form[keep], owner[keep]
        seen[form] = True
        used = np.flatnonzero(seen)
        pieces = flat.dictionary.to_pylist()
        rows, sizes, ids = self._chunks([" " + pieces[u >> 1] if u & 1 else pieces[u >> 1] for u in used.tolist()],
                                        [texts[int(i)].as_py() for i in whole])
        number = np.empty(len(seen), np.int64)
        number[used] = rows[: len(used)]
        # one unit per chunk, or per text that is encoded whole, in text order, and the end token's
        sizes, ids = np.append(sizes, 1), np.append(ids, np.uint32(end_token))
        unit = number[form]
        if len(whole):
            unit, owner = np.concatenate([unit, rows[len(used):]]), np.concatenate([owner, whole])
            order = np.argsort(owner, kind="stable")
            unit, owner = unit[order], owner[order]
        unit = np.insert(unit, np.cumsum(np.bincount(owner, minlength=len(texts))), len(sizes) - 1)
        n = sizes[unit]
        stop = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[unit] - (stop - n), n)
        at += np.arange(len(at))
        bounds = np.concatenate([[0], stop[unit == len(sizes) - 1]])
        return ids[at], bounds


def piece_lengths(tokens: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of a document's pieces, in order."""
    full, rest = divmod(tokens, max_length)
    return [max_length] * full + [1 << e for e in range(max_length.bit_length() - 2, -1, -1) if rest >> e & 1]


def pack(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", max_length: int = MAX_LENGTH,
         end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids.

    ``ids`` are the piece's tokens as little-endian 32-bit numbers.
    """
    if max_length & (max_length - 1):
        raise ValueError("the longest length must be a power of two")
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for batch in bounded(batches, "text"):
            ids, bounds = encoder.encode(texts_of(batch, "text"), end_token)
            ids = ids.astype("<u4", copy=False)
            tokens = np.diff(bounds)
            lengths = [piece_lengths(int(t), max_length) for t in tokens]
            counts = np.array([len(x) for x in lengths])
            length = np.array([x for own in lengths for x in own], np.int64)
            doc = np.repeat(np.arange(len(tokens)), counts)
            stop = np.cumsum(length)
            begin = stop - length
            offsets = np.concatenate([[0], stop]).astype(np.int64) * 4
            body = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(begin - bounds[doc]), pa.array(length), pa.array(tokens[doc]),
                 pa.array(np.log2(length).astype(np.int32)), body.cast(pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])

    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    pieces = rows.mapInArrow(run, schema)
    return pieces.select("doc_id", "start", "length", "doc_tokens", "bucket",
                         F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)
