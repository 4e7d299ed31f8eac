"""Operator 2: byte-level BPE encoding and decoding in padded numpy matrices.

Words of one length class form one matrix, a row per word. Every round each row merges its
leftmost pair of least rank: ranks come from an open-addressing hash table over pairs, rows move
left over the gap, and rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import Numbered, binaries, lists, map_batches, offsets_of, ragged, read, texts_of
from cohortlens.session import tune

NONE = np.int32(2**31 - 1)
CELLS = 2_000_000  # of one matrix
LONG = 256  # bytes; longer words are merged one by one
KEPT = 300_000  # different chunks kept from batch to batch
KEPT_CHARS = 30_000_000


class PairTable:
    """Rank of a pair of ids: hash table with linear probing, looked up for whole arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(2 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.mask = size - 1
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, todo = self._slots(pairs), np.arange(len(pairs))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.ranks[at[placed]] = pairs[placed], ranks[placed]
            todo = todo[self.keys[at[todo]] != pairs[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a side is negative or the pair is unknown."""
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._slots(keys[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(left.shape)


class Vocabulary:
    """A rank file: tokens by id, and the rank of every pair that forms a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = offsets_of(self.lengths)[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[t[:i]] << 32 | ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        keys = np.array([p for p, _ in pairs], np.int64)
        self.pairs = PairTable(keys, np.array([r for _, r in pairs], np.int32))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each."""
        lengths = np.array([len(w) for w in words], np.int64)
        out: list[np.ndarray | None] = [np.zeros(0, np.int32)] * len(words)
        width = 1
        for at in np.flatnonzero(lengths > LONG):
            out[at] = self._one(words[at])
        while width <= LONG:
            rows = np.flatnonzero((lengths <= width) & (lengths > width // 2) & (lengths > 0))
            for i in range(0, len(rows), max(1, CELLS // width)):
                some = rows[i: i + max(1, CELLS // width)]
                for at, ids in zip(some, self._matrix([words[j] for j in some], width), strict=True):
                    out[at] = ids
            width *= 2
        counts = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    def _matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.full((len(words), width + 1), -1, np.int32)
        data = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.repeat(np.arange(len(words)), sizes), ragged(np.zeros(len(words)), sizes)] = data
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        rows, columns = np.arange(len(words)), np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(1)  # the first of equal ranks is the leftmost
            least = ranks[np.arange(len(rows)), at]
            ended = least == NONE
            for i in np.flatnonzero(ended):
                done[rows[i]] = ids[i, : sizes[i]].copy()
            rows, ids, ranks, at, least, sizes = (x[~ended] for x in (rows, ids, ranks, at, least, sizes))
            if not len(rows):
                break
            sizes = sizes - 1
            each = np.arange(len(rows))
            ids[each, at] = least
            gap = columns + (columns > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), gap, 1)
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), gap[:, :width], 1)
            ranks[each, at] = self.pairs(ids[each, at], ids[each, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs(ids[left, at[left] - 1], ids[left, at[left]])
            widest = int(sizes.max()) + 1
            if widest <= len(columns) // 2:
                ids, columns, width = ids[:, :widest], columns[:widest], widest - 1
                ranks = ranks[:, :width]
                if width == 0:
                    ranks = np.full((len(rows), 1), NONE, np.int32)
        return done

    def _one(self, word: bytes) -> np.ndarray:
        """A long word as a matrix of one row; a round merges all repeats of its least pair, left to right.

        Merging one of them forms no pair of less rank, so these are the merges of the next rounds.
        """
        ids = self.of_byte[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            ranks = self.pairs(ids[:-1], ids[1:])
            least = ranks.min()
            if least == NONE:
                break
            at = np.flatnonzero(ranks == least)
            new = np.concatenate([[True], np.diff(at) > 1])
            first = np.maximum.accumulate(np.where(new, at, 0))
            at = at[(at - first) % 2 == 0]  # of overlapping pairs every other one
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the lists one after the other, and the number of bytes of each."""
        lengths = self.lengths[ids]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        edges = offsets_of(counts)
        return self.bytes[ragged(self.starts[ids], lengths)], sums[edges[1:]] - sums[edges[:-1]]


#: Where cutting before every space could part a run of white space that the pattern takes whole.
_RUN = re.compile(r"\s \s|\s \Z")


class Encoder:
    """Texts to ids. Different chunks are encoded once and kept, up to ``KEPT`` of them."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = vocabulary(path)
        self.match = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.index, self.chars = Numbered(), 0
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _chunks(self, text: str) -> list[str]:
        """Parts that the pattern never crosses: a word with the space before it, or a match."""
        if "\0" in text or _RUN.search(text):
            return self.match(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > KEPT or self.chars > KEPT_CHARS:
            self._clear()
        parts = [self._chunks(t) if t else [] for t in texts]
        codes = self.index.codes(parts)
        fresh = list(self.index)[len(self.counts):]
        if fresh:
            self.chars += sum(map(len, fresh))
            words = [[m.encode("utf-8", "surrogatepass") for m in self.match(c)] for c in fresh]
            distinct = Numbered()
            each = distinct.codes(words)
            ids, counts = self.vocabulary.encode_words(list(distinct))
            starts = offsets_of(counts)[:-1]
            new = ids[ragged(starts[each], counts[each])]
            sums = np.concatenate([[0], np.cumsum(counts[each])])
            edges = offsets_of(np.array([len(w) for w in words]))
            self.ids = np.concatenate([self.ids, new])
            self.counts = np.concatenate([self.counts, sums[edges[1:]] - sums[edges[:-1]]])
            self.starts = offsets_of(self.counts)[:-1]
        lengths = self.counts[codes]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        edges = offsets_of(np.array([len(p) for p in parts]))
        return self.ids[ragged(self.starts[codes], lengths)], sums[edges[1:]] - sums[edges[:-1]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker; the chunks that an encoder keeps go with its task."""
    return Vocabulary(path)


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, ids array<int>) for every row, without special tokens.

    A null or empty text has no ids. Repeated rows and rows without a key are encoded like any
    other. Other columns of ``docs`` are ignored, so their names cannot clash. There is no
    exchange; a task holds slices of about 4 MB of text.
    """
    kind = docs.schema[key].dataType.simpleString()

    encoder: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not encoder:
            encoder.append(Encoder(path, pattern))
        ids, counts = encoder[0].encode(texts_of(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids, counts, pa.int32())], ["key", "ids"])

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return map_batches(rows, run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, data binary): the bytes of every list of ids; null lists count as empty."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        counts = np.asarray(pc.list_value_length(column)).astype(np.int64)
        flat = np.asarray(column.flatten())
        data, sizes = vocabulary(path).decode(flat, counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lists(flat, counts, pa.int32()), binaries(data, sizes)], ["key", "ids", "data"]
        )

    rows = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))
    out = map_batches(rows, run, f"key {kind}, ids array<int>, data binary")
    return out.select(F.col("key").alias(key), "ids", "data")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    tune(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode(encode(read(spark, folder, "documents"), path, pattern), path)
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
