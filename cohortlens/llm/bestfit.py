"""Operator 12: packing into few sequences by swap-based local search.

Documents longer than a sequence are cut; full pieces are sequences of their own. What is left of
each document is an item to be packed. Items are dealt into groups of bounded size. Each group
starts from best fit (largest first) and then improves its underfull bins: a move, an exchange of
one item for one, or of one for two, between two bins is made where it raises the sum of squared
fills, so space gathers in the emptiest bins until they are empty and go. Bins that still have
space meet those of other groups in further rounds, while that shrinks them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import SENT, Stage, binaries, cut, offsets_of, read
from cohortlens.llm.words import SpacedWords

BATCH = 8_000_000  # bytes of text turned into ids at a time, one row at least
GROUP = 50_000  # items packed by one task at a time, on average
PATIENCE = 256  # bins in a row that the search may fail to empty before it ends
SMALL = 1_000_000  # rows, of 16 bytes, up to which the totals of the tasks are broadcast


class Bin:
    """Sizes in one sequence, with how often each occurs; equal sizes are interchangeable."""

    __slots__ = ("sizes", "free")

    def __init__(self, width: int, sizes: Counter | None = None):
        self.sizes = Counter(sizes or ())
        self.free = width - sum(s * n for s, n in self.sizes.items())

    def change(self, out: tuple[int, ...], into: tuple[int, ...]) -> None:
        for s in out:
            if self.sizes[s] == 1:
                del self.sizes[s]
            else:
                self.sizes[s] -= 1
        for s in into:
            self.sizes[s] += 1
        self.free += sum(out) - sum(into)

    def parts(self) -> tuple[list[int], list[tuple[int, ...]], np.ndarray]:
        """Sums of no, one and two of the items, ascending, the items of each sum, and their number."""
        present = sorted(self.sizes)
        ways = {0: ()}
        for i, a in enumerate(present):
            for b in present[i:] if self.sizes[a] > 1 else present[i + 1:]:
                ways[a + b] = (a, b)
        ways.update((s, (s,)) for s in present)  # one item rather than two
        sums = sorted(ways)
        return sums, [ways[s] for s in sums], np.array([len(ways[s]) for s in sums], np.int64)


def best_fit(counts: Counter, width: int) -> list[Bin]:
    """Largest first, each into the fullest bin that has room."""
    bins: list[Bin] = []
    spaces: list[int] = []  # different free spaces, ascending
    held: dict[int, list[int]] = {}  # bins of each free space
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            at = bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                number = held[space].pop()
                if not held[space]:
                    del held[space], spaces[at]
            else:
                number = len(bins)
                bins.append(Bin(width))
            found = bins[number]
            found.change((), (size,))
            if found.free:
                if found.free not in held:
                    held[found.free] = []
                    insort(spaces, found.free)
                held[found.free].append(number)
    return bins


class Search:
    """Local search over the bins that have space left."""

    def __init__(self, bins: list[Bin], width: int):
        self.width, self.bins = width, bins
        self.kept = [b.parts() for b in bins]
        self._flatten()

    def _flatten(self) -> None:
        """What each bin can give back (no, one or two items), end to end."""
        lengths = np.array([len(k[0]) for k in self.kept], np.int64)
        self.owner = np.repeat(np.arange(len(self.bins)), lengths)
        self.place = np.arange(len(self.owner)) - np.repeat(offsets_of(lengths)[:-1], lengths)
        self.back = np.array([s for k in self.kept for s in k[0]], np.int64)
        self.pieces = np.concatenate([k[2] for k in self.kept]) if self.kept else np.zeros(0, np.int64)
        self.free = np.array([b.free for b in self.bins], np.int64)

    def _best(self, number: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange with another bin that moves most out of bin ``number``: other bin, given, taken back."""
        sums, ways, pieces = self.kept[number]
        give = np.array(sums, np.int64)
        space = self.free[self.owner]
        best = None
        for limit in (1, 2):
            # one or two items for at most one, and one item for two
            mine = np.flatnonzero((pieces > 0) & (pieces <= limit))
            theirs = np.flatnonzero((self.pieces <= 3 - limit) & (self.owner != number) & (space > 0))
            if not len(mine) or not len(theirs):
                continue
            found = np.searchsorted(give[mine], self.back[theirs] + space[theirs], "right") - 1
            moved = np.where(found >= 0, give[mine][found] - self.back[theirs], 0)
            # the sum of squares rises if the other bin ends fuller than this one was
            fuller = moved + self.free[number] > space[theirs]
            moved = np.where(fuller & (moved > 0), moved, 0)
            at = int(np.argmax(moved))
            if moved[at] > 0 and (best is None or moved[at] > best[0]):
                entry = theirs[at]
                other = int(self.owner[entry])
                best = int(moved[at]), other, ways[mine[found[at]]], self.kept[other][1][self.place[entry]]
        return best and best[1:]

    def run(self) -> list[Bin]:
        """The bins that remain."""
        failed: set[int] = set()
        while len(self.bins) > 1 and len(failed) < PATIENCE and int(self.free.sum()) >= self.width:
            open_bins = [i for i in np.argsort(-self.free, kind="stable").tolist() if i not in failed]
            if not open_bins or not self.free[open_bins[0]]:
                break
            number = open_bins[0]
            while self.bins[number].sizes and (found := self._best(number)):
                other, given, taken = found
                self.bins[number].change(given, taken)
                self.bins[other].change(taken, given)
                for i in (number, other):
                    self.kept[i] = self.bins[i].parts()
                self._flatten()
            if self.bins[number].sizes:
                failed.add(number)
            else:
                del self.bins[number], self.kept[number]
                failed = set()
                self._flatten()
        return self.bins


def improve(bins: list[Bin], width: int) -> list[Bin]:
    """The bins after the search; those without space stay as they are."""
    full = [b for b in bins if not b.free]
    return full + Search([b for b in bins if b.free], width).run()


def placed(table: pa.Table, width: int, group: int) -> pa.Table:
    """Items of a group with their bin and place. Rows that have a bin start from it, others from best fit."""
    row, size = np.asarray(table["row"].combine_chunks()), np.asarray(table["size"].combine_chunks())
    before = np.asarray(table["sequence_id"].combine_chunks().fill_null(-1))
    order = np.lexsort((row, size))
    held = {}
    for s, b in zip(size.tolist(), before.tolist(), strict=True):
        held.setdefault(b, Counter())[s] += 1
    bins = best_fit(held.pop(-1, Counter()), width) + [Bin(width, c) for _, c in sorted(held.items())]
    bins = improve(bins, width)
    number, size_of, space = [], [], []
    for i, b in enumerate(bins):
        for s in sorted(b.sizes, reverse=True):
            number += [i] * b.sizes[s]
            size_of += [s] * b.sizes[s]
        space.append(b.free)
    number, size_of = np.array(number, np.int64), np.array(size_of, np.int64)
    lengths = offsets_of(size_of)[:-1]
    first = np.searchsorted(number, number)
    offset = lengths - lengths[first] if len(number) else lengths
    # the items of a size take the places of that size, in order
    places = np.lexsort((number, size_of))
    out = np.empty(len(row), np.int64)
    out[order] = places
    return pa.table({
        "row": table["row"], "size": table["size"],
        "sequence_id": pa.array((np.int64(group) << 24) + number[out]), "offset": pa.array(offset[out]),
        "free": pa.array(np.array(space, np.int64)[number[out]]),
    })


def _packer(width: int, base: int):
    return lambda key, table: placed(table, width, base + key[0].as_py())


def _rounds(items: DataFrame, stage: Stage, width: int) -> DataFrame:
    """row, sequence_id and offset of every item (row, size)."""
    shape = "row long, size long, sequence_id long, offset long, free long"
    rows = items.withColumn("sequence_id", F.lit(None).cast("long"))
    count, done, turn, base = items.count(), None, 0, 0
    while True:
        groups = max(1, -(-count // GROUP))
        key = F.pmod(F.xxhash64(F.coalesce("sequence_id", "row"), F.lit(turn)), F.lit(groups)).cast("long")
        grouped = rows.withColumn("group", key).groupBy("group")
        now = stage.store(grouped.applyInArrow(_packer(width, base), shape), f"bins{turn}")
        left = now.where(F.col("free") > 0)
        rest = left.count()
        last = groups == 1 or rest == 0 or rest > 0.5 * count
        part = (now if last else now.where(F.col("free") == 0)).select("row", "sequence_id", "offset")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        rows, count, turn, base = left.select("row", "size", "sequence_id"), rest, turn + 1, base + groups


def pack(docs: DataFrame, path: str, width: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids, sequence_id, offset.

    ``ids`` are the ids of the piece as little-endian 32-bit numbers, closed by ``end`` at the end of
    a document. A document of more than ``width`` ids is cut into pieces of ``width``; the first one
    is shorter if need be. Other documents are one piece. No sequence holds more than ``width`` ids,
    and there are no gaps before the last piece in it. Sequence ids are negative for sequences that
    one piece fills, and have no further meaning.

    Null and empty texts have only the closing id. Every row is a document of its own, rows with the
    same or no doc_id included. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "bestfit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, before, encoder = TaskContext.get().partitionId(), 0, 0, SpacedWords(path)
        for big in batches:
            for batch in cut(big, BATCH):
                ids, counts = encoder.encode(batch.column(1).fill_null(""), end)
                full = np.where(counts >= width, counts // width, 0)
                ahead = before + offsets_of(full)[:-1]
                before += int(full.sum())
                rows = (part << 36) + seen + np.arange(len(counts))
                seen += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part)), pa.array(rows), batch.column(0), pa.array(counts % width),
                        pa.array(full), pa.array(ahead), binaries(ids.astype("<u4"), 4 * counts),
                    ],
                    ["part", "row", "doc_id", "size", "full", "ahead", "data"],
                )

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT)
    texts = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    schema = "part long, row long, doc_id long, size long, full long, ahead long, data binary"
    coded = stage.store(texts.mapInArrow(run, schema), "ids")
    bins = _rounds(coded.where(F.col("size") > 0).select("row", "size"), stage, width)
    totals = stage.store(coded.groupBy("part").agg(F.sum("full").alias("total")), "totals")
    # one row per task of the first pass
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    if totals.count() <= SMALL:
        bases = F.broadcast(bases)
    ids = F.substring("data", F.lit(1), (4 * F.col("size")).cast("int")).alias("ids")
    items = coded.where(F.col("size") > 0).select("row", "doc_id", "size", ids)
    # the places grow with the items, so they are never broadcast
    rests = items.join(bins.hint("merge"), "row").select(
        "doc_id",
        F.lit(0).cast("int").alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.col("size").alias("length"),
        "ids",
        "sequence_id",
        "offset",
    )
    number = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("number", "_n")
    whole = coded.where(F.col("full") > 0).join(bases, "part").select("*", number)
    start = F.col("size") + F.col("number").cast("long") * width
    whole = whole.select(
        "doc_id",
        (F.col("number") + (F.col("size") > 0).cast("int")).alias("piece"),
        start.alias("start"),
        F.lit(width).cast("long").alias("length"),
        F.substring("data", (4 * start + 1).cast("int"), F.lit(4 * width)).alias("ids"),
        (-1 - F.col("base") - F.col("ahead") - F.col("number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return rests.unionByName(whole)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 ids at most."""
    pieces = pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
