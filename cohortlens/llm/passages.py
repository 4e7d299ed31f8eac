"""Operator 9: substring de-duplication with automata of repeated phrases.

1. Of every window of words the phrase of least hash is its lead; equal windows have equal leads.
   Counting leads over the corpus gives the recurring ones.
2. Documents are dealt to blocks by a hash of their id. A block compiles an Aho-Corasick automaton
   from the recurring phrases that lead a window in it, each taken from one place, and streams its
   documents through it to locate every occurrence. Windows around an occurrence are candidates; the
   others stand in the corpus once. Counting candidates confirms recurring windows and gives the first
   place of each.
3. Each block removes the words of windows whose first place is elsewhere.

A passage that many documents share is one row per block, so no group grows with its copies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import (
    BASES,
    Stage,
    lists,
    map_batches,
    mix,
    offsets_of,
    ragged,
    read,
    sliding,
    windows,
)

PHRASE = 8  # words
BLOCK = 500_000  # words of a block, on average


SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the low n bytes of 8


class Words:
    """Words of texts as ranges of their bytes: ``begin`` and ``end`` of each, ``sizes`` words a text."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        whole = pa.chunked_array(column.chunks if isinstance(column, pa.ChunkedArray) else [column], column.type)
        texts = whole.cast(pa.large_binary()).fill_null(b"").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        n, (_, offsets, data) = len(texts), texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data or b"", np.uint8)[at[0]: at[-1]]
        at = at - at[0]
        inside = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[at] = True
        beside = np.concatenate([[False], inside, [False]])
        self.begin = np.flatnonzero(inside & (~beside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside & (~beside[2:] | edge[1:])) + 1
        self.edges = np.searchsorted(self.begin, at)
        self.sizes = np.diff(self.edges)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, from its length and its bytes in groups of 8."""
        length = self.end - self.begin
        groups = (length + 7) // 8
        number = ragged(np.zeros(len(groups), np.int64), groups)
        at = np.repeat(self.begin, groups) + 8 * number
        left = np.minimum(np.repeat(self.end, groups) - at, 8)
        # the 8 bytes from every place on
        eights = np.ndarray(len(self.data), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        each = mix((eights[at] & MASKS[left]) ^ mix(number.astype(np.uint64), 7), 8)
        total = np.add.reduceat(each, offsets_of(groups)[:-1]) if len(groups) else each
        return mix(total ^ mix(length.astype(np.uint64), 9), 10)

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The words to keep of every text, joined by a space."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[keep]
        begin, end = self.begin[keep], self.end[keep]
        follows = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
        # a word that another one follows has white space behind it
        data, gaps = self.data.copy(), end[follows]
        data[gaps] = 32
        change = np.zeros(len(data) + 1, np.int8)
        change[begin] += 1
        change[end] -= 1
        wanted = np.cumsum(change[:-1], dtype=np.int8) > 0
        wanted[gaps] = True
        sizes = np.bincount(owner, end - begin + follows, len(self.sizes)).astype(np.int64)
        offsets = pa.py_buffer(offsets_of(sizes).tobytes())
        texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, offsets, pa.py_buffer(data[wanted].tobytes())])
        return texts.cast(pa.string())


def flagged(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """False where a hash is none of the known ones for sure, told by its low bits."""
    bits = np.uint64((1 << 22) - 1)
    flags = np.zeros(1 << 22, bool)
    flags[known & bits] = True
    return flags[asked & bits]


def digests(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each word sequence."""
    out = np.zeros((2, len(sizes)), np.uint64)
    some = sizes > 0
    if some.any():
        place = np.arange(len(words)) - np.repeat(offsets_of(sizes)[:-1], sizes)
        for i in range(2):
            each = mix(words ^ mix(place.astype(np.uint64), 3 + i), 5 + i)
            out[i, some] = np.add.reduceat(each, offsets_of(sizes[some])[:-1])
    return out


def leads(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of the phrases that lead a window, and how many each document has."""
    phrase = min(PHRASE, width)
    room = width - phrase + 1
    hashes = windows(words, phrase)
    edges = offsets_of(sizes)
    chosen = np.zeros(len(words), bool)
    if len(hashes) >= room:
        least = sliding(hashes, room, np.minimum)  # of the window that starts here
        ends = np.repeat(edges[1:], sizes)[: len(least)]
        inside = np.arange(len(least)) + width <= ends
        # a phrase leads if it is the least of a window that holds it, in the same document
        low = np.where(inside, least, 0)
        held = np.concatenate([np.zeros(room - 1, np.uint64), low, np.zeros(room - 1, np.uint64)])
        most = sliding(held, room, np.maximum)[: len(hashes)]
        chosen[: len(hashes)] = (most == hashes) & (most > 0)
    at = np.flatnonzero(chosen)
    owner = np.searchsorted(edges, at, side="right") - 1
    return hashes[at] if len(at) else np.zeros(0, np.uint64), at - edges[owner], np.bincount(owner, minlength=len(sizes))


def marks(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(doc_id, salt, n, d1, d2, phrases, places) of every row with a key; ``salt`` is a hash of the text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            texts = Words(batch.column(1))
            sizes, words = texts.sizes, texts.hashes()
            found, places, counts = leads(words, sizes, width)
            d1, d2 = digests(words, sizes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(sizes),
                pa.array(d1.view(np.int64)),
                pa.array(d2.view(np.int64)),
                lists(found.view(np.int64), counts, pa.int64()),
                lists(places.astype(np.int32), counts, pa.int32()),
            ],
            ["doc_id", "salt", "n", "d1", "d2", "phrases", "places"],
        )

    text_of = docs[text].cast("string")
    rows = docs.where(docs[key].isNotNull()).select(docs[key].cast("long"), text_of, F.xxhash64(text_of).alias("salt"))
    schema = "doc_id long, salt long, n long, d1 long, d2 long, phrases array<long>, places array<int>"
    return map_batches(rows, run, schema)


class Block:
    """Rows of a block that can hold a repeated window, in the order of their ids.

    ``copies`` has (doc_id, d1, d2) of the rows that go whole: an id may have several texts.
    """

    def __init__(self, table: pa.Table, copies: set[tuple[int, int, int]], width: int):
        self.texts = Words(table["text"])
        self.ids = table["doc_id"].to_pylist()
        all_words, sizes, rows_of = self.texts.hashes(), self.texts.sizes, Counter(self.ids)

        def words_of(rows: list[int]) -> np.ndarray:
            return all_words[ragged(self.texts.edges[:-1][rows], sizes[rows])]

        # an id that is alone here and has no copy needs no digest to be told apart
        ids = {doc for doc, _, _ in copies}
        told = [i for i, d in enumerate(self.ids) if d in ids or rows_of[d] > 1]
        found = digests(words_of(told), sizes[told]).view(np.int64)
        digest = dict(zip(told, zip(*found.tolist(), strict=True), strict=True))
        self.copied = [i in digest and (d, *digest[i]) in copies for i, d in enumerate(self.ids)]
        order = [i for i, n in enumerate(sizes.tolist()) if n >= width and not self.copied[i]]
        self.rows = sorted(order, key=lambda i: self.ids[i])
        self.sizes = sizes[self.rows]
        self.edges = offsets_of(self.sizes)
        self.words = words_of(self.rows)
        #: Place of a row by its id and, where the id has several rows here, its first digest.
        self.place = {(self.ids[i], digest[i][0] if rows_of[self.ids[i]] > 1 else None): k for k, i in enumerate(self.rows)}
        self.shared = {d for d, n in rows_of.items() if n > 1}
        self.docs = np.array([self.ids[i] for i in self.rows], np.int64)
        self.width = width

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes, document number and start of every window."""
        if not len(self.words):
            none = np.zeros(0, np.uint64)
            return none, none, none.astype(np.int64), none.astype(np.int64)
        h1, h2 = (windows(mix(self.words, i) if i else self.words, self.width, b) for i, b in enumerate(BASES))
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[: len(h1)]
        start = np.arange(len(h1)) - self.edges[owner]
        fits = start + self.width <= self.sizes[owner]
        return h1[fits], h2[fits], owner[fits], start[fits]

    def coded(self, phrases: np.ndarray) -> np.ndarray:
        """A number from 1 on for every word that stands in a phrase of ``PHRASE`` words at most, 0 for others."""
        known = np.unique(self.words[phrases])
        some = np.flatnonzero(flagged(known, self.words))
        at = np.minimum(np.searchsorted(known, self.words[some]), len(known) - 1)
        same = known[at] == self.words[some]
        codes = np.zeros(len(self.words), "<u4")
        codes[some[same]] = at[same] % 0x10FFFE + 1
        return codes

    def runs(self, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the runs of ``least`` coded words and more inside a document."""
        inside = codes > 0
        edge = np.zeros(len(codes) + 1, bool)
        edge[self.edges] = True
        beside = np.concatenate([[False], inside, [False]])
        begin = np.flatnonzero(inside & (~beside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside & (~beside[2:] | edge[1:])) + 1
        return begin[end - begin >= least], end[end - begin >= least]


def _rows_of(side: pa.Table) -> set[tuple[int, int, int]]:
    return set(zip(*(side[c].to_pylist() for c in ("doc_id", "d1", "d2")), strict=True))


def _candidates(table: pa.Table, side: pa.Table, width: int) -> pa.Table:
    """Distinct windows around the occurrences of recurring phrases: first place and number in the block."""
    shape = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
    lead = side.filter(pc.is_valid(side["place"]))
    copies = _rows_of(side.filter(pc.is_null(side["place"])))
    if not lead.num_rows or not table.num_rows:
        return shape.empty_table()
    with np.errstate(over="ignore"):
        block = Block(table, copies, width)
        if not block.rows:
            return shape.empty_table()
        phrase = min(PHRASE, width)
        row = [block.place[doc, d if doc in block.shared else None] for doc, d in zip(*(lead[c].to_pylist() for c in ("doc_id", "d1")), strict=True)]
        begin = block.edges[row] + np.asarray(lead["place"].combine_chunks())
        codes = block.coded(ragged(begin, np.full(len(begin), phrase)))

        def string(a: int, b: int) -> str:
            return codes[a:b].tobytes().decode("utf-32-le", "surrogatepass")

        automaton = ahocorasick.Automaton()
        for a in begin.tolist():
            automaton.add_word(string(a, a + phrase), a)
        automaton.make_automaton()
        # a word of no phrase ends all that the automaton has read
        ends = [a + end for a, b in zip(*block.runs(codes, phrase), strict=True) for end, _ in automaton.iter(string(a, b))]
        ends = np.array(ends, np.int64)
        of = np.searchsorted(block.edges, ends, side="right") - 1
        # windows that hold the phrase whole
        first = np.maximum(ends - width + 1, block.edges[of])
        last = np.minimum(ends - phrase + 1, block.edges[of + 1] - width)
        fits = first <= last
        change = np.zeros(len(block.words) + 1, np.int64)
        np.add.at(change, first[fits], 1)
        np.add.at(change, last[fits] + 1, -1)
        near = np.cumsum(change)[:-1] > 0
        h1, h2, owner, start = block.hashes()
        at = np.flatnonzero(near[block.edges[owner] + start])
        h1, h2, owner, start = h1[at], h2[at], owner[at], start[at]
    if not len(at):
        return shape.empty_table()
    docs = block.docs[owner]
    order = np.lexsort((start, docs, h2, h1))
    h1, h2, docs, start = h1[order], h2[order], docs[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
    n = np.diff(np.append(new, len(h1)))
    return pa.table([h1[new].view(np.int64), h2[new].view(np.int64), docs[new], start[new], n], schema=shape)


def _removed(table: pa.Table, side: pa.Table, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Kept words joined by a space, number of words and of removed words, for every row."""
    copies = _rows_of(side.filter(pc.is_null(side["h1"])))
    side = side.filter(pc.is_valid(side["h1"]))
    with np.errstate(over="ignore"):
        block = Block(table, copies, width)
        gone = np.zeros(len(block.words) + 1, np.int64)
        if side.num_rows and block.rows:
            h1, h2, owner, start = block.hashes()
            known = [np.asarray(side[c].combine_chunks()) for c in ("h1", "h2", "doc_id", "start")]
            key = known[0].view(np.uint64), known[1].view(np.uint64)
            order = np.lexsort((key[1], key[0]))
            k1, k2, doc, place = key[0][order], key[1][order], known[2][order], known[3][order]
            some = np.flatnonzero(flagged(k1, h1))
            h1, h2, owner, start = h1[some], h2[some], owner[some], start[some]
            low, high = np.searchsorted(k1, h1), np.searchsorted(k1, h1, side="right")
            # first hashes may agree where the second ones differ
            for step in range(int((high - low).max(initial=0))):
                at = np.minimum(low + step, len(k1) - 1)
                hit = (low + step < high) & (k2[at] == h2)
                hit &= (doc[at] != block.docs[owner]) | (place[at] != start)
                begin = (block.edges[owner] + start)[hit]
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + width, -1)
    sizes, edges = block.texts.sizes, block.texts.edges
    drop = np.zeros(edges[-1], bool)
    drop[ragged(edges[:-1][block.rows], block.sizes)] = np.cumsum(gone)[:-1] > 0
    drop |= np.repeat(np.array(block.copied, bool) & (sizes >= width), sizes)
    removed = np.diff(np.concatenate([[0], np.cumsum(drop)])[edges])
    return block.texts.joined(~drop), sizes, removed


def remove(docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, row) for every row of ``docs``; ``row`` holds the row itself.

    Words stand between ASCII white space. A word goes if a window of ``width`` consecutive words
    covers it whose words also start earlier: in a smaller doc_id, or earlier in the same one. ``kept``
    has the other words, joined by a space. Windows are judged on the input. Null and empty texts have
    no words. Rows without doc_id come first nowhere and keep their words; they pass by the groups. An id
    may have several texts: each row is judged by its own. Rows that share a doc_id and start with the same window at the same place don't count as earlier than each other. An empty
    table gives no rows. Extra columns travel in ``row``, so their names can't clash.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "passages")
    marked = stage.store(marks(docs, width, key, text), "marks")
    first = marked.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = stage.store(first.where("first < last").drop("last"), "first")
    words = marked.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-words // BLOCK))

    def block(salt: Column) -> Column:
        """By id and text, so that no id is one group however many texts it has."""
        return F.pmod(F.xxhash64(F.col("doc_id"), salt), F.lit(blocks)).cast("int").alias("block")

    # copies of a whole earlier document go whole; the others are searched
    both = marked.join(first, ["d1", "d2", "n"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    named = ["block", "doc_id", "d1", "d2"]
    copies = both.where("copy").select(block(F.col("salt")), *named[1:]).distinct()
    copies = stage.store(copies, "copies")
    live = both.where("not copy").select(block(F.col("salt")), "doc_id", "d1", F.explode(F.arrays_zip("phrases", "places")).alias("p"))
    live = live.select("block", F.col("p.phrases").alias("phrase"), "doc_id", "d1", F.col("p.places").alias("place"))
    recurring = stage.store(live.groupBy("phrase").count().where("count > 1").select("phrase"), "recurring")
    found = live.join(recurring, "phrase").groupBy("block", "phrase")
    found = found.agg(F.min(F.struct("doc_id", "d1", "place")).alias("p"))
    found = found.select("block", "p.doc_id", "p.d1", F.lit(None).cast("long").alias("d2"), "p.place")
    found = stage.store(found.union(copies.select(*named, F.lit(None).cast("int").alias("place"))), "leads")
    stage.drop("recurring", "marks", "first")
    stage.release()

    text_of = docs[text].cast("string")
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rows = docs.where(docs[key].isNotNull()).select(docs[key].cast("long").alias("doc_id"), text_of.alias("text"), F.xxhash64(text_of).alias("salt"), whole)
    rows = rows.select(block(F.col("salt")), "doc_id", "text", "row")
    unkeyed = docs.where(docs[key].isNull()).select(F.lit(None).cast("long").alias("doc_id"), text_of.alias("text"), whole)

    def locate(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        out = _candidates(table, side, width)
        return out.append_column("block", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))

    by_block = rows.select("block", "doc_id", "text").groupBy("block").cogroup(found.groupBy("block"))
    schema = "h1 long, h2 long, doc_id long, start long, n long, block int"
    spots = stage.store(by_block.applyInArrow(locate, schema), "spots")
    stage.release()
    again = spots.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.sum("n").alias("all"))
    again = stage.store(again.where("all > 1").select("h1", "h2", "f"), "again")
    hits = spots.join(again, ["h1", "h2"])
    # where a block has only the first place there is nothing to remove
    hits = hits.where((F.col("n") > 1) | (F.struct("doc_id", "start") != F.col("f")))
    none = {c: F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "d1", "d2", "start")}
    hits = hits.select("block", "h1", "h2", "f.doc_id", "f.start", none["d1"], none["d2"])
    hits = hits.union(copies.select("block", none["h1"], none["h2"], "doc_id", none["start"], "d1", "d2"))
    hits = stage.store(hits, "hits")
    stage.drop("spots", "again", "leads")
    stage.release()

    def strip(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()))}
                            | {"row": pa.array([], table.schema.field("row").type)})
        kept, n_words, n_removed = _removed(table, side, width)
        return pa.table(
            {"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
             "kept": kept, "row": table["row"]}
        )

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = Words(batch.column("text"))
        counts, none = pa.array(texts.sizes, pa.int64()), pa.array(np.zeros(len(texts.sizes), np.int64))
        kept = texts.joined(np.ones(texts.edges[-1], bool))
        columns = [batch.column("doc_id"), counts, none, kept, batch.column("row")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "row"])

    schema = f"doc_id long, n_words long, n_removed long, kept string, row {rows.schema['row'].dataType.simpleString()}"
    judged = rows.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(strip, schema)
    return judged.unionByName(map_batches(unkeyed, keep, schema))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the passages of 20 words and more that stand earlier as well."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = remove(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), spots AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY p ORDER BY doc_id, s) AS k FROM spots) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM later)
), each AS (
  SELECT w.doc_id, w.i, w.word, g.i IS NOT NULL AS removed
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) w LEFT JOIN gone g USING (doc_id, i)
)
SELECT d.doc_id, count(e.i) AS n_words, count(e.i) FILTER (e.removed) AS n_removed,
  sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (NOT e.removed), '')) AS kept_sha256
FROM words d LEFT JOIN each e USING (doc_id) GROUP BY d.doc_id
"""
