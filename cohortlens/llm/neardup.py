"""Operator 6: near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys are made per document, each half key from ``ROWS`` minhashes. A
table of the index is named by one half key of either collection, so 2 x SIDE half keys make
SIDE x SIDE tables: the minhash work is about the square root of what independent tables take. Pairs that
meet in a table are confirmed on their full shingle sets, and confirmed links give components.
Before texts are fetched, a pair is held against a lower bound of the difference of the two sets, which
only pairs below the threshold can exceed. Members of a bucket that a first comparison with one of
them does not connect are held against each other in blocks, as matrices: only the pairs that pass
the bound ever become rows.

A pair with similarity s is missed if no half key of one collection agrees, with probability below
2 (1 - s^ROWS)^SIDE: 7 in 100,000 at 0.8, 4 in ten million at 0.9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import (
    Stage,
    binaries,
    lists,
    map_batches,
    mix,
    offsets_of,
    read,
    texts_of,
    windows,
    word_hashes,
)
from cohortlens.llm.components import roots

SIDE, ROWS = 10, 2
CROWD = 2048  # members of a bucket that are compared in one group, on average
CHUNK = 4_000_000  # bytes of sketches compared at a time
SEED = 20240611
CACHED = 65_536  # shingles that are hashed at a time, those of one document at least
LEAST_CELLS, MOST_CELLS = 32, 4096  # of a counting sketch; powers of two
FULL = 255  # where a cell of a sketch stops counting


def cells(text: str) -> list[bytes]:
    """Words; only A-Z are lower-cased, only ASCII white space parts words."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> set:
    """Distinct runs of ``width`` words; all words as one run if there are fewer; nothing without words."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def linked(a: set, b: set, share: int) -> bool:
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= share * (len(a) + len(b) - both)


def sets_of(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, one text after the other, and their number."""
    parts = [cells(t) for t in texts]
    words = word_hashes(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    edges = offsets_of(sizes)
    runs = windows(words, width) if len(words) >= width else np.zeros(0, np.uint64)
    out = []
    for n, a, b in zip(sizes, edges[:-1], edges[1:], strict=True):
        if n >= width:
            out.append(np.unique(runs[a: b - width + 1]))
        elif n:
            out.append(mix(windows(words[a:b], int(n)), int(n)))
        else:
            out.append(runs[:0])
    return np.concatenate([*out, runs[:0]]), np.array([len(x) for x in out], np.int64)


def half_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(documents with shingles) x (2 SIDE) half keys, for as many documents at a time as a cache holds."""
    edges = offsets_of(counts[counts > 0])
    random = np.random.default_rng(SEED)
    factors = [random.integers(0, 2**63, 2).astype(np.uint64) for _ in range(2 * SIDE * ROWS)]
    out = np.zeros((len(edges) - 1, 2 * SIDE), np.uint64)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + CACHED, "right")) - 1)
        part, start = flat[edges[a]: edges[b]], edges[a:b] - edges[a]
        hashed = np.empty_like(part)
        for i in range(2 * SIDE):
            for odd, add in factors[i * ROWS: (i + 1) * ROWS]:
                np.multiply(part, odd * np.uint64(2) + np.uint64(1), out=hashed)
                hashed += add
                out[a:b, i] = mix(out[a:b, i] ^ np.minimum.reduceat(hashed, start), i + 1)
        a = b
    return out


def sketches(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counting sketches, one after the other, and their sizes: how many shingles of a set fall into each cell.

    A set of n shingles has the power of two from n on as number of cells, within fixed limits.
    """
    sizes = np.clip(1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), LEAST_CELLS, MOST_CELLS)
    sizes = np.where(counts > 0, sizes, 0)
    cell = (mix(flat, 3) & np.repeat(sizes - 1, counts).astype(np.uint64)).astype(np.int64)
    cell += np.repeat(offsets_of(sizes)[:-1], counts)
    return np.minimum(np.bincount(cell, minlength=int(sizes.sum())), FULL).astype(np.uint8), sizes


def apart(a: bytes, b: bytes) -> int:
    """Lower bound of the number of shingles that only one of two sets has, from their sketches."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):  # the cells of the larger one fold into those of the smaller one
        x = np.minimum(x.reshape(-1, len(y)).sum(axis=0), FULL)
    return int(np.abs(x - y).sum())


def signatures(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(doc_id, n, d1, d2, u, v, sketch): set size, digest of the set, the two collections of half keys, counts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            flat, counts = sets_of(texts_of(batch.column(1)), width)
            some = counts > 0
            digests = np.zeros((2, len(counts)), np.uint64)
            keys = np.zeros((len(counts), 2 * SIDE), np.uint64)
            if some.any():
                start = offsets_of(counts[some])[:-1]
                for i in range(2):  # sums over the set, whatever its order
                    digests[i, some] = np.add.reduceat(mix(flat, i + 1), start)
                keys[some] = half_keys(flat, counts)
            counted, cells_of = sketches(flat, counts)
        keys = keys.view(np.int64)
        each = np.where(some, SIDE, 0)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts),
                *(pa.array(d.view(np.int64)) for d in digests),
                lists(np.ascontiguousarray(keys[some, :SIDE]).ravel(), each, pa.int64()),
                lists(np.ascontiguousarray(keys[some, SIDE:]).ravel(), each, pa.int64()),
                binaries(counted, cells_of),
            ],
            ["doc_id", "n", "d1", "d2", "u", "v", "sketch"],
        )

    rows = docs.select(docs[key].cast("long"), docs[text].cast("string"))
    return map_batches(rows, run, "doc_id long, n long, d1 long, d2 long, u array<long>, v array<long>, sketch binary")


def possible(pairs: DataFrame, sketched: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that may be similar enough; ``sketched`` has (rep, n, sketch).

    Sets of m and n shingles that are linked differ in at most (100 - share) (m + n) / (100 + share).
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = (batch.column(i).to_pylist() for i in (3, 4))
        bound = (100 - share) * np.asarray(batch.column(2))
        least = (100 + share) * np.fromiter(map(apart, left, right), np.int64, len(left))
        yield batch.select([0, 1]).filter(pa.array(least <= bound))

    both = pairs.join(sketched.toDF("b", "right_n", "right"), "b").join(sketched.toDF("a", "left_n", "left"), "a")
    both = both.select("a", "b", (F.col("left_n") + F.col("right_n")).alias("both"), "left", "right")
    return map_batches(both, run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
        keep, last, one = [], None, set()
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            if x != last:
                last, one = x, shingles(cells(x), width)
            if linked(one, shingles(cells(y), width), share):
                keep.append(i)
        yield pa.RecordBatch.from_pydict({"a": [a[i] for i in keep], "b": [b[i] for i in keep]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    both = pairs.join(texts.toDF("b", "right"), "b").join(texts.toDF("a", "left"), "a")
    return map_batches(both.select("a", "b", "left", "right"), run, "a long, b long")


def passing(left: list[bytes], right: list[bytes], x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For pairs (left[x], right[y]) whether the lower bound of their difference is at most ``most``."""
    out = np.zeros(len(x), bool)
    size = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    for a in np.unique(size[0]):
        for b in np.unique(size[1]):
            mine = np.flatnonzero((size[0][x] == a) & (size[1][y] == b))
            if not len(mine):
                continue
            cells_of = min(a, b)  # the cells of the larger one fold into those of the smaller one
            tables, at = [], []
            for side, ends, n in ((left, x, a), (right, y, b)):
                used, place = np.unique(ends[mine], return_inverse=True)
                table = np.frombuffer(b"".join(side[i] for i in used), np.uint8).reshape(len(used), -1, cells_of)
                tables.append(np.minimum(table.sum(axis=1, dtype=np.int32), FULL).astype(np.int16))
                at.append(place)
            step = max(1, CHUNK // int(cells_of))
            for k in range(0, len(mine), step):
                gap = np.abs(tables[0][at[0][k: k + step]] - tables[1][at[1][k: k + step]]).sum(axis=1, dtype=np.int64)
                out[mine[k: k + step]] = gap <= most[mine[k: k + step]]
    return out


def _near(key: tuple, table: pa.Table, share: int) -> pa.Table:
    """Pairs of one bucket, or of two blocks of it, that may be similar enough: different components,
    sizes and sketches that allow it, and no earlier table in which they meet."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    first, second = key[1].as_py(), key[2].as_py()
    rep, n, root, own, i, j = (
        np.asarray(table[c].combine_chunks()) for c in ("rep", "n", "root", "own", "i", "j")
    )
    sides = [np.flatnonzero(own == first), np.flatnonzero(own == second)]
    if not len(sides[0]) or not len(sides[1]):
        return shape.empty_table()
    (p, q), (m, k) = sides, (n[sides[0]][:, None], n[sides[1]][None, :])
    fits = (root[p][:, None] != root[q][None, :]) & (100 * np.minimum(m, k) >= share * np.maximum(m, k))
    if first == second:
        fits &= np.triu(np.ones(fits.shape, bool), 1)
    for name, upto in (("u", int(i[0])), ("v", int(j[0]))):
        keys = np.asarray(table[name].combine_chunks().flatten()).reshape(-1, SIDE)
        for c in range(upto):
            fits &= keys[p, c][:, None] != keys[q, c][None, :]
    x, y = np.nonzero(fits)
    sketch = table["sketch"].to_pylist()
    # sets of m and k shingles that are linked differ in at most so many
    most = (100 - share) * (n[p][x] + n[q][y]) // (100 + share)
    good = passing([sketch[r] for r in p], [sketch[r] for r in q], x, y, most)
    one, other = rep[p[x[good]]], rep[q[y[good]]]
    return pa.table([np.minimum(one, other), np.maximum(one, other)], schema=shape)


def crowds(members: DataFrame, share: int) -> DataFrame:
    """(a, b) of the pairs in each bucket that may be linked.

    ``members`` (bucket, i, j, rep, n, u, v, sketch, root). A bucket of more than ``CROWD`` members is
    dealt into blocks that meet two by two, so no group grows with its bucket.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    large = members.join(sizes.where("parts > 1"), "bucket")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("own")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    large = large.select(*members.columns, own, "parts").select("*", every).drop("parts")
    large = large.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")}).drop("other")
    zero = F.lit(0)
    small = members.join(sizes.where("parts = 1").select("bucket"), "bucket").select(
        *members.columns, *(zero.alias(c) for c in ("own", "first", "second"))
    )
    return small.unionByName(large).groupBy("bucket", "first", "second").applyInArrow(
        lambda key, table: _near(key, table, share), "a long, b long"
    )


def meetings(heads: DataFrame) -> DataFrame:
    """One row per representative, text and table: its bucket, and the table's place in either collection."""
    rows = heads.select("rep", "d1", "n", "v", F.posexplode("u").alias("i", "x"))
    rows = rows.select("rep", "d1", "n", "i", "x", F.posexplode("v").alias("j", "y"))
    return rows.select("rep", "d1", "n", "i", "j", F.xxhash64("i", "j", "x", "y").alias("bucket"))


def groups(
    docs: DataFrame, width: int = 5, share: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if their sets of ``width``-word shingles have at least ``share`` percent of
    their union in common. ``component_id`` is the smallest doc_id that can be reached. Documents
    without words are linked with nothing. Rows that share a doc_id are one document with several
    texts. A row without doc_id is linked with nothing, has no component and is kept. Other columns
    are ignored; an empty table gives no rows.

    Equal sets become one class before pairs are looked for. In each bucket of a table the members
    are compared with one of them, which connects a group of copies at one comparison per member. In
    the buckets that still hold different components all members are held against each other
    (``crowds``), a pair in the first table where it meets, so every pair that meets is connected or
    has been compared, and none is given up.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "neardup")
    signed = stage.store(signatures(docs, width, key, text), "signed")
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = stage.store(classes.where("rep < last").drop("last"), "classes")
    member = known.join(classes, ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))

    heads = member.where("doc_id = rep").select("rep", "d1", "n", "u", "v", "sketch")
    entries = meetings(heads)
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    shared = stage.store(shared.where("low < high").select("bucket"), "shared")
    buckets = stage.store(entries.join(shared, "bucket"), "buckets")
    # texts of all documents that meet another one
    met = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    texts = stage.store(texts.where(F.col("text").isNotNull()).join(met, "doc_id"), "texts")
    # a representative with several texts has several sketches, of which one that fits is enough
    sketched = heads.join(met.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "n", "sketch")
    sketched = stage.store(sketched, "sketched")
    stage.drop("shared")
    stage.release()

    # a document with several texts joins the classes of all of them
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    several = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    links = stage.store(several.where("a <> b").distinct(), "several")
    found = roots(links, stage, "several")

    def unconnected(found: DataFrame, name: str) -> DataFrame:
        """Members of the buckets that hold more than one component, with their component."""
        named = buckets.join(found.toDF("rep", "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        mixed = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        return stage.store(named.join(mixed.where("low < high").select("bucket"), "bucket"), name)

    # every member with the first one of its bucket
    open_ones = unconnected(found, "open")
    pivot = open_ones.groupBy("bucket").agg(F.min(F.struct("rep", "n", "root")).alias("p"))
    pivot = pivot.select("bucket", "p.*").toDF("bucket", "pivot", "size", "home")
    alike = (100 * F.least("n", "size") >= share * F.greatest("n", "size")) & (F.col("root") != F.col("home"))
    pairs = open_ones.join(pivot, "bucket").where(alike & (F.col("rep") != F.col("pivot")))
    pairs = stage.store(pairs.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    near = stage.store(possible(pairs, sketched, share).distinct(), "near")
    fresh = stage.store(confirm(near, texts, width, share), "fresh")
    if not fresh.isEmpty():
        links = stage.store(links.union(fresh), "links")
        found = roots(links, stage, "first")
    stage.release()

    # the others with each other
    open_ones = unconnected(found, "crowded").distinct()
    inside = heads.join(open_ones.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep", "d1"])
    crowded = open_ones.join(inside.drop("n"), ["rep", "d1"])
    more = stage.store(crowds(crowded.drop("d1"), share).distinct(), "more")
    fresh = stage.store(confirm(more.join(near, ["a", "b"], "left_anti"), texts, width, share), "later")
    if not fresh.isEmpty():
        found = roots(stage.store(links.union(fresh), "all"), stage, "last")
    stage.release()

    every = signed.join(classes, ["d1", "d2"], "left")
    rep = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    every = every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), rep).alias("node"))
    every = every.join(found, "node", "left").withColumn("component_id", F.coalesce("root", "node"))
    return every.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose two-word shingles agree to 80 percent."""
    return groups(read(spark, folder, "documents"), width=2)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id,
  least(s.doc_id, coalesce(l.b, s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN low l ON s.doc_id = l.a
"""
