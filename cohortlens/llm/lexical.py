"""Operator 11: ranked lexical search over buckets of vector length.

A document is a vector of impacts, one for each of its terms that some query may ask for; a query is
a vector of weights. Documents are ordered by the length of their vector into buckets, in blocks of
bounded size. The longest vectors are scored first and give each query a score that its kth best
document has at least. A bucket goes to a query only if the product of both lengths (Cauchy and
Schwarz) can reach that score. Inside a block the heaviest terms of a query are added up, and a
document stays only if its sum and a bound on the other terms can reach the kth best sum so far:
the smaller of the product of the remaining lengths and of the sum of weights times the largest
impact of each term. What stays is scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import SENT, Numbered, Stage, cut, lists, offsets_of, read

ROWS = 8192  # documents of a block, on average
ITEMS = 2048  # queries of a block, on average
PARTS = 4  # buckets for each doubling of the length
BITS = 20  # of the filter of terms that a query holds
KEPT = 400_000  # different terms whose hashes a task keeps
SLACK = 1e-9  # relative error allowed for when bounds are compared, which are doubles

#: ASCII that separates terms becomes a space, A-Z lower case; bytes from 128 on stay.
_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


class TermHashes:
    """64-bit hashes of the terms of texts, kept from batch to batch."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.index, self.values = Numbered(), np.zeros(0, np.int64)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every term of the texts, one text after the other, and how many each text has."""
        if len(self.index) > KEPT:
            self._clear()
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = (data.to_pybytes() if data else b"")[offsets[0]: offsets[-1]].translate(_TABLE)
        moved = pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes())
        clean = pa.Array.from_buffers(pa.string(), len(column), [None, moved, pa.py_buffer(data)])
        parts = pc.split_pattern(clean, " ")
        counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        parts = parts.flatten().dictionary_encode()
        terms = parts.dictionary.cast(pa.binary()).to_pylist()
        numbers = self.index.codes([terms])
        if len(self.index) > len(self.values):
            fresh = list(self.index)[len(self.values):]
            new = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh)).view(np.int64)
            self.values = np.concatenate([self.values, new])
        codes = np.asarray(parts.indices)
        real = np.array([len(t) > 0 for t in terms], bool)[codes]
        owner = np.repeat(np.arange(len(counts)), counts)[real]
        return self.values[numbers[codes[real]]], np.bincount(owner, minlength=len(counts))


def _vectors(batches: Iterator[pa.RecordBatch], keep: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """row, key, n, terms and tfs of every text; of the terms only those that ``keep`` has."""
    part_, seen, hashes = TaskContext.get().partitionId(), 0, TermHashes()
    for big in batches:
        for batch in cut(big):
            terms, counts = hashes.of(batch.column(1).fill_null(""))
            owner = np.repeat(np.arange(len(counts)), counts)
            if keep is not None:
                wanted = keep[terms & ((1 << BITS) - 1)]
                terms, owner = terms[wanted], owner[wanted]
            order = np.lexsort((terms, owner))
            terms, owner = terms[order], owner[order]
            new = np.ones(len(terms), bool)
            new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
            starts = np.flatnonzero(new)
            tf = np.diff(np.append(starts, len(terms)))
            held = np.bincount(owner[starts], minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((part_ << 36) + seen + np.arange(len(counts))), batch.column(0), pa.array(counts),
                    lists(terms[starts], held, pa.int64()), lists(tf, held, pa.int64()),
                ],
                ["row", "key", "n", "terms", "tfs"],
            )
            seen += len(counts)


def vectors(df: DataFrame, key: str, text: str, keep: np.ndarray | None = None) -> DataFrame:
    """One row per text: row (its own number), key, n (terms with repeats), terms (hashes), tfs.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A null text has
    none.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT)
    rows = df.select(df[key].cast("long"), df[text].cast("string"))
    return rows.mapInArrow(
        partial(_vectors, keep=keep), "row long, key long, n long, terms array<long>, tfs array<long>"
    )


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times in a document of ``n`` terms; whole numbers."""
    m = 75 + (25 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Postings:
    """Impacts of a block of documents, by term, documents in falling order of vector length."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, values: np.ndarray, wanted: np.ndarray):
        """``lengths`` entries of each document lie end to end; only ``wanted`` terms (sorted) are kept."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.searchsorted(wanted, terms)
        known = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == terms)
        owner, at, values = owner[known], at[known], values[known]
        squares = np.bincount(owner, values.astype(np.float64) ** 2, minlength=len(lengths))
        self.order = np.argsort(-squares, kind="stable")
        self.squares = squares[self.order].astype(np.float64)
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        by = np.lexsort((rank[owner], at))
        self.docs, self.values = rank[owner][by], values[by]
        self.edges = np.searchsorted(at[by], np.arange(len(wanted) + 1))
        self.peak = np.zeros(len(wanted))
        filled = np.flatnonzero(np.diff(self.edges))
        if len(filled):
            self.peak[filled] = np.maximum.reduceat(self.values, self.edges[:-1][filled])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``order``) and scores of all that may be among the first ``k``, if they reach ``least``.

        Scores above 0 only. Documents that tie with the kth best are all there.
        """
        heavy = np.argsort(-weights * self.peak[terms], kind="stable")
        terms, weights = terms[heavy], weights[heavy]
        length = float(np.sqrt((weights.astype(np.float64) ** 2).sum()))
        # buckets of short vectors can't reach the score
        reach = (least * (1 - SLACK) / length) ** 2 if length else 0.0
        n = int(np.searchsorted(-self.squares, -reach, "right"))
        sums, left = np.zeros(n, np.int64), self.squares[:n].copy()
        # of the terms not added yet: largest possible sum, length of the weights
        loads = weights * self.peak[terms]
        rest = np.append(np.cumsum(loads[::-1])[::-1], 0.0)
        rest_length = np.sqrt(np.append(np.cumsum((weights.astype(np.float64) ** 2)[::-1])[::-1], 0.0))
        floor, alive = least, np.ones(n, bool)
        for i, (t, w) in enumerate(zip(terms.tolist(), weights.tolist(), strict=True)):
            a, b = self.edges[t], self.edges[t + 1]
            docs, values = self.docs[a:b], self.values[a:b]
            if len(docs) and docs[-1] >= n:
                stop = int(np.searchsorted(docs, n))
                docs, values = docs[:stop], values[:stop]
            sums[docs] += w * values
            left[docs] -= values.astype(np.float64) ** 2
            if i + 1 < len(terms) and (i & 7 == 7 or rest[i + 1] < floor):
                if n > k:
                    floor = max(floor, int(np.partition(sums, n - k)[n - k]))
                bound = np.minimum(rest[i + 1], rest_length[i + 1] * np.sqrt(np.maximum(left, 0)))
                alive = sums + bound >= floor * (1 - SLACK)
                if 4 * np.count_nonzero(alive) < n:
                    return self._finish(alive, sums, terms[i + 1:], weights[i + 1:], max(floor, 1), k)
        return self._finish(alive, sums, terms[:0], weights[:0], max(floor, 1), k)

    def _finish(self, alive, sums, terms, weights, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the documents that are left."""
        stay = np.flatnonzero(alive)
        exact = sums[stay]
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = self.edges[t], self.edges[t + 1]
            if a == b or not len(stay):
                continue
            docs = self.docs[a:b]
            at = np.minimum(np.searchsorted(docs, stay), len(docs) - 1)
            hit = docs[at] == stay
            exact[hit] += w * self.values[a:b][at[hit]]
        if len(exact) > k:
            floor = max(floor, int(np.partition(exact, len(exact) - k)[len(exact) - k]))
        good = exact >= floor
        return stay[good], exact[good]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return np.asarray(whole.flatten()), np.asarray(pc.list_value_length(whole)).astype(np.int64)


def _number(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks())


def _search(key: tuple, left: pa.Table, right: pa.Table, k: int, documents: int, total: int) -> pa.Table:
    """The best ``k`` documents of the block for every query of the block, ties by key, nulls last."""
    shape = {"item": pa.int64(), "item_id": pa.int64(), "key": pa.int64(), "row": pa.int64(), "score": pa.int64()}
    none = pa.schema(list(shape.items())).empty_table()
    if not left.num_rows or not right.num_rows:
        return none
    asked, n_asked = _flat(right["terms"])
    weights, _ = _flat(right["weights"])
    wanted = np.unique(asked)
    terms, lengths = _flat(left["terms"])
    tfs, _ = _flat(left["tfs"])
    values = impacts(tfs, np.repeat(_number(left["n"]), lengths), documents, total)
    block = Postings(lengths, terms, values, wanted)
    asked = np.searchsorted(wanted, asked)
    rows = _number(left["row"])[block.order]
    keys = left["key"].combine_chunks()
    unkeyed = np.asarray(keys.is_null())[block.order]
    keys = np.asarray(keys.fill_null(0))[block.order]
    item, least = _number(right["item"]), _number(right["least"])
    edges = offsets_of(n_asked)
    parts = [none]
    for i in range(right.num_rows):
        mine = slice(edges[i], edges[i + 1])
        places, found = block.best(asked[mine], weights[mine], k, int(least[i]))
        by = np.lexsort((rows[places], keys[places], unkeyed[places], ~found))[:k]
        places, found = places[by], found[by]
        parts.append(pa.table([
            pa.array(np.full(len(found), item[i])), pa.array([right["item_id"][i].as_py()] * len(found), pa.int64()),
            pa.array(keys[places], mask=unkeyed[places]), pa.array(rows[places]), pa.array(found),
        ], list(shape)))
    return pa.concat_tables(parts)


def _filter(words: DataFrame) -> np.ndarray:
    """Which values of the low bits of a hash occur: 2^BITS flags, however many terms there are."""
    low = words.select(F.col("term").bitwiseAND((1 << BITS) - 1).alias("low")).distinct()
    keep = np.zeros(1 << BITS, bool)
    keep[[r.low for r in low.collect()]] = True
    return keep


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item.

    Equal scores rank by ascending key, documents without key last. Every row of either table is a
    document or item of its own, rows with the same or no key included: repeated items have rows
    1 to ``k`` each. Null and empty texts have no terms: such an item has no row, such a document
    is in none and does not count among the documents. Other columns are ignored. If either table is
    empty there are no rows.

    The score adds, over the item's terms with repeats, the weight of the term, floor(1000 * ln((2 N + 2) /
    (2 df + 1))), times its impact (``impacts``), in 64-bit integers. Terms are told apart by 64-bit
    hashes: with 100 million different terms, some two share a hash that one of 100,000 asked for
    has with probability 5 in ten million.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "lexical")
    asked = stage.store(vectors(items, item, text), "items")
    words = stage.store(asked.select(F.explode("terms").alias("term")).distinct(), "words")
    held = stage.store(vectors(docs, key, text, _filter(words)), "documents")
    documents, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    empty = "item_id long, rank int, doc_id long, score long"
    if not total:
        return spark.createDataFrame([], empty)
    # counted per task before they meet; a frequent term is one row of each task
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = stage.store(words.join(df, "term").select("term", weight.alias("weight")).where("weight > 0"), "weights")
    pairs = asked.select(
        F.col("row").alias("item"), F.col("key").alias("item_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")
    ).select("item", "item_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    times = F.struct("term", (F.col("weight") * F.col("times")).alias("weight"))
    queries = pairs.join(weights, "term").groupBy("item", "item_id").agg(F.sort_array(F.collect_list(times)).alias("t"))
    length = F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, x: a + x["weight"].cast("double") * x["weight"]))
    queries = stage.store(queries.select(
        "item", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), length.alias("length")
    ), "queries")

    m = F.lit(75) + F.expr(f"(25 * n * {documents}L) div {total}L")
    squares = F.aggregate("tfs", F.lit(0.0), lambda a, x: a + F.pow(F.floor(1_000_000_000 * x / (1000 * x + 12 * m)) + 1, 2))
    bucket = F.floor(F.log2(F.sqrt(squares)) * PARTS).cast("int")
    placed = held.where(F.size("terms") > 0).withColumn("bucket", bucket)
    # a bucket for each quarter of a doubling: some hundred rows, whatever the size
    sizes = sorted(map(tuple, placed.groupBy("bucket").count().collect()), reverse=True)
    if not sizes:
        return spark.createDataFrame([], empty)
    parts = {b: max(1, -(-n // ROWS)) for b, n in sizes}
    number = F.create_map(*chain.from_iterable((F.lit(b), F.lit(p)) for b, p in parts.items()))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), number[F.col("bucket")]).cast("int"))
    groups = max(1, -(-queries.count() // ITEMS))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    by = ["bucket", "part", "group"]
    shape = "item long, item_id long, key long, row long, score long"

    def meet(rows: DataFrame, asking: DataFrame) -> DataFrame:
        rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return rows.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(
            partial(_search, k=k, documents=documents, total=total), shape
        )

    def blocks(of: list[tuple[int, int, int]]) -> Column:
        """Explodes to (bucket, length above all of its vectors, part) of blocks [first, last part] by bucket."""
        all_ = [F.struct(
            F.lit(b).alias("bucket"), F.lit(2.0 ** ((b + 1) / PARTS)).alias("top"), F.lit(a).alias("a"), F.lit(z).alias("z")
        ) for b, a, z in of]
        return F.array(*all_)

    # the longest vectors: whole buckets while they make less than a block, then one part of the next
    ahead, rows = [], 0
    for b, n in sizes:
        ahead.append((b, 0, 0))
        rows += n // parts[b]
        if parts[b] > 1 or rows >= ROWS:
            break
    rest = [(b, 1 if b in {x[0] for x in ahead} else 0, parts[b] - 1) for b, _ in sizes]
    rest = [x for x in rest if x[1] <= x[2]]
    part_ = F.explode(F.sequence("at.a", "at.z")).alias("part")
    first = queries.withColumn("least", F.lit(0).cast("long")).select("*", F.explode(blocks(ahead)).alias("at"))
    in_first = F.col("bucket").isin([x[0] for x in ahead]) & (F.col("part") == 0)
    best = stage.store(meet(placed.where(in_first), first.select("*", "at.bucket", part_).drop("at")), "first")
    order = [F.desc("score"), F.asc_nulls_last("key"), "row"]
    place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    if rest:
        kth = best.withColumn("rank", place).where(F.col("rank") == k).select("item", F.col("score").alias("least"))
        asking = queries.join(kth, "item", "left").fillna(0, ["least"])
        asking = asking.select("*", F.explode(blocks(rest)).alias("at"))
        asking = asking.where(F.col("length") * F.col("at.top") * (1 + SLACK) >= F.col("least"))
        others = meet(placed.where(~in_first), asking.select("*", "at.bucket", part_).drop("at"))
        best = best.unionByName(others)
    return best.withColumn("rank", place).where(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id"), "score"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


SQL = """
WITH pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM pieces GROUP BY ALL
), lengths AS (
  SELECT doc_id, count(*) AS n FROM pieces GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term
), impact AS (
  SELECT t.doc_id, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * l.n * c.docs) // c.total))) AS part
  FROM tf t JOIN lengths l USING (doc_id) JOIN weights w USING (term), corpus c
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN impact USING (term)
  GROUP BY item_id, doc_id HAVING sum(part) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored
) WHERE rank <= 20
"""
