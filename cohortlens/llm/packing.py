"""Operator 4: concatenate and cut.

First pass: every task turns its documents into ids and notes how many ids its own earlier
documents have; the rows are written with the number of the task. Second pass: prefix sums over
the totals of the tasks give each document its place in one long stream of ids, which windows of
fixed width cut into sequences. A document that crosses a border has one record on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import SENT, Stage, binaries, cut, offsets_of, read
from cohortlens.llm.words import LowerWords

BATCH = 8_000_000  # bytes of text turned into ids at a time, one row at least
SMALL = 1_000_000  # rows, of 16 bytes, up to which the totals of the tasks are broadcast


def pack(docs: DataFrame, path: str, width: int = 2048, end: int = 1) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the ids of the piece as little-endian 32-bit numbers. The stream has no gaps: all
    sequences are full but the last. Null and empty texts have only the closing id. Every row is a
    document of its own, rows with the same or no doc_id included. Other columns are ignored. An
    empty table gives no rows. Documents follow each other in the order in which the first pass
    read them, which is written down with them.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encoder = TaskContext.get().partitionId(), 0, LowerWords(path)
        for big in batches:
            for batch in cut(big, BATCH):
                ids, counts = encoder.encode(batch.column(1).fill_null(""), end)
                ahead = before + offsets_of(counts)[:-1]
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part)),
                        batch.column(0),
                        pa.array(counts),
                        pa.array(ahead),
                        binaries(ids.astype("<u4"), 4 * counts),
                    ],
                    ["part", "doc_id", "doc_tokens", "ahead", "data"],
                )

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT)
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    schema = "part long, doc_id long, doc_tokens long, ahead long, data binary"
    coded = stage.store(rows.mapInArrow(run, schema), "ids")
    totals = stage.store(coded.groupBy("part").agg(F.sum("doc_tokens").alias("total")), "totals")
    # one row per task of the first pass
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    if totals.count() <= SMALL:
        bases = F.broadcast(bases)
    at = F.col("base") + F.col("ahead")
    first, last = F.floor(at / width), F.floor((at + F.col("doc_tokens") - 1) / width)
    pieces = coded.join(bases, "part").select(
        "doc_id", "doc_tokens", "data", at.alias("at"), F.explode(F.sequence(first, last)).alias("sequence_id")
    )
    begin = F.greatest(F.col("at"), F.col("sequence_id") * width)
    stop = F.least(F.col("at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * width)
    start, length = begin - F.col("at"), stop - begin
    return pieces.select(
        "doc_id",
        start.alias("start"),
        length.alias("length"),
        F.substring("data", (4 * start + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
        "doc_tokens",
        "sequence_id",
        (begin - F.col("sequence_id") * width).alias("offset"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    pieces = pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
