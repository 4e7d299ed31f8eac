"""Filter of key combinations with a fixed size, applied where a large table is scanned.

The keys are dealt over words of 64 bits; each key sets three bits of its word. A row whose three
bits are not all set has no key among them, so it needs no exchange. Rows that pass may still have
none (with four keys a word about 1 in 150), and a join decides about those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a filter: at most so many rows of two numbers are broadcast, however many keys there are.
WORDS = 1 << 20
_BITS = 3


def _place(on: Sequence[str], words: int) -> tuple[Column, Column]:
    """Word of a key and its bits in it."""
    names = ", ".join(f"`{c}`" for c in on)
    bits = f"xxhash64({names}, 1)"
    parts = [f"shiftleft(1L, cast(shiftrightunsigned({bits}, {6 * i}) & 63 as int))" for i in range(_BITS)]
    return F.expr(f"pmod(xxhash64({names}), {words})"), F.expr(" | ".join(parts))


def key_filter(keys: DataFrame, on: Sequence[str], words: int = WORDS) -> DataFrame:
    """The filter of all combinations of ``on`` in ``keys``: one row per word that has a bit set.

    Bits are joined map-side, so the exchange moves at most ``words`` rows of each task.
    """
    word, bits = _place(on, words)
    return keys.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def may_match(df: DataFrame, held: DataFrame, on: Sequence[str], words: int = WORDS) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter; every row whose key is in it stays.

    A row with a NULL in its key has no partner and may stay or go. Being a semi-join, the filter sinks through
    projections, unions, distinct rows and joins to the scan that has the key.
    """
    word, bits = _place(on, words)
    # the bits are named once, as each mention makes the key anew
    want = (word == F.col("_word")) & (F.bitwise_not("_bits").bitwiseAND(bits) == 0)
    return df.join(F.broadcast(held), want, "left_semi")
