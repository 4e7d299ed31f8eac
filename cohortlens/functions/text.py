"""Charset repair and ordered keyword classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cp1252_specials() -> tuple[str, str]:
    special, control = [], []
    for byte in range(0x80, 0xA0):
        try:
            special.append(bytes([byte]).decode("cp1252"))
        except UnicodeDecodeError:
            continue
        control.append(chr(byte))
    return "".join(special), "".join(control)


_SPECIAL, _CONTROL = _cp1252_specials()


def repair_charset(text: Column) -> Column:
    """Undo UTF-8 text that was once read as windows-1252.

    The 27 windows-1252 characters outside Latin-1 go back to their byte values first, so the
    strict Latin-1 encoder covers the whole code page. Text that holds a character of no such
    byte, or whose bytes are not UTF-8, was not damaged that way and is left as it is.
    """
    narrow = F.translate(text, _SPECIAL, _CONTROL)
    mappable = ~narrow.rlike("[^\\u0000-\\u00FF]")
    repaired = F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string"))
    return F.coalesce(F.when(mappable, repaired), text)


Rule = tuple[str, str, str]


def classify(columns: dict[str, Column], rules: Sequence[Rule], default: str) -> Column:
    """First rule that holds gives the class. A rule is (column, test, class).

    A test that starts with ``~`` is a regular expression, any other is looked for as it stands.
    """
    chain = None
    for name, test, label in rules:
        column = columns[name]
        hit = column.rlike(test[1:]) if test.startswith("~") else column.contains(test)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(default)
