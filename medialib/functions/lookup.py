"""Look-ups in a table that goes with a query: as long as the table's entries are few enough for a plan, their number doesn't slow a look-up."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})" if value else "array()"
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict[str, tuple], fields: dict[str, str]):
    """A function from a key to its entry, a struct of fields (name to type), or null.

    The entries are dealt by a hash of their keys to as many small maps, which
    are one literal: a look-up hashes its key and goes through one of them.
    """
    size = 1
    while size < len(table):
        size *= 2
    slots: list[dict[str, tuple]] = [{} for _ in range(size)]
    for key, entry in table.items():
        slots[zlib.crc32(key.encode()) & (size - 1)][key] = entry
    kind = f"map<string, struct<{', '.join(f'{name}: {of}' for name, of in fields.items())}>>"

    def one(slot: dict[str, tuple]) -> str:
        pairs = (f"{_literal(key)}, struct({', '.join(f'CAST({_literal(x)} AS {of}) AS {name}' for x, (name, of) in zip(entry, fields.items(), strict=True))})" for key, entry in slot.items())
        return f"CAST(map({', '.join(pairs)}) AS {kind})"

    literal = F.expr(f"array({', '.join(map(one, slots))})")
    return lambda key: F.element_at(F.get(literal, F.crc32(key.cast("binary")).bitwiseAND(F.lit(size - 1)).cast("int")), key)
