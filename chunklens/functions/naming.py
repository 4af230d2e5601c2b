"""Names: mappings that must know every name, labels with a default, orders of categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _looked_up(name: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[name]


def mapped(name: Column, table: dict[str, str], what: str = "name") -> Column:
    """The name's value; a name that isn't in the table, or null, ends the job with an error that tells it."""
    return F.coalesce(_looked_up(name, table), F.raise_error(F.concat(F.lit(f"unmapped {what}: "), F.coalesce(name, F.lit("null")))))


def labelled(name: Column, table: dict[str, str]) -> Column:
    """The name's label, or the name itself."""
    return F.coalesce(_looked_up(name, table), name)


def place(name: Column, order: Sequence[str]) -> Column:
    """Place of a category in an order, from 0; all others come after those named (to be sorted by name next)."""
    at = F.array_position(F.array(*map(F.lit, order)), name)
    return F.coalesce(F.when(at > 0, at - 1), F.lit(len(order))).cast("int")


def admitted(name: Column, names: Sequence[str] | None) -> Column:
    """Whether a name is on an allow-list; without a list, or with an empty one, all are."""
    return F.coalesce(name.isin(*names), F.lit(False)) if names else F.lit(True)
