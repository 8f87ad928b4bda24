"""Pages by position: a cursor names the last row of a page, and the next page is what comes after it in the order.

The filter of a page reaches the scan, and a page costs a top-k of what is left, however deep it lies; an offset sorts all that it skips.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siltworks.operators.paging import MOST_PAGE_SIZE


@dataclass(frozen=True)
class Key:
    """One column of an order. Nulls come first when ascending and last when descending."""

    name: str
    column: Column
    down: bool = False

    def order(self) -> Column:
        return self.column.desc_nulls_last() if self.down else self.column.asc_nulls_first()

    def after(self, value: object) -> Column:
        """Whether a row comes behind value in this column alone."""
        if value is None:
            return F.lit(False) if self.down else self.column.isNotNull()
        return (self.column < F.lit(value)) | self.column.isNull() if self.down else self.column > F.lit(value)

    def from_(self, value: object) -> Column:
        """Whether a row comes at value or behind it."""
        if value is None:
            return self.column.isNull() if self.down else F.lit(True)
        return (self.column <= F.lit(value)) | self.column.isNull() if self.down else self.column >= F.lit(value)


_KINDS = {"datetime": datetime.fromisoformat, "date": date.fromisoformat, "Decimal": Decimal}


def cursor_of(row: Row | Mapping, keys: Sequence[Key]) -> str:
    """A token for the place of a row of page(); it holds the values of the keys with their types."""
    told = []
    for key in keys:
        value = row[f"seek_{key.name}"]
        kind = type(value).__name__
        told.append([key.name, key.down, kind, value.isoformat() if isinstance(value, datetime | date) else str(value) if isinstance(value, Decimal) else value])
    return base64.urlsafe_b64encode(json.dumps(told).encode()).decode()


def values_of(cursor: str, keys: Sequence[Key]) -> list[object]:
    """The key values of a token; a token of another order, or none at all, is refused."""
    try:
        told = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        if [(name, down) for name, down, _, _ in told] != [(k.name, k.down) for k in keys]:
            raise ValueError("cursor of another order")
        return [_KINDS[kind](value) if kind in _KINDS else value for _, _, kind, value in told]
    except (TypeError, ValueError) as broken:
        raise ValueError(f"not a cursor of this order: {broken}") from None


def after(keys: Sequence[Key], values: Sequence[object]) -> Column:
    """Rows behind a place: equal in some keys from the left, behind in the next one. What holds for the first key by itself is said first, as a filter that
    a scan can take."""
    out, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, values, strict=True):
        out = out | (equal & key.after(value))
        equal = equal & key.column.eqNullSafe(F.lit(value))
    return keys[0].from_(values[0]) & out


def page(rows: DataFrame, keys: Sequence[Key], size: int, cursor: str | None = None, most: int = MOST_PAGE_SIZE) -> DataFrame:
    """The first size rows behind cursor (from the start without one), in order, with their key values as seek_<name>. The keys together must tell any two
    rows apart, or rows that tie with the last of a page are passed over."""
    if not 1 <= size <= most or not keys:
        raise ValueError("page out of range")
    if cursor is not None:
        rows = rows.where(after(keys, values_of(cursor, keys)))
    return rows.withColumns({f"seek_{k.name}": k.column for k in keys}).orderBy(*[k.order() for k in keys]).limit(size)


def relationship_keys() -> list[Key]:
    """Type, source, target (or what it is not resolved to), path, line, column, id."""
    target = F.coalesce(F.col("target_id").cast("string"), F.col("unresolved_target").cast("string"), F.lit(""))
    columns = [F.col("relationship_type"), F.col("source_id"), target, F.col("relative_path"), F.col("line"), F.col("column"), F.col("relationship_id")]
    return [Key(name, column) for name, column in zip(("type", "source", "target", "path", "line", "column", "id"), columns, strict=True)]


def snapshot_keys() -> list[Key]:
    """Completed last first, then by id."""
    return [Key("completed_at", F.col("completed_at"), down=True), Key("id", F.col("snapshot_id"))]


def history_keys() -> list[Key]:
    """The latest event first."""
    return [Key("id", F.col("event_id"), down=True)]
