"""Keyset pagination: opaque cursors, pages with nulls last, and top-k before wide columns are read."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 500


def clamp(limit: int, most: int = MAX_LIMIT) -> int:
    return max(1, min(limit, most))


def write_cursor(values: Sequence) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(values), default=str).encode()).decode()


def read_cursor(cursor: str | None, size: int) -> list | None:
    """The key values of a cursor; ValueError if it is not one."""
    if not cursor:
        return None
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except Exception as e:
        raise ValueError("bad cursor") from e
    if not isinstance(values, list) or len(values) != size:
        raise ValueError("bad cursor")
    return values


def row_cursor(*keys: str) -> Column:
    """Each row's own cursor, its key values as strings; ``read_cursor`` reads it."""
    values = F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))
    return F.translate(F.base64(F.encode(values, "UTF-8")), "+/", "-_")


def row_values(cursor: Column) -> Column:
    """The key values of a column of cursors, as an array of strings; null where one is damaged."""
    decoded = F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64"))
    return F.from_json(F.decode(decoded, "UTF-8"), "array<string>")


def order(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    """Sort columns of (column, descending) keys, nulls last either way."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]


def after(df: DataFrame, keys: Sequence[tuple[str, bool]], values: Sequence) -> Column:
    """Rows that follow the key ``values``: on the first key that differs they are further on, or null where it is not."""
    test, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(keys, values, strict=True):
        column = F.col(c)
        if v is None:
            here = F.lit(False)  # nothing follows a null but nulls that differ in a later key
            equal = column.isNull()
        else:
            value = F.lit(v).cast(df.schema[c].dataType)
            here = (column < value if down else column > value) | column.isNull()
            equal = column == value
        test, same = test | (same & here), same & equal
    return F.coalesce(test, F.lit(False))


def page(df: DataFrame, keys: Sequence[tuple[str, bool]], cursor: str | None, limit: int) -> DataFrame:
    """One page and one row more (its presence tells that a next page exists)."""
    values = read_cursor(cursor, len(keys))
    rows = df if values is None else df.where(after(df, keys, values))
    return rows.orderBy(*order(keys)).limit(clamp(limit) + 1)


def envelope(rows: list, keys: Sequence[tuple[str, bool]], limit: int) -> dict:
    """data, next_cursor and count of a collected page."""
    data, more = rows[: clamp(limit)], len(rows) > clamp(limit)
    return {"data": data, "next_cursor": write_cursor([data[-1][c] for c, _ in keys]) if more else None, "count_page": len(data)}


def top_then_wide(narrow: DataFrame, wide: DataFrame, keys: Sequence[tuple[str, bool]], on: str, limit: int) -> DataFrame:
    """Top ``limit`` (at most ``MAX_LIMIT``) keys first; only their wide rows are joined."""
    chosen = narrow.orderBy(*order(keys)).limit(clamp(limit)).select(on)
    return wide.join(F.broadcast(chosen), on)
