"""Predicates: strict API filters, permissive matching filters, text and list tests. All are Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equal_to(wanted: Mapping[str, object]) -> Column:
    """Conjunction of equalities over the entries that are not None (a null in the data never matches)."""
    return all_of([F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None])


def work_mode(column: str, wanted: bool | str | None) -> Column:
    """True means 'remote', False 'onsite', a string itself, None no filter."""
    if wanted is None:
        return F.lit(True)
    return F.col(column) == F.lit({True: "remote", False: "onsite"}.get(wanted, wanted))


def not_in_future(column: str, now: Column) -> Column:
    return F.col(column).isNull() | (F.col(column) <= now)


def contains_ci(column: str | Column, text: str) -> Column:
    """Case-insensitive substring; % and _ in ``text`` are plain characters."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (F.col(column) if isinstance(column, str) else column).ilike(f"%{escaped}%")


def list_has_ci(column: str | Column, value: str) -> Column:
    return F.exists(column, lambda x: F.lower(x) == F.lower(F.lit(value)))


def json_list_has_ci(column: str | Column, value: str) -> Column:
    """Membership in a JSON list of strings."""
    return F.coalesce(list_has_ci(F.from_json(column, "array<string>"), value), F.lit(False))


def list_matching(column: str | Column, text: str) -> Column:
    """The elements that contain ``text``, case-insensitively."""
    return F.filter(column, lambda x: F.contains(F.lower(x), F.lower(F.lit(text))))


def between_open(column: str, low=None, high=None) -> Column:
    """low <= column <= high with either bound absent; null never matches a present bound."""
    return all_of([*([F.col(column) >= low] if low is not None else []), *([F.col(column) <= high] if high is not None else [])])


def permissive(column: str, allowed: Sequence | None, same_as_null: Sequence = ()) -> Column:
    """No allowed values: no filter. A null (or a value that counts as null) in the data never excludes a row."""
    if not allowed:
        return F.lit(True)
    return F.col(column).isNull() | F.col(column).isin(*allowed, *same_as_null)


def permissive_range(column: str, low=None, high=None) -> Column:
    return F.col(column).isNull() | between_open(column, low, high)


def funnel(df: DataFrame, allowed: Mapping[str, Sequence | None], ranges: Mapping[str, tuple] | None = None, same_as_null: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows that pass every permissive filter."""
    tests = [permissive(c, v, (same_as_null or {}).get(c, ())) for c, v in allowed.items()]
    return df.where(all_of([*tests, *(permissive_range(c, *r) for c, r in (ranges or {}).items())]))


def first_long(columns: Sequence[Column], least: int = 80) -> Column:
    """The first of ``columns`` with at least ``least`` characters (short or empty ones are passed over)."""
    return F.coalesce(*(F.when(F.length(c) >= least, c) for c in columns))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def all_tokens(text: Column, query: str) -> Column:
    """Full-text test: every token of ``query`` is a token of ``text`` (lower case, no stemming)."""
    wanted = [w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()]
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), words(text))) == 0 if wanted else F.lit(False)


def json_has(column: str, key: str) -> Column:
    """Whether the JSON object has ``key`` at its top level, null values included."""
    return F.array_contains(F.json_object_keys(F.col(column)), key)


def json_has_any(column: str, keys: Sequence[str]) -> Column:
    return F.arrays_overlap(F.json_object_keys(F.col(column)), F.array(*map(F.lit, keys)))


def row_before(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Row-value comparison (a, b, ...) < (c, d, ...)."""
    return F.struct(*left) < F.struct(*right)


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """DataFrames under names that the session's SQL can read."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
