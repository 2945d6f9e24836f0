"""Column-level cleaning: bad text becomes null, null conditions keep the default."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

ColumnLike = Column | str

# Accepted date layouts, tried in this order.
DATE_PATTERNS = ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd")
# Fixed value: plain decimal or scientific number, optionally surrounded by blanks.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: ColumnLike) -> Column:
    """Text to date; anything unreadable is null."""
    text = F.trim(as_col(c).cast("string"))
    return F.coalesce(*[F.try_to_date(text, p) for p in DATE_PATTERNS])


def parse_month(c: ColumnLike) -> Column:
    """``YYYYMM`` text to the first day of that month."""
    return F.try_to_date(F.concat(F.trim(as_col(c)), F.lit("01")), "yyyyMMdd")


def parse_number(c: ColumnLike) -> Column:
    """Text to double; blank or unreadable text is null."""
    text = as_col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def code_match(c: ColumnLike, pattern: str) -> Column:
    """Regex test that is false, not null, for a missing code."""
    if not pattern.isascii():
        warnings.warn(f"code pattern {pattern!r} holds non-ASCII characters", stacklevel=2)
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def any_code_match(cols: Sequence[ColumnLike], pattern: str) -> Column:
    """True when any of the code columns matches."""
    return reduce(or_, [code_match(c, pattern) for c in cols])


def member(c: ColumnLike, values: Iterable) -> Column:
    """Set membership that is false, not null, for a missing value."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for an unknown condition)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def overwrite(default: ColumnLike, *rules: tuple[Column, object]) -> Column:
    """Start from ``default`` and apply ``(condition, value)`` rules in order, the last match winning."""
    out: Column | None = None
    for condition, value in reversed(rules):
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def bracket(c: ColumnLike, breaks: Sequence[float], labels: Sequence[object]) -> Column:
    """Right-closed brackets with the lowest break included; values outside become null."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per bracket is needed")
    x = as_col(c)
    out = F.when((x < breaks[0]) | (x > breaks[-1]) | x.isNull(), F.lit(None))
    for upper, label in zip(breaks[1:], labels):
        out = out.when(x <= upper, F.lit(label))
    return out


def dummies(df: DataFrame, column: str, levels: Sequence[object]) -> DataFrame:
    """One 0/1 column per level; a missing category gives missing dummies."""
    return df.withColumns({f"{column}_{v}": (F.col(column) == F.lit(v)).cast("int") for v in levels})


def level_index(c: ColumnLike, levels: Sequence[object]) -> Column:
    """Position of a value in its level list, from 1; unlisted values are null."""
    out: Column | None = None
    for i, v in enumerate(levels, start=1):
        hit = as_col(c) == F.lit(v)
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    if out is None:
        raise ValueError("levels must not be empty")
    return out


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null to 0 in the named columns."""
    return df.fillna(0, subset=list(columns))


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns matching a regex."""
    return [c for c in df.columns if re.search(pattern, c)]


def rename(df: DataFrame, **names: str) -> DataFrame:
    """Rename columns, given as ``old=new``."""
    return df.withColumnsRenamed(names)


def censor(df: DataFrame, event: str, date: str, study_end: str) -> DataFrame:
    """Missing outcome becomes no event, dated at the end of the study."""
    missing = F.col(date).isNull() | F.col(event).isNull()
    return df.withColumns(
        {
            event: F.when(missing, F.lit(0)).otherwise(F.col(event)),
            date: F.when(missing, F.lit(study_end).cast("date")).otherwise(F.col(date)),
        }
    )


def age_at(date: ColumnLike, birth_year: ColumnLike) -> Column:
    """Age as the difference of calendar years."""
    return F.year(as_col(date)) - as_col(birth_year)


def last_day(start: ColumnLike, days: ColumnLike) -> Column:
    """Last covered day of a supply that starts on ``start`` and lasts ``days`` days."""
    return F.date_add(as_col(start), F.floor(as_col(days) - 1).try_cast("int"))


def in_lookback(date: ColumnLike, index: ColumnLike, days: int) -> Column:
    """Date inside the half-open window ``[index - days, index)``."""
    d, i = as_col(date), as_col(index)
    return (d >= F.date_sub(i, days)) & (d < i)
