"""Column expressions and checks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` naming the columns that ``df`` lacks. Runs no job."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {sorted(missing)}")


def promo_flag(text: Column) -> Column:
    """'true' in any letter case is True; every other text and null is False."""
    return F.coalesce(F.lower(text) == F.lit("true"), F.lit(False))


def to_number(value: Column) -> Column:
    """Double, with unreadable text and NaN as null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def flag(value: Column) -> Column:
    """Boolean with null as False."""
    return F.coalesce(value.cast("boolean"), F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null where ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    """Change from ``old`` to ``new`` in percent, null where ``old`` is 0."""
    return F.lit(100.0) * F.try_divide(new - old, old)


def calendar_columns(date: Column) -> dict[str, Column]:
    """Calendar features of a date. Weeks are ISO weeks and Monday is 0."""
    return {
        "day_of_week": F.weekday(date),
        "day_of_month": F.dayofmonth(date),
        "month": F.month(date),
        "week_of_year": F.weekofyear(date),
        "is_month_start": (F.dayofmonth(date) == 1).cast("int"),
        "is_month_end": (date == F.last_day(date)).cast("int"),
    }


def fill_both_ways(value: Column, order: str, keys: Sequence[str] = ()) -> Column:
    """Last known value at or before the row, else the first known one after it.

    The look ahead is a running frame in descending order: a frame that reaches to the
    end of the group would be scanned again for every row.
    """
    window = Window.partitionBy(*keys)
    before = window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(
        F.last(value, ignorenulls=True).over(before), F.last(value, ignorenulls=True).over(after)
    )
