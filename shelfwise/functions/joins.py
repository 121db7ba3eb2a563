"""Left joins of the fact with reference tables.

Two cases only. A table with one row per calendar date is bounded by the calendar
whatever the size of the fact, so it is broadcast by hint: its Catalyst estimate
comes from the fact it was aggregated from and would never pass the size check.
Any other table is joined without a hint. Catalyst broadcasts it if its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both
sides, and adaptive execution splits the partitions of a hot key.

Adaptive execution joins small partitions but never makes more than there are shuffle partitions, so with
few of those a task's rows grow with the input. Plans that sort and group the whole fact by store and day
therefore take a number of partitions that follows the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_IN_A_TASK = 1_000_000


def attach(fact: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with a table that has at most one row per key."""
    return fact.join(table, list(on), "left")


def tasks_for(rows: DataFrame, size: int = ROWS_IN_A_TASK) -> int:
    """Partitions of about ``size`` rows, as many as shuffle partitions at least. Counts the rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // size))


def deal(rows: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Rows in ``partitions`` by ``keys``, where joins and groups on them find them; None leaves it to Catalyst."""
    return rows if partitions is None else rows.repartition(partitions, *keys)


def attach_daily(fact: DataFrame, daily: DataFrame, date: str = "date") -> DataFrame:
    """Left join with a table the caller has grouped by ``date``.

    A century of days is 36,525 rows, so the broadcast side stays under a few
    megabytes for any size of the fact. That holds for days only, so the key must be
    a date.
    """
    kind = daily.schema[date].dataType
    if not isinstance(kind, T.DateType):
        raise TypeError(f"{date} must be a date, not {kind.simpleString()}")
    return fact.join(F.broadcast(daily), [date], "left")
