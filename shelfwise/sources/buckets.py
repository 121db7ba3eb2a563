"""Tables kept in buckets of their join key, so that joins on it move no rows.

A table that is joined on (store, date) again and again, the fact with traffic, weather and events, is
dealt to buckets once, when it is written. Tables with the same number of buckets on the same keys are
joined bucket by bucket without an exchange; a table that is not bucketed, or one made on the way, is
shuffled to the buckets of the other side, which stays where it is as long as there are as many
buckets as shuffle partitions.

A bucket holds whole keys, and adaptive execution cannot split it, as nothing is shuffled. So keys must
be fine: no (store, date) should hold more rows than fit a task. For coarser keys, such as the
store alone, leave the join to Catalyst, which splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shelfwise.functions.columns import require_columns

KEYS = ("store_id", "date")


def write_bucketed(
    rows: DataFrame, table: str, path: str, keys: Sequence[str] = KEYS, buckets: int | None = None
) -> DataFrame:
    """Write ``rows`` as the catalog's ``table`` at ``path`` and read it back.

    One exchange deals the rows as the buckets do, so that each bucket is one file. A bucket is a task
    of later joins, so their number should follow the size of the largest table; by default there are
    as many as shuffle partitions.
    """
    require_columns(rows, keys, table)
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartition(buckets, *keys)
        .write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(table)
    )
    return rows.sparkSession.table(table)
