"""Benjamini-Hochberg adjusted p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import require_columns
from shelfwise.functions.ordered import running_counts, suffix_minimum, value_histogram


def adjust(tests: DataFrame, p: str, families: Sequence[str] = (), out: str = "fdr_qvalue") -> DataFrame:
    """Add the adjusted p-value of each test inside its family.

    Null p-values stay null and do not count. Ranks and the running minimum are
    taken over distinct p-values in the same ranges, so a family of any size (one test
    per store, say) is never ordered in one task.
    """
    require_columns(tests, [p, *families], "tests")
    families = list(families)
    ranked = running_counts(value_histogram(tests, families, p), families, p, "n", keep_ranges=True)
    raw = F.col(p) * F.col("n_total") / F.col("n_through")
    smallest = suffix_minimum(ranked.withColumn("_raw", raw), families, p, "_raw", "_q")
    adjusted = smallest.select(*families, p, F.least("_q", F.lit(1.0)).alias(out))
    return tests.join(adjusted, [*families, p], "left")
