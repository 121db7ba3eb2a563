"""Percentile intervals of a mean difference by resampling both arms.

Draw ``i`` of replicate ``r`` picks a position from a hash of (seed, key, arm, r, i),
so the answer does not depend on partitioning, retries or task order. 'xxhash64' is the
fast choice; 'md5' gives positions that any SQL engine can recompute.

No draw is a row. An arm's values travel as arrays of ``CHUNK`` positions, once per block of
replicates, and a task turns such a row into the sums that all replicates of the block take from
the chunk. Those partial sums add up to the replicate means, whatever the size of an arm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import require_columns
from shelfwise.functions.draws import md5_draws, xxhash64_draws

REPLICATES_PER_ROW = 100
CHUNK = 1 << 18
DRAWS_AT_ONCE = 1 << 18


def _label(keys: Sequence[str], arm: str) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col(arm).cast("string"))


def _chunk_sums(seed: int, size: int, replicates: int, hash_name: str, width: int, lot: int, out: list[str]):
    """Per row (arm chunk, block of replicates): sums and numbers of the values each replicate draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, hits = [], []
            rows = [batch.column(c).to_pylist() for c in ("_label", "_n", "_chunk", "_block", "_seeds")]
            for i, (label, n, chunk, block, seeds) in enumerate(zip(*rows)):
                held = batch.column("_values")[i].values
                known = held.is_valid().to_numpy(zero_copy_only=False)
                values = held.fill_null(0.0).to_numpy(zero_copy_only=False)
                these = range(block * size, min(block * size + size, replicates))
                total, count = np.zeros(len(these)), np.zeros(len(these), dtype=np.int64)
                step = max(1, lot // len(these))
                for low in range(0, n, step):
                    high = min(n, low + step)
                    if hash_name == "md5":
                        draws = md5_draws([f"{seed}|{label}|{r}|".encode() for r in these], low, high)
                    else:
                        draws = xxhash64_draws(np.array(seeds), low, high)
                    place = draws % n - chunk * width
                    inside = (place >= 0) & (place < len(values))
                    place[~inside] = 0
                    total += np.where(inside, values[place], 0.0).sum(axis=1)
                    count += (inside & known[place]).sum(axis=1)
                sums.append(total)
                hits.append(count)
            columns = [batch.column(c) for c in out]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.int64()))],
                [*out, "_sums", "_hits"],
            )

    return run


def replicate_means(
    samples: DataFrame,
    by: Sequence[str],
    position: str,
    value: str,
    replicates: int,
    seed: int = 42,
    hash_name: str = "xxhash64",
    bounded: bool = False,
) -> DataFrame:
    """``_mean`` per (by, ``_replicate``). ``samples`` has the arm's ``_label`` and size ``_n``.

    ``bounded`` states that no arm has more than ``CHUNK`` values.
    """
    if hash_name not in ("md5", "xxhash64"):
        raise ValueError(f"unknown hash: {hash_name}")
    spark = samples.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(REPLICATES_PER_ROW, replicates)
    chunk = F.lit(0).cast("long") if bounded else F.floor(F.col(position) / F.lit(CHUNK)).cast("long")
    held = F.struct(F.col(position).alias("at"), F.col(value).cast("double").alias("x"))
    series = (
        samples.withColumn("_chunk", chunk)
        .groupBy(*by, "_label", "_n", "_chunk")
        .agg(F.array_sort(F.collect_list(held)).alias("_s"))
    )
    blocks = series.select(
        *by,
        "_label",
        F.col("_n").cast("long").alias("_n"),
        "_chunk",
        F.col("_s.x").alias("_values"),
        F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // size))).alias("_block"),
    ).repartition(tasks, *by, "_chunk", "_block")
    last = F.least(F.col("_block") * size + size, F.lit(replicates)) - 1
    seeds = F.lit(None).cast("array<long>")
    if hash_name == "xxhash64":
        seeds = F.transform(F.sequence(F.col("_block") * size, last), lambda r: F.xxhash64(F.lit(seed), "_label", r))
    blocks = blocks.withColumn("_seeds", seeds)
    out = [*by, "_block"]
    schema = T.StructType([blocks.schema[c] for c in out])
    schema.add("_sums", T.ArrayType(T.DoubleType())).add("_hits", T.ArrayType(T.LongType()))
    parts = blocks.mapInArrow(_chunk_sums(seed, size, replicates, hash_name, CHUNK, DRAWS_AT_ONCE, out), schema)
    return (
        parts.select(*out, F.posexplode(F.arrays_zip("_sums", "_hits")).alias("_r", "_part"))
        .groupBy(*by, (F.col("_block") * size + F.col("_r")).alias("_replicate"))
        .agg(F.try_divide(F.sum("_part._sums"), F.sum("_part._hits")).alias("_mean"))
    )


def mean_difference_interval(
    samples: DataFrame,
    keys: Sequence[str],
    arm: str,
    position: str,
    value: str,
    replicates: int,
    seed: int = 42,
    alpha: float = 0.05,
    hash_name: str = "xxhash64",
    bounded: bool = False,
) -> DataFrame:
    """``ci_low`` and ``ci_high`` of mean(arm) - mean(not arm) per key.

    ``position`` numbers the values of an arm from 0. ``bounded`` states that every
    arm has at most one value per calendar day, so that an arm is one array; the
    numbers are the same without it.
    """
    require_columns(samples, [*keys, arm, position, value], "samples")
    by = [*keys, arm]
    sizes = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = samples.join(sizes, by).withColumn("_label", _label(keys, arm))
    means = replicate_means(sized, by, position, value, replicates, seed, hash_name, bounded)
    on = F.max(F.when(F.col(arm), F.col("_mean")))
    off = F.max(F.when(~F.col(arm), F.col("_mean")))
    diffs = means.groupBy(*keys, "_replicate").agg((on - off).alias("_diff"))
    return diffs.groupBy(*keys).agg(
        F.percentile("_diff", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("_diff", F.lit(1 - alpha / 2)).alias("ci_high"),
    )
