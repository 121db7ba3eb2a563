"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Method. Every source gets a target of words from its weight and its size. The target takes as many
complete epochs of the source as fit; what is left is a fractional epoch: each document draws the
exponential key -ln(u) / weight, u from a hash of its id and the seed, and documents are taken in
the order of their keys until their prefix sum of sizes is as near to the budget as it can be.

Scale. No source is ever sorted as a whole. Keys map monotonically to COARSE * FINE buckets; bucket
sums are partial aggregates, the windows run over at most COARSE and FINE of them per source, and
only documents of the one bucket where the budget ends are ordered, about one in a million of a
source, and of those that repeat a row only one with its number. Everything else is decided by its
bucket. Sizes, keys and row numbers are written once, so each text is read once and a row keeps its number; the written limits have a known size, so that Spark joins a hot source without moving
its documents as long as that size is below its broadcast threshold. The tables of sources have one row per source;
the windows that rank sources and share the excess see those rows only.

Rules for odd rows. A null text has size 0. Null sources are one source, the last. Rows without
doc_id draw from their text. Rows that repeat a doc_id have the same key, the shorter ones first;
where the budget ends among equal ones, the first by row number are taken.
Negative, null or non-finite document weights count as the default weight. A source without
words has target 0. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.lineage import pin
from shelfwise.functions.ordered import number_rows

SOURCE_WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
SEED = 17
COARSE = 1024
FINE = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without white space, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame,
    weights: Sequence[int] = SOURCE_WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST_EPOCHS,
) -> DataFrame:
    """source, source_size, target from (source, size): one row per source.

    Water filling: sources in the order of size per weight are capped at ``most`` times their size
    as long as the level, the words per unit of weight of what is left, exceeds their cap.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*(F.lit(float(w)) for w in weights))
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", values[F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights)))])
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * (share_percent / 100.0)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.greatest(left, F.lit(0.0)) / open_weight
    filled = sources.withColumn("level", level).withColumn(
        "capped", F.col("cap") <= F.col("level") * F.col("weight")
    )
    # The first source that stays under its cap fixes the level of all after it.
    final = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("capped") | final.isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), final * F.col("weight"))
    )
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    document_weights: DataFrame | None = None,
    weights: Sequence[int] = SOURCE_WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of (doc_id, text, source).

    ``document_weights`` has one positive ``weight`` per ``doc_id``; heavier documents come earlier
    in the fractional epoch. Documents without one have weight 1.
    """
    sized = pin(_sized(docs, document_weights, seed), "sized")
    targets = source_targets(sized, weights, share_percent).withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0))
        .cast("long"),
    )
    targets = pin(
        targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets"
    )

    # The coarse bucket, then the fine bucket in it, where the budget ends.
    coarse = pin(
        _ends(sized.select(F.col("source").alias("of"), F.col("coarse").alias("bucket"), "size"), targets),
        "coarse",
    )
    inside = sized.alias("s").join(
        coarse.alias("c"),
        F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.coarse") == F.col("c.bucket")),
    )
    inside = pin(
        inside.select(
            F.col("s.source").alias("of"), F.col("s.place").alias("bucket"), "s.size", "s.doc_id", "s.key", "s.row"
        ),
        "inside",
    )
    fine = pin(_ends(inside, coarse.select("source", F.col("left").alias("budget"))), "fine")
    ends = pin(_last_rows(inside, fine), "ends")
    limits = pin(
        targets.alias("t")
        .join(fine.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
        .join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.of")), "left")
        .select(
            F.col("t.source").alias("of"),
            "t.source_size",
            "t.target",
            "t.epochs",
            "t.budget",
            F.col("f.bucket").alias("end_place"),
            "e.last",
            "e.last_row",
        ),
        "limits",
    )
    here = F.struct("key", "doc_id", "size")
    picked = (
        F.when(F.col("budget") <= 0, F.lit(0))
        .when(F.col("end_place").isNull(), F.lit(1))
        .when(F.col("place") < F.col("end_place"), F.lit(1))
        .when(F.col("place") > F.col("end_place"), F.lit(0))
        .when(here < F.col("last"), F.lit(1))
        .when((here == F.col("last")) & (F.col("last_row").isNull() | (F.col("row") <= F.col("last_row"))), F.lit(1))
        .otherwise(F.lit(0))
    )
    return sized.join(limits, sized.source.eqNullSafe(limits.of)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("epochs") + picked)).cast("long").alias("taken"),
        sized.source.alias("source"),
    )


def _last_rows(inside: DataFrame, fine: DataFrame) -> DataFrame:
    """of, last, last_row: the last (key, doc_id, size) that the budget takes, per source.

    ``last_row`` is the number of the last row taken of those equal ones, null if all are.
    """
    edge = inside.alias("i").join(
        fine.alias("f"), F.col("i.of").eqNullSafe(F.col("f.source")) & (F.col("i.bucket") == F.col("f.bucket"))
    )
    order = ["key", "doc_id", "size"]
    groups = edge.groupBy("i.of", *(f"i.{c}" for c in order), "f.left").agg(F.count(F.lit(1)).alias("copies"))
    words = F.col("size") * F.col("copies")
    running = F.sum(words).over(
        Window.partitionBy("of").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    # A document over the end is taken if that comes nearer to the budget than stopping before it.
    fits = F.floor((F.col("left") - (F.col("running") - words)) / F.col("size") + 0.5)
    taken = (
        groups.withColumn("running", running)
        .where("size > 0")
        .withColumn("fits", F.least(fits, F.col("copies")))
        .where("fits > 0")
    )
    ends = taken.groupBy("of").agg(F.max(F.struct(*order, "fits", "copies")).alias("end"))
    ends = ends.select(F.col("of").alias("ends_of"), F.struct(*(F.col(f"end.{c}") for c in order)).alias("last"), "end.fits", "end.copies")
    some = inside.join(
        ends.where("fits < copies"),
        F.col("of").eqNullSafe(F.col("ends_of")) & F.struct(*order).eqNullSafe(F.col("last")),
    ).withColumn("of", F.coalesce(F.concat(F.lit("="), "of"), F.lit("")))
    placed = number_rows(some.select("of", "ends_of", "fits", "row"), ["of"], "row", "position")
    last = placed.where("position < fits").groupBy(F.col("ends_of").alias("some_of")).agg(F.max("row").alias("last_row"))
    return ends.join(last, F.col("ends_of").eqNullSafe(F.col("some_of")), "left").select(
        F.col("ends_of").alias("of"), "last", "last_row"
    )


def _sized(docs: DataFrame, document_weights: DataFrame | None, seed: int) -> DataFrame:
    """row, doc_id, source, size, key and the key's buckets; texts are read once and never shuffled."""
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(
        F.xxhash64(F.lit(seed), "doc_id")
    )
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    ).select("doc_id", "source", word_count(F.col("text")).alias("size"), drawn.alias("drawn"))
    weight = F.lit(1.0)
    if document_weights is not None:
        one = document_weights.groupBy(F.col("doc_id").cast("long").alias("weighed")).agg(
            F.max(F.col("weight").cast("double")).alias("weight")
        )
        sized = sized.join(one, F.col("doc_id") == F.col("weighed"), "left")
        weight = F.col("weight")
        usable = ~F.isnan(weight) & (weight > 0) & (weight < float("inf"))
        weight = F.when(weight.isNotNull() & usable, weight).otherwise(1.0)
    # 52 bits, never 0 or 1.
    uniform = (F.shiftrightunsigned("drawn", 12).cast("double") + 0.5) / float(1 << 52)
    # 1 - exp(-key) is uniform for weight 1 and keeps the order of keys.
    place = F.least((1 - F.exp(-F.col("key"))) * float(COARSE * FINE), F.lit(float(COARSE * FINE - 1)))
    return (
        sized.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", (-F.log(uniform) / weight).alias("key")
        )
        .withColumn("place", place.cast("long"))
        .withColumn("coarse", F.expr(f"place div {FINE}"))
    )


def _ends(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, bucket, left: the bucket of (of, bucket, size) in which the budget ends.

    ``left`` is the budget that remains for that bucket. A budget that reaches past all buckets
    has no row.
    """
    sums = rows.groupBy("of", "bucket").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(
        Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    )
    sums = sums.withColumn("upto", running)
    ended = sums.join(
        budgets, sums.of.eqNullSafe(budgets.source) & (sums.upto > budgets.budget)
    )
    first = ended.groupBy("source").agg(
        F.min(F.struct("bucket", (F.col("budget") - (F.col("upto") - F.col("size"))).alias("left"))).alias("first")
    )
    return first.select("source", F.col("first.bucket").alias("bucket"), F.col("first.left").alias("left"))
