"""Near-duplicate components by a multi-index Hamming join of b-bit MinHash signatures.

Method. A document's set holds its distinct shingles of ``SHINGLE`` words. Its signature has
``CHUNKS`` chunks of five 12-bit minima, so one chunk is one long. Two signatures whose distance
(number of differing minima) is at most ``RADIUS`` = 2 * CHUNKS - 1 agree, by the pigeonhole
principle, in at least four minima of some chunk. So each chunk is indexed under its five keys
that leave one minimum out, and every pair within the radius shares a key. At a similarity of 0.8
a minimum differs with probability 0.2, and a distance above 31 of 80 has a probability below 1e-4;
more similar pairs are safer still. Pairs within the radius are confirmed on full sets.

Scale. Documents with equal sets are one class with one signature. The pairs of a key are never
listed. First each key links its members to one pivot: a task links the members it holds to its own
pivot and passes on only that, so a hot key sends one entry a task. Members of a key that the
confirmed links leave in different components are then compared across components: they meet
only if their rarest fifth of shingles, which any two sets of similarity 0.8 must share a shingle
of, have one in common at positions that still allow the overlap, and if two bits of each minimum
allow the distance. A copy in a large group that has too
many shingles of its own thus meets nobody, and no link is lost. Texts are never shuffled: a bit map
of constant size selects the documents whose sets are built again.

Rules for odd rows. Null or word-less texts have an empty set, link with nothing and are their own
component. Rows that share a doc_id are one document. A row without doc_id takes no part: its
component is null and it is kept. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.lineage import pin
from shelfwise.llm.bitmap import bit_map, marked, place
from shelfwise.llm.components import components
from shelfwise.llm.words import mix, slices, span_hashes

SHINGLE = 2
SIMILARITY_PERCENT = 80
CHUNKS = 16
LANES = 5
RADIUS = 2 * CHUNKS - 1
COUNT_BITS, KEY_MAP_BITS = 18, 24
PIVOT_ORDERS = 4
CHUNK_COLUMNS = [f"c{i}" for i in range(CHUNKS)]
#: Lowest and second lowest bits of the first 64 minima: a short lower bound of the distance.
PLANES = ["low_bits", "next_bits"]
_LANE_BITS = 64 // LANES
_LANE = (1 << _LANE_BITS) - 1
_MULTIPLIERS = mix(np.arange(1, CHUNKS * LANES + 1, dtype=np.uint64), 11) | np.uint64(1)
SIGNATURE_SCHEMA = (
    "doc_id long, n_shingles long, set_low long, set_high long, "
    + ", ".join(f"{c} long" for c in [*CHUNK_COLUMNS, *PLANES])
)
SET_SCHEMA = "doc_id long, shingles binary"


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every text."""
    for part in slices(texts, lower=True):
        starts, ends, rows = part.word_spans()
        words = span_hashes(part.prefix_hashes(), starts, ends)
        bounds = np.searchsorted(rows, np.arange(part.rows + 1))
        # A shingle's hash follows from its words in order; rows with fewer words than a shingle
        # have their whole sequence as one.
        rolled = words.copy()
        for k in range(1, width):
            rolled[: len(words) - k] = mix(rolled[: len(words) - k], k) + words[k:]
        for row in range(part.rows):
            low, high = bounds[row], bounds[row + 1]
            if high - low >= width:
                yield part.first + row, np.unique(rolled[low : high - width + 1])
            elif high > low:
                whole = np.uint64(high - low)
                with np.errstate(over="ignore"):
                    for word in words[low:high]:
                        whole = mix(np.array([whole], dtype=np.uint64), 99)[0] + word
                yield part.first + row, np.array([whole], dtype=np.uint64)
            else:
                yield part.first + row, np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``CHUNKS`` longs of five 12-bit minima each, then the bit planes."""
    mixed = mix(shingles, 3)
    minima = np.full(len(_MULTIPLIERS), 2**64 - 1, dtype=np.uint64)
    for low in range(0, len(mixed), 4096):
        part = np.multiply.outer(mixed[low : low + 4096], _MULTIPLIERS)
        np.minimum(minima, part.min(axis=0), out=minima)
    # The minimum itself is small; its low bits are even only after mixing.
    lanes = mix(minima, 5) & np.uint64(_LANE)
    shifts = (np.arange(LANES) * _LANE_BITS).astype(np.uint64)
    chunks = (lanes.reshape(CHUNKS, LANES) << shifts).sum(axis=1, dtype=np.uint64)
    places = np.arange(64, dtype=np.uint64)
    planes = [((lanes[:64] >> np.uint64(bit) & np.uint64(1)) << places).sum(dtype=np.uint64) for bit in (0, 1)]
    return np.concatenate([chunks, np.array(planes, dtype=np.uint64)]).view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = np.zeros(n, dtype=np.int64)
            prints = np.zeros((n, 2), dtype=np.uint64)
            chunks = np.zeros((n, CHUNKS + len(PLANES)), dtype=np.int64)
            for row, found in shingle_sets(batch.column("text"), width):
                sizes[row] = len(found)
                if len(found):
                    prints[row] = mix(found, 21).sum(dtype=np.uint64), mix(found, 22).sum(dtype=np.uint64)
                    chunks[row] = signature(found)
            columns = [batch.column("doc_id"), pa.array(sizes)]
            columns += [pa.array(prints[:, i].view(np.int64)) for i in (0, 1)]
            columns += [pa.array(chunks[:, i].copy()) for i in range(chunks.shape[1])]
            names = ["doc_id", "n_shingles", "set_low", "set_high", *CHUNK_COLUMNS, *PLANES]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _sets(width: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            batch = batch.filter(pa.array(marked(known, batch.column("place").to_numpy())))
            ids = batch.column("doc_id").to_pylist()
            held: list[tuple[int, bytes]] = []
            size = 0
            for row, found in shingle_sets(batch.column("text"), width):
                held.append((ids[row], found.tobytes()))
                size += found.nbytes
                if size > 8 << 20:
                    yield _set_batch(held)
                    held, size = [], 0
            if held:
                yield _set_batch(held)

    return run


def _set_batch(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary())],
        ["doc_id", "shingles"],
    )


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left_set"), batch.column("right_set")
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                b = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                short, long = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                common = int((long[at] == short).sum())
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _far_lanes(left: str, right: str) -> Column:
    """Number of differing minima of two signatures."""
    terms = []
    for name in CHUNK_COLUMNS:
        x = F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}"))
        # The lowest bit of a lane gathers its twelve bits.
        for shift in (6, 3, 1, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        terms.append(F.bit_count(x.bitwiseAND(F.lit(sum(1 << (i * _LANE_BITS) for i in range(LANES))))))
    return reduce(Column.__add__, terms)


def _key_columns() -> list[Column]:
    """The keys of a signature: each chunk with one minimum left out."""
    keys = []
    for i, name in enumerate(CHUNK_COLUMNS):
        for j in range(LANES):
            mask = ~(_LANE << (j * _LANE_BITS)) & (2**64 - 1)
            mask = mask - 2**64 if mask >= 2**63 else mask
            keys.append(F.xxhash64(F.col(name).bitwiseAND(F.lit(mask)), F.lit(i * LANES + j)))
    return keys


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of all (value, keys) rows, sorted by key, then by a hash of both."""
    lists = batch.column("keys")
    keys = lists.flatten().to_numpy()
    values = np.repeat(batch.column("value").to_numpy(), len(keys) // max(1, batch.num_rows))
    return _by_key(keys, values)


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first value of a key is the least in one of ``PIVOT_ORDERS`` orders that the key picks.

    So all keys of a large group have few pivots between them, and its members few pairs, but one
    odd pivot does not decide alone.
    """
    orders = keys.view(np.uint64) % np.uint64(PIVOT_ORDERS)
    rank = mix(values.view(np.uint64) + orders * np.uint64(0x9E3779B97F4A7C15), 51)
    order = np.lexsort((values, rank, keys))
    return keys[order], values[order]


def _packed(buckets: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    bucket = (mix(keys.view(np.uint64), 52) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[p[0]]) for p in parts], pa.int32()),
            pa.array([keys[p].tobytes() for p in parts], pa.binary()),
            pa.array([values[p].tobytes() for p in parts], pa.binary()),
        ],
        ["bucket", "keys", "values"],
    )


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    join = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64)
    return _by_key(join("keys"), join("values"))


def _stars(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Links of each key's members to its first one."""
    opens = np.ones(len(keys), dtype=bool)
    opens[1:] = keys[1:] != keys[:-1]
    pivots = values[np.flatnonzero(opens)[np.cumsum(opens) - 1]] if len(keys) else values
    pairs = np.stack([np.minimum(values, pivots), np.maximum(values, pivots)], axis=1)
    pairs = np.unique(pairs[values != pivots], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _own_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _stars(*_entries(batch))


def _pass_on(buckets: int, distinct: bool):
    """Packed (key, value): the first value of each key, or all different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = _entries(batch)
            keep = np.ones(len(keys), dtype=bool)
            keep[1:] = keys[1:] != keys[:-1]
            if distinct:
                keep[1:] |= values[1:] != values[:-1]
            yield _packed(buckets, keys[keep], values[keep])

    return run


def _bucket_stars(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_stars(*_unpacked(table))])


def _apart(table: pa.Table) -> pa.Table:
    """Keys with different values."""
    keys, values = _unpacked(table)
    split = (keys[1:] == keys[:-1]) & (values[1:] != values[:-1])
    return pa.table({"key": pa.array(np.unique(keys[1:][split]))})


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and signatures allow a link."""
    a, b = classes.alias("x"), classes.alias("y")
    sizes = (F.col("x.n_shingles"), F.col("y.n_shingles"))
    return (
        pairs.join(a, F.col("a") == F.col("x.class_id"))
        .join(b, F.col("b") == F.col("y.class_id"))
        .where(100 * F.least(*sizes) >= percent * F.greatest(*sizes))
        .where(_far_lanes("x", "y") <= RADIUS)
        .select("a", "b")
        .distinct()
    )


def _open_keys(bits):
    """One row per class and key whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy()
            hit = np.flatnonzero(marked(known, keys % (1 << KEY_MAP_BITS)))
            owner = pa.array(hit // max(1, len(keys) // max(1, batch.num_rows)))
            columns = [batch.column(c).take(owner) for c in ("class_id", "value", *PLANES)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(keys[hit])], ["doc_id", "place", *PLANES, "key"]
            )

    return run


def _set_table(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles of the documents in ``wanted`` (doc_id).

    Texts are selected by a bit map whose size does not grow; where it lets others pass, the join of
    the sets with ``wanted`` removes them.
    """
    shared = bit_map(wanted, "doc_id")
    placed = docs.where("doc_id IS NOT NULL").withColumn("place", place(F.col("doc_id")))
    return placed.mapInArrow(_sets(width, shared), SET_SCHEMA).join(wanted, "doc_id", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that the full sets confirm."""
    both = pairs.join(sets.toDF("a", "left_set"), "a").join(sets.toDF("b", "right_set"), "b")
    return both.mapInArrow(_confirmed(percent), "a long, b long").distinct()


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for batch in batches:
        for value in batch.column("shingles"):
            np.add.at(counts, _slot(np.frombuffer(value.as_buffer(), dtype=np.uint64)), 1)
    parts = counts.reshape(16, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(16), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"]
    )


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), dtype=np.int64) for v in table.column("counts"))
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _prefixes(counts, percent: int):
    """The rarest shingles of each set, enough that sets of the similarity share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = counts.value
        for batch in batches:
            lists, sizes = [], []
            for value in batch.column("shingles"):
                found = np.frombuffer(value.as_buffer(), dtype=np.uint64)
                n = len(found)
                order = np.lexsort((found, rarity[_slot(found)]))
                lists.append(found[order[: n - -(-n * percent // 100) + 1]])
                sizes.append(n)
            if not lists:
                continue
            long = np.array([len(x) for x in lists])
            every = lambda x: pa.array(np.repeat(x, long))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(lists).view(np.int64)),
                    every(batch.column("doc_id").to_numpy()),
                    every(batch.column("place").to_numpy()),
                    every(np.array(sizes, dtype=np.int32)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in long])),
                    *(every(batch.column(c).to_numpy()) for c in PLANES),
                ],
                ["shingle", "doc_id", "place", "n", "at", *PLANES],
            )

    return run


def _across(open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different places whose rarest shingles allow the similarity."""
    parts = (
        open_sets.select("shingles").mapInArrow(_count, "part int, counts binary")
        .groupBy("part").applyInArrow(_add_counts, "part int, counts binary").toArrow().sort_by("part")
    )
    counts = np.frombuffer(b"".join(parts.column("counts").to_pylist()), dtype=np.int64)
    if not len(counts):
        counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    shared = open_sets.sparkSession.sparkContext.broadcast(counts)
    prefixes = pin(
        open_sets.mapInArrow(
            _prefixes(shared, percent),
            "shingle long, doc_id long, place long, n int, at int, low_bits long, next_bits long",
        ),
        "prefixes",
    )
    met = (
        prefixes.groupBy("shingle")
        .agg(F.min("place").alias("low"), F.max("place").alias("high"))
        .where("low < high")
        .select("shingle")
    )
    met = prefixes.join(met, "shingle", "left_semi")
    x, y = met.alias("x"), met.alias("y")
    # At the first common shingle all that can be common stands there or behind it.
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    differ = [F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}")) for p in PLANES]
    apart = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.doc_id") < F.col("y.doc_id"))
        & (F.col("x.place") != F.col("y.place"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n")))
        & (F.bit_count(differ[0].bitwiseOR(differ[1])) <= RADIUS)
    )
    return x.join(y, apart).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = SIMILARITY_PERCENT
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, class_id."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = pin(docs.mapInArrow(_signatures(width), SIGNATURE_SCHEMA), "signatures")
    by_set = ["set_low", "set_high", "n_shingles"]
    classes = (
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*by_set)
        .agg(F.min("doc_id").alias("class_id"), *(F.min(c).alias(c) for c in [*CHUNK_COLUMNS, *PLANES]))
    )
    classes = pin(classes, "classes")

    # Each key's members and its pivot: links of one task's members, then of the tasks' pivots.
    keyed = classes.select(F.col("class_id").alias("value"), F.array(*_key_columns()).alias("keys"))
    packed = "bucket int, keys binary, values binary"
    pivots = keyed.mapInArrow(_pass_on(buckets, False), packed)
    stars = (
        keyed.mapInArrow(_own_stars, "a long, b long")
        .unionByName(pivots.groupBy("bucket").applyInArrow(_bucket_stars, "a long, b long"))
        .distinct()
    )
    near = pin(_near(stars, classes, percent), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    links = pin(_links(near, pin(_set_table(docs, wanted, width), "sets"), percent), "links")
    first = components(links)

    # Members of a key that are still apart.
    placed = classes.join(first, classes.class_id == first.node, "left").select(
        "class_id", F.coalesce("component", "class_id").alias("value"), *CHUNK_COLUMNS, *PLANES
    )
    placed = pin(placed, "placed").select("class_id", "value", F.array(*_key_columns()).alias("keys"), *PLANES)
    apart = (
        placed.select("value", "keys").mapInArrow(_pass_on(buckets, True), packed)
        .groupBy("bucket").applyInArrow(_apart, "key long")
    )
    # Of all keys a task passes on those that a bit map of the open ones lets through.
    apart = pin(apart, "apart")
    hits = placed.mapInArrow(
        _open_keys(bit_map(apart, "key", KEY_MAP_BITS, hashed=True)),
        "doc_id long, place long, low_bits long, next_bits long, key long",
    )
    open_classes = (
        hits.join(apart, "key", "left_semi")
        .groupBy("doc_id")
        .agg(*(F.min(c).alias(c) for c in ("place", *PLANES)))
    )
    open_classes = pin(open_classes, "open")
    open_sets = _set_table(docs, open_classes.select("doc_id"), width).join(open_classes, "doc_id")
    open_sets = pin(open_sets, "open_sets")
    across = _across(open_sets, percent).join(near, ["a", "b"], "left_anti")
    across = pin(_near(across, classes, percent), "across")
    more = _links(across, open_sets.select("doc_id", "shingles"), percent)
    # A doc_id with different sets links their classes.
    changed = (
        rows.where("n_shingles > 0").groupBy("doc_id")
        .agg(F.min("set_low").alias("low"), F.max("set_low").alias("high"))
        .where("low < high")
        .select("doc_id")
    )
    several = rows.join(changed, "doc_id", "left_semi").join(classes, by_set).select(rows["doc_id"], "class_id")
    least = several.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    same = several.join(least, "doc_id").select("a", F.col("class_id").alias("b")).where("a <> b")
    final = components(pin(links.unionByName(more).unionByName(same), "links"))
    placed_classes = classes.join(final, classes.class_id == final.node, "left").select(
        *by_set, "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    placed_rows = rows.select("doc_id", *by_set).join(placed_classes, by_set, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("component_id", "doc_id")
    )
    return placed_rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )
