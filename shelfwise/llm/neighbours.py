"""Approximate nearest neighbours by inner product over learned partitions.

Method. On a sample of the vectors the graph of nearest neighbours is cut into balanced parts: vertices
join, in breadth-first order, the part that holds most of their neighbours and has room, and then
move while that keeps more edges inside parts. A linear classifier of the parts places every row of
the table. A second small classifier learns, for a sampled vector as a query, the shares of its
neighbours in the placed parts; queries go to their most probable parts, where all rows are scored.
The number of parts to probe is the least that finds ``RECALL`` of the neighbours of sampled vectors
held out of the fit; neighbours in the whole table are nearer than in the sample, so that errs to more.

Bounds. The fit reads at most ``SAMPLE`` different vectors, those of least hash, in one task, and its
model has at most ``PARTS`` parts: about 100 KB, the only thing sent to all tasks. Every row is indexed.

Scale. A part is a grid of tiles: rows are dealt to shards of about ``SHARD`` rows and queries to blocks
of about ``BLOCK`` by a hash of the row, so a part that holds a third of all rows, or many copies of
one vector, is many tasks. A tile is one cogroup of bounded size; each gives the k best rows of its queries,
and the k best of all tiles are a ranked window that Spark limits before its exchange.

Rules for odd rows. Vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without id. Only vectors of equal length are compared; the model is fitted on the
commonest length, other lengths are searched in full. Every row is a candidate of all queries but itself, so rows
that repeat an id or a vector are candidates of each other, and each query row has its own list.
Scores are sums of double products; ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.lineage import pin

K = 20
SAMPLE, HELD_SHARE, PARTS, LEAST_PER_PART = 8192, 8, 64, 64
DEGREE, SLACK, SWEEPS = 16, 1.05, 8
HIDDEN, EPOCHS, RATE, BATCH, DECAY = 128, 30, 3e-3, 128, 1e-4
RECALL = 0.95
SHARD, BLOCK, QUERY_ROWS, PAIR_ROWS = 4096, 4096, 64, 1 << 15
ROWS = "row long, vec_id long, is_query boolean, length int, vector binary"
PLACED = ROWS + ", part int"
TILE = ["length", "part", "shard", "block"]
LISTS = "query_row long, query_id long, row long, vec_id long, score double"


def _usable(vector: Column) -> Column:
    """Null where a vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite & F.exists(vector, lambda x: x != 0), vector)


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components as bytes."""
    for batch in batches:
        lists = batch.column("vector")
        values = lists.flatten()
        width = values.type.bit_width // 8
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths * width)]).astype(np.int32)
        data = np.ascontiguousarray(values.to_numpy(zero_copy_only=False))
        vectors = pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8))]
        )
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], vectors], [f.split()[0] for f in ROWS.split(", ")])


def _matrix(vectors: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Rows of equal length as doubles."""
    data = b"".join(vectors.to_pylist())
    kind = np.float32 if len(data) == 4 * len(vectors) * length else np.float64
    return np.frombuffer(data, dtype=kind).reshape(len(vectors), length).astype(np.float64)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
    """Positions of the k rows of largest product for each query, without row ``skip`` of each."""
    out = []
    for low in range(0, len(queries), 512):
        scores = queries[low : low + 512] @ rows.T
        own = skip[low : low + 512]
        scores[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        out.append(np.argpartition(-scores, min(k, len(rows) - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each vertex; ``graph`` lists the neighbours of every vertex.

    No part has more than ``SLACK`` times its share.
    """
    n = len(graph)
    ends = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    others = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    order = np.argsort(ends, kind="stable")
    others, bounds = others[order], np.searchsorted(ends[order], np.arange(n + 1))
    around = [others[bounds[v] : bounds[v + 1]] for v in range(n)]
    room = int(np.ceil(SLACK * n / parts))
    label, sizes = np.full(n, -1), np.zeros(parts, dtype=np.int64)
    seen = np.zeros(n, dtype=bool)
    for start in rng.permutation(n):
        queue = [] if seen[start] else [start]
        seen[start] = True
        for v in queue:
            held = label[around[v]]
            inside = np.bincount(held[held >= 0], minlength=parts)
            free = 1.0 - sizes / room
            label[v] = np.argmax((inside + 1e-6) * free)
            sizes[label[v]] += 1
            fresh = np.unique(around[v][~seen[around[v]]])
            seen[fresh] = True
            queue.extend(fresh.tolist())
    for _ in range(SWEEPS):
        moved = 0
        for v in rng.permutation(n):
            inside = np.bincount(label[around[v]], minlength=parts)
            inside[sizes >= room] = -1
            best = int(np.argmax(inside))
            if inside[best] > np.count_nonzero(label[around[v]] == label[v]):
                sizes[label[v]] -= 1
                sizes[best] += 1
                label[v] = best
                moved += 1
        if not moved:
            break
    return label


class Classifier:
    """Softmax over one optional hidden layer, fitted to shares of parts."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, shares: np.ndarray, hidden: int, rng: np.random.Generator) -> Classifier:
        sizes = [x.shape[1], hidden, shares.shape[1]] if hidden else [x.shape[1], shares.shape[1]]
        weights: list[np.ndarray] = []
        for a, b in zip(sizes, sizes[1:]):
            weights += [rng.normal(0, np.sqrt(1 / a), (a, b)), np.zeros(b)]
        model, first, second, step = cls(weights), [0.0] * len(weights), [0.0] * len(weights), 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for low in range(0, len(x), BATCH):
                at = order[low : low + BATCH]
                step += 1
                for i, slope in enumerate(model._slopes(x[at], shares[at])):
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope**2
                    move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                    weights[i] -= rate * (move + DECAY * weights[i])
        return model

    def _slopes(self, x: np.ndarray, shares: np.ndarray) -> list[np.ndarray]:
        w = self.weights
        inner = np.maximum(x @ w[0] + w[1], 0) if len(w) == 4 else x
        error = (_softmax(inner @ w[-2] + w[-1]) - shares) / len(x)
        slopes = [inner.T @ error, error.sum(axis=0)]
        if len(w) == 4:
            back = (error @ w[2].T) * (inner > 0)
            slopes = [x.T @ back, back.sum(axis=0), *slopes]
        return slopes

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return (np.maximum(x @ w[0] + w[1], 0) if len(w) == 4 else x) @ w[-2] + w[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class Model:
    """Places rows and routes queries; without classifiers all rows are in part 0."""

    def __init__(self, length: int, scale: float, probes: int, place: Classifier | None, route: Classifier | None):
        self.length, self.scale, self.probes, self.place, self.route = length, scale, probes, place, route

    def parts(self, x: np.ndarray) -> np.ndarray:
        if self.place is None:
            return np.zeros(len(x), dtype=np.int32)
        return self.place.logits(x * self.scale).argmax(axis=1).astype(np.int32)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Parts to search, one row a query."""
        if self.route is None:
            return np.zeros((len(x), 1), dtype=np.int32)
        return np.argsort(-self.route.logits(x * self.scale), axis=1, kind="stable")[:, : self.probes].astype(np.int32)


def _shares(parts: np.ndarray, near: np.ndarray, n_parts: int) -> np.ndarray:
    """Of each row of ``near``, the share of its entries in every part."""
    out = np.zeros((len(near), n_parts))
    np.add.at(out, (np.repeat(np.arange(len(near)), near.shape[1]), parts[near].ravel()), 1 / near.shape[1])
    return out


def fit_model(sample: np.ndarray, n_parts: int, k: int, target: float) -> Model:
    """Model of a sample of vectors in rows, and the probes that find ``target`` of held-out neighbours."""
    length = sample.shape[1]
    norm = float(np.linalg.norm(sample, axis=1).mean()) if len(sample) else 1.0
    scale = np.sqrt(length) / norm if np.isfinite(norm) and norm > 0 else 1.0
    held, known = sample[: len(sample) // HELD_SHARE], sample[len(sample) // HELD_SHARE :]
    if n_parts < 2 or len(held) < 2 or len(known) <= max(DEGREE, k):
        return Model(length, scale, 1, None, None)
    rng = np.random.default_rng(17)
    near = nearest(known, known, max(DEGREE, k), np.arange(len(known)))
    scores = np.einsum("ij,ikj->ik", known, known[near]) if len(known) * near.shape[1] * length < 1 << 22 else None
    graph = near[:, :DEGREE] if scores is None else np.take_along_axis(near, np.argsort(-scores, axis=1), 1)[:, :DEGREE]
    labels = balanced_parts(graph, n_parts, rng)
    place = Classifier.fit(known * scale, np.eye(n_parts)[labels], 0, rng)
    model = Model(length, scale, n_parts, place, None)
    placed = model.parts(known)
    model.route = Classifier.fit(known * scale, _shares(placed, near, n_parts), HIDDEN, rng)
    wanted = placed[nearest(held, known, k, np.full(len(held), -1))]
    order = np.argsort(-model.route.logits(held * scale), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    at = np.sort(np.take_along_axis(rank, wanted, 1).ravel())
    # The probes that reach the share of all held-out neighbours.
    model.probes = int(at[int(np.ceil(target * len(at))) - 1]) + 1
    return model


def _fit(length: int, n_parts: int, k: int, target: float):
    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("hash")
        model = fit_model(_matrix(sample.column("vector"), length), n_parts, k, target)
        weights = [*(model.place.weights if model.place else []), *(model.route.weights if model.route else [])]
        return pa.table(
            {
                "scale": [model.scale],
                "probes": pa.array([model.probes], pa.int32()),
                "weights": pa.array([[w.astype(np.float64).tobytes() for w in weights]], pa.list_(pa.binary())),
            }
        )

    return run


def _model_of(rows: DataFrame, length: int, n: int, k: int, target: float) -> Model:
    """Fitted on different vectors of least hash, at most ``SAMPLE`` of them."""
    n_parts = min(PARTS, n // LEAST_PER_PART)
    # Four times the share that would do if all vectors were different.
    least = min(1.0, 4 * SAMPLE / max(n, 1))
    drawn = F.pmod("hash", F.lit(1 << 30)) < int(least * (1 << 30))
    some = rows.where(F.col("length") == length).select("vector", F.xxhash64("vector").alias("hash")).where(drawn)
    sample = some.dropDuplicates(["hash"]).orderBy(F.pmod("hash", F.lit(1 << 30)), "hash").limit(SAMPLE)
    schema = "scale double, probes int, weights array<binary>"
    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(_fit(length, n_parts, k, target), schema).collect()
    if not found or not found[0].weights:
        return Model(length, 1.0, 1, None, None)
    w = [np.frombuffer(bytes(x), dtype=np.float64) for x in found[0].weights]
    shaped = [x.reshape(-1, len(b)) if i % 2 == 0 else x for i, (x, b) in enumerate(zip(w, [w[1], w[1], w[3], w[3], w[5], w[5]]))]
    return Model(length, found[0].scale, found[0].probes, Classifier(shaped[:2]), Classifier(shaped[2:]))


def _by_model(shared, each):
    """Run ``each(model, matrix)`` on the rows of the model's length; it gives rows and their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            for fits in (True, False):
                some = batch.filter(pa.array((length == model.length) == fits))
                if not some.num_rows:
                    continue
                parts = np.full((some.num_rows, 1), -1, dtype=np.int32)
                if fits:
                    parts = each(model, _matrix(some.column("vector"), model.length))
                owner = pa.array(np.repeat(np.arange(some.num_rows), parts.shape[1]))
                columns = [column.take(owner) for column in some.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts.ravel())], [*some.schema.names, "part"])

    return run


def _best_rows(queries, query_rows, rows, row_keys, ids, k):
    """query position, row position and score of each query's k best rows."""
    found = []
    spread = np.linalg.norm(queries, axis=1) * (np.linalg.norm(rows, axis=1).max() if len(rows) else 0.0)
    for low in range(0, len(queries), QUERY_ROWS):
        part = slice(low, low + QUERY_ROWS)
        rough = queries[part] @ rows.T
        own = query_rows[part, None] == row_keys[None, :]
        rough[own] = -np.inf
        # The product of matrices rounds in its own way: what comes near the k-th score is summed again.
        edge = np.full(len(rough), -np.inf)
        if len(rows) > k:
            edge = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k]
        near = ~(rough < (edge - 1e-12 * spread[part])[:, None]) & ~own
        q, c = np.nonzero(near)
        scores = np.empty(len(q))
        for i in range(0, len(q), PAIR_ROWS):
            at = slice(i, i + PAIR_ROWS)
            scores[at] = (queries[low + q[at]] * rows[c[at]]).sum(axis=1)
        order = np.lexsort((row_keys[c], ids[c], -scores, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], np.arange(len(rough)))[q[order]]
        keep = order[place < k]
        found.append((low + q[keep], c[keep], scores[keep]))
    return [np.concatenate(x) for x in zip(*found)]


def _tile(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        empty = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        schema = pa.schema([(n, pa.float64() if n == "score" else pa.int64()) for n in empty])
        if not rows.num_rows or not queries.num_rows:
            return pa.table(empty, schema=schema)
        length = key[0].as_py()
        row_keys, ids = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()
        query_rows, query_ids = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            q, c, scores = _best_rows(
                _matrix(queries.column("vector"), length), query_rows, _matrix(rows.column("vector"), length), row_keys, ids, k
            )
        columns = [query_rows[q], query_ids[q], row_keys[c], ids[c], scores]
        return pa.Table.from_arrays([pa.array(x) for x in columns], schema=schema)

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = K, target: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows of (vec_id, embedding) found."""
    kind = vectors.schema["embedding"].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vector = F.col("embedding").cast("array<float>" if narrow else "array<double>")
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.size(vector).alias("length"),
        _usable(vector).alias("vector"),
    ).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    # Written once, so a row keeps its number.
    rows = pin(rows.mapInArrow(_bytes, ROWS), "vectors")
    common = rows.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    length, n = (common[0]["length"], common[0]["count"]) if common else (0, 0)
    shared = rows.sparkSession.sparkContext.broadcast(_model_of(rows, length, n, k, target))
    placed = rows.mapInArrow(_by_model(shared, lambda model, x: model.parts(x)[:, None]), PLACED)
    routed = rows.where("is_query").mapInArrow(_by_model(shared, lambda model, x: model.probed(x)), PLACED)
    pick = ["length", "part"]
    sizes = placed.groupBy(*pick).agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    blocks = routed.groupBy(*pick).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    grid = pin(sizes.join(blocks, pick), "grid")
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    columns = ["row", "vec_id", "vector", *pick]
    left = placed.join(grid, pick).select(*columns, deal("shards").alias("shard"), every("blocks").alias("block"))
    right = routed.join(grid, pick).select(*columns, deal("blocks").alias("block"), every("shards").alias("shard"))
    lists = left.groupBy(*TILE).cogroup(right.groupBy(*TILE)).applyInArrow(_tile(k), LISTS)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        lists.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
