"""Exact top-k inner-product search: tiled matrix products, partial selection, tree merging.

Method. Candidates are packed into shards and queries into blocks, each a matrix in one binary
value. Every pair of a block and a shard is one tile: one matrix product and, per query, a partial
selection of its k best. The lists of a block are then merged in a tree, ``FAN_IN`` shards at a
time, until one list per query is left.

Scale. The work is queries times candidates, as asked; a tile's memory is bounded by ``BLOCK`` and
``SHARD``, and within a tile by ``QUERY_ROWS`` rows of scores. Both matrices of a tile travel to its
task, so what is shuffled is about (1 / BLOCK + 1 / SHARD) vectors for each score. The number of shards and blocks follows the table; rows are spread by a hash of
their number, so equal vectors and ids spread too. A tile task gets one block and one
shard; a merge gets at most FAN_IN * BLOCK * k rows. Nothing passes the driver but row counts.

Rules for odd rows. Vectors that are null, empty or hold null or non-finite components take no
part, nor do rows without id. Only vectors of equal length are compared. Every row is a candidate of
all queries but itself, so rows that repeat an id are candidates of each other, and each query row
has its own list. Equal scores go to the smaller id; a query with fewer candidates than k gets all of
them. Products are exact: float64 where every partial sum stays below 2**53, int64 below 2**63,
else Python integers, held to the range of a long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.lineage import pin

K = 20
SHARD = 8192
BLOCK = 4096
QUERY_ROWS = 256
FAN_IN = 8
SCALE = 64
PACKED = "length int, part int, ids binary, rows binary, grid binary"
SCORES = "length int, block int, node int, query_row long, query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def _usable(vector: Column) -> Column:
    """Null where the vector holds null or non-finite components or has none."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, vector)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["vec_id", "row"])
    grid = np.stack(group["vector"].to_numpy()).astype(np.float64)
    first = group.iloc[0]
    return pd.DataFrame(
        {
            "length": [first["length"]],
            "part": [first["part"]],
            "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
            "rows": [group["row"].to_numpy(np.int64).tobytes()],
            "grid": [_narrow(grid).tobytes()],
        }
    )


def _narrow(grid: np.ndarray) -> np.ndarray:
    """The same whole numbers in two bytes where they fit; the width is read off the length."""
    return grid.astype(np.int16) if len(grid) and np.abs(grid).max() < 32768 else grid


def _matrix(ids: bytes, rows: bytes, grid: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, dtype=np.int64)
    kind = np.int16 if len(grid) == 2 * len(keys) * length else np.float64
    vectors = np.frombuffer(grid, dtype=kind).reshape(len(keys), length).astype(np.float64)
    return keys, np.frombuffer(rows, dtype=np.int64), vectors


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products of whole numbers held as doubles."""
    bound = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    if bound < 2.0**53:
        return (queries @ candidates.T).astype(np.int64)
    if bound < 2.0**62:
        return queries.astype(np.int64) @ candidates.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(candidates).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest allowed scores, ties to the smaller position, best first."""
    at = np.flatnonzero(allowed)
    values = scores[at]
    if len(at) > k:
        # The k-th highest score splits the row; of its ties the first ones fill up.
        edge = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > edge)
        level = np.flatnonzero(values == edge)[: k - len(above)]
        keep = np.concatenate([above, level])
        at, values = at[keep], values[keep]
    return at[np.lexsort((at, ~values))]


def _tile(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tile in batch.itertuples():
                query_ids, query_rows, queries = _matrix(tile.query_ids, tile.query_rows, tile.query_grid, tile.length)
                ids, rows, candidates = _matrix(tile.ids, tile.rows, tile.grid, tile.length)
                for low in range(0, len(queries), QUERY_ROWS):
                    scores = scores_of(queries[low : low + QUERY_ROWS], candidates)
                    out = []
                    for line, query, row in zip(scores, query_ids[low:], query_rows[low:]):
                        at = best(line, rows != row, k)
                        out.append((np.full(len(at), row), np.full(len(at), query), ids[at], line[at]))
                    r, q, v, s = (np.concatenate(x) for x in zip(*out))
                    yield pd.DataFrame(
                        {
                            "length": np.full(len(q), tile.length, dtype=np.int32),
                            "block": np.full(len(q), tile.block, dtype=np.int32),
                            "node": np.full(len(q), tile.part // FAN_IN, dtype=np.int32),
                            "query_row": r,
                            "query_id": q,
                            "vec_id": v,
                            "score": s,
                        }
                    )

    return run


def _merge(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["vec_id"], ~group["score"].to_numpy(), group["query_row"]))
        group = group.iloc[order]
        group = group[group.groupby("query_row").cumcount() < k]
        return group.assign(node=group["node"] // FAN_IN)

    return run


def _packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Matrices of about ``size`` rows, and their number."""
    parts = max(1, -(-rows.count() // size))
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    packed = rows.withColumn("part", part).groupBy("length", "part").applyInPandas(_pack, PACKED)
    return packed, parts


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of (vec_id, embedding) per query."""
    whole = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        quantised(_usable(F.col("embedding").cast("array<double>")), scale).alias("vector"),
    ).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    # Written once, so a row keeps its number.
    whole = pin(whole.withColumn("length", F.size("vector")), "vectors")
    candidates, parts = _packed(whole, SHARD)
    queries, blocks = _packed(whole.where(is_query), BLOCK)
    queries = queries.select(
        "length",
        F.col("part").alias("block"),
        F.col("ids").alias("query_ids"),
        F.col("rows").alias("query_rows"),
        F.col("grid").alias("query_grid"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    # Every block meets every shard of its length; the pairs are spread over all tasks.
    tiles = queries.join(candidates, ["length", "part"]).repartition(
        min(parts * blocks, 4096), "length", "part", "block"
    )
    lists = tiles.mapInPandas(_tile(k), SCORES)
    nodes = -(-parts // FAN_IN)
    while True:
        lists = lists.groupBy("length", "block", "node").applyInPandas(_merge(k), SCORES)
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
    ranked = lists.groupBy("length", "block").applyInPandas(
        _ranked, "query_id long, rank int, vec_id long, score long"
    )
    return ranked


def _ranked(group: pd.DataFrame) -> pd.DataFrame:
    order = np.lexsort((group["vec_id"], ~group["score"].to_numpy(), group["query_row"]))
    group = group.iloc[order]
    rank = (group.groupby("query_row").cumcount() + 1).astype("int32")
    return group.assign(rank=rank)[["query_id", "rank", "vec_id", "score"]]
