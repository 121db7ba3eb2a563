"""Least squares of many groups at once from mergeable moments.

A group's normal equations need only sums. Rows are summed by (group, levels of the dummies): counts,
sums and products of the regressors and of the response, as plain aggregates with partial sums on
the map side. Weekday and month give at most 84 such cells a group, from which one small task per
group builds and solves the equations. The rows of a group never meet, so a group may hold any share
of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directions of the scaled equations below this share of the largest do not count.
TOLERANCE = 1e-10


def standardised(rows: DataFrame, key: str, names: Sequence[str], response: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows, with ``_z0`` .. in place of the regressors.

    Each is centred and scaled within its group (0 where it never varies), which keeps the equations
    well conditioned. ``_y`` is the centred response, ``_mean`` its mean, ``_varies`` whether it does.
    """
    stats = [F.count(F.lit(1)).alias("_n"), F.avg(response).alias("_mean")]
    stats.append((F.max(response) > F.min(response)).alias("_varies"))
    for i, name in enumerate(names):
        spread = F.when(F.max(name) > F.min(name), F.stddev_pop(name))
        stats += [F.avg(name).alias(f"_m{i}"), spread.alias(f"_s{i}")]
    groups = rows.groupBy(key).agg(*stats).filter(F.col("_n") >= least)
    scaled = [
        F.coalesce((F.col(name) - F.col(f"_m{i}")) / F.col(f"_s{i}"), F.lit(0.0)).alias(f"_z{i}")
        for i, name in enumerate(names)
    ]
    return rows.join(groups, key).select(
        *rows.columns, *scaled, (F.col(response) - F.col("_mean")).alias("_y"), "_mean", "_varies"
    )


def _solver(key: str, size: int, dummies: Sequence[str]):
    pairs = list(combinations_with_replacement(range(size), 2))

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        levels = [np.unique(cells[d].to_numpy()) for d in dummies]
        fixed = [np.ones(len(cells))]
        for name, found in zip(dummies, levels):
            fixed += [(cells[name].to_numpy() == level).astype(float) for level in found[1:]]
        fixed = np.column_stack(fixed)
        q = fixed.shape[1]
        n = cells["n"].to_numpy(float)
        sums, products, cross = (np.stack(cells[c].to_numpy()) for c in ("sums", "products", "cross"))
        gram = np.zeros((q + size, q + size))
        gram[:q, :q] = (fixed * n[:, None]).T @ fixed
        gram[:q, q:] = fixed.T @ sums
        gram[q:, :q] = gram[:q, q:].T
        for (i, j), total in zip(pairs, products.sum(axis=0)):
            gram[q + i, q + j] = gram[q + j, q + i] = total
        right = np.concatenate([fixed.T @ cells["y"].to_numpy(float), cross.sum(axis=0)])
        size_of = np.sqrt(np.diag(gram))
        scale = np.divide(1.0, size_of, out=np.zeros_like(size_of), where=size_of > 0)
        values, vectors = np.linalg.eigh(gram * np.outer(scale, scale))
        kept = values > TOLERANCE * values.max()
        inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
        beta = scale * (inverse @ (scale * right))
        total, square = float(cells["y"].sum()), float(cells["yy"].sum())
        effects, at = {}, 1
        for name, found in zip(dummies, levels):
            own = [0.0, *beta[at : at + len(found) - 1]]
            effects[f"effect_{name}"] = [dict(zip((int(x) for x in found), own))]
            at += len(found) - 1
        return pd.DataFrame(
            {
                key: [cells[key].iloc[0]],
                "n_rows": [int(n.sum())],
                "n_params": [q + size],
                "n_rank": [int(kept.sum())],
                "unexplained": [square - float(beta @ right)],
                "spread": [square - total * total / n.sum()],
                "constant": [beta[0]],
                "slopes": [beta[q:].tolist()],
                **effects,
            }
        )

    return solve


def fit_groups(rows: DataFrame, key: str, size: int, dummies: Sequence[str], response: Column) -> DataFrame:
    """One row per group: coefficients of a constant, ``_z0`` .. and the dummies, and sums of squares.

    A dummy has one column for each of its levels in the group but the lowest. ``n_rank`` counts the
    columns that others do not determine; of equal fits the coefficients are the shortest.
    """
    z = [F.col(f"_z{i}") for i in range(size)]
    array = lambda columns: F.array(*[F.sum(c) for c in columns])
    cells = rows.groupBy(key, *dummies).agg(
        F.count(F.lit(1)).alias("n"),
        array(z).alias("sums"),
        array(z[i] * z[j] for i, j in combinations_with_replacement(range(size), 2)).alias("products"),
        array(x * response for x in z).alias("cross"),
        F.sum(response).alias("y"),
        F.sum(response * response).alias("yy"),
    )
    kind = rows.schema[key].dataType.simpleString()
    effects = "".join(f", effect_{d} map<int,double>" for d in dummies)
    schema = (
        f"{key} {kind}, n_rows long, n_params int, n_rank int, unexplained double, spread double, "
        f"constant double, slopes array<double>{effects}"
    )
    return cells.groupBy(key).applyInPandas(_solver(key, size, dummies), schema)


def predicted(size: int, dummies: Sequence[str]) -> Column:
    """Fitted centred response of a row joined to its group's coefficients."""
    out = F.col("constant")
    for i in range(size):
        out = out + F.col("slopes")[i] * F.col(f"_z{i}")
    for d in dummies:
        out = out + F.element_at(f"effect_{d}", F.col(d))
    return out
