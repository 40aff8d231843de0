"""Vectors in Spark tables and small in-memory graphs over them, shared by operators 3 and 10."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of the rows whose vector is neither null nor zero and has finite components only.

    Vectors must have one length: those of another length than the most common one (of equally
    common ones the largest) take no part either.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec").isNotNull() & F.col("id").isNotNull()).filter(~odd & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()
    return rows.filter(F.size("vec") == F.lit(sizes["d"]))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sample(rows: DataFrame, total: int, size: int) -> np.ndarray:
    """About ``size`` of the ``total`` vectors, chosen by hashed id and in its order."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    limit = min(1.0, size / max(1, total)) * (1 << 30)
    taken = rows.select(place.alias("place"), "id", "vec").filter(F.col("place") <= limit).toArrow()
    order = np.lexsort((taken["id"].to_numpy(), taken["place"].to_numpy()))
    return matrix(taken["vec"].combine_chunks())[order] if taken.num_rows else np.zeros((0, 0))


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Means of ``k`` equally large parts of ``x``: each cut is at a quantile along the widest direction."""
    if k <= 1 or len(x) <= 1:
        return x.mean(axis=0, keepdims=True)
    centred = x - x.mean(axis=0)
    direction = centred[np.argmax((centred**2).sum(axis=1))]
    for _ in range(4):
        direction = centred.T @ (centred @ direction)
        direction /= max(np.linalg.norm(direction), 1e-300)
    order = np.argsort(centred @ direction, kind="stable")
    left = k // 2
    cut = max(1, min(len(x) - 1, len(x) * left // k))
    return np.concatenate([balanced_centroids(x[order[:cut]], left), balanced_centroids(x[order[cut:]], k - left)])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    out = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)


def robust_prune(dist: np.ndarray, degree: int, alpha: float, candidates: int) -> np.ndarray:
    """Neighbours of each row of the square ``dist``, -1 where there are fewer than ``degree``.

    From its ``candidates`` nearest a node takes the nearest one left and strikes those to which that one
    is closer, by the factor ``alpha``, than the node itself; all nodes go step by step together.
    """
    n = len(dist)
    own = dist.copy()
    np.fill_diagonal(own, np.inf)
    width = min(candidates, n - 1)
    if width <= 0:
        return np.full((n, 1), -1)
    near = np.argpartition(own, width - 1, axis=1)[:, :width]
    d = np.take_along_axis(own, near, axis=1)
    order = np.argsort(d, axis=1, kind="stable")
    near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
    alive, rows = np.ones(near.shape, bool), np.arange(n)
    out = np.full((n, degree), -1)
    for step in range(degree):
        at = alive.argmax(axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        chosen = near[rows, at]
        out[some, step] = chosen[some]
        # distances are squared, and so is the factor
        alive &= alpha * alpha * dist[chosen[:, None], near] > d
        alive[rows, at] = False
    return out


def beam_search(
    reach_of: Callable[[np.ndarray, np.ndarray], np.ndarray], nq: int, graph: np.ndarray, entry: int, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that a greedy search from ``entry`` finds for each query, nearest first, and their distances.

    ``reach_of(queries, nodes)`` gives the distances of each query to its row of nodes, ``graph[v]`` has the
    neighbours of a node; -1 stands for none.  All queries advance together: each expands its nearest
    node not yet expanded until it has none in its beam.
    """
    n, rows = len(graph), np.arange(nq)
    seen = np.zeros((nq, n + 1), bool)
    seen[:, entry] = seen[:, n] = True  # n stands for no neighbour
    found, done = np.full((nq, 1), entry), np.zeros((nq, 1), bool)
    reach = reach_of(rows, found)
    active = rows
    while len(active):
        nodes, reached, expanded = found[active], reach[active], done[active]
        at = np.where(expanded | (nodes < 0), np.inf, reached).argmin(axis=1)
        i = np.arange(len(active))
        open_ = ~expanded[i, at] & (nodes[i, at] >= 0)
        active, i, at = active[open_], i[open_], at[open_]
        if not len(active):
            break
        done[active, at] = True
        around = graph[nodes[i, at]]
        around = np.where(around < 0, n, around)
        new = ~seen[active[:, None], around]
        seen[active[:, None], around] = True
        around = np.where(new, around, -1)
        steps = np.where(new, reach_of(active, np.where(new, around, 0)), np.inf)
        width = min(beam, found.shape[1] + around.shape[1])
        grown = [np.full((nq, width), -1), np.full((nq, width), np.inf), np.zeros((nq, width), bool)]
        keep = min(width, found.shape[1])
        for new_, old in zip(grown, (found, reach, done)):
            new_[:, :keep] = old[:, :keep]
        all_nodes = np.concatenate([found[active], around], axis=1)
        all_reach = np.concatenate([reach[active], steps], axis=1)
        all_done = np.concatenate([done[active], np.zeros(around.shape, bool)], axis=1)
        order = np.argsort(all_reach, axis=1, kind="stable")[:, :width]
        for new_, old in zip(grown, (all_nodes, all_reach, all_done)):
            new_[active] = np.take_along_axis(old, order, axis=1)
        found, reach, done = grown
    found[~np.isfinite(reach)] = -1
    return found, reach
