"""What a task can settle about a graph among the edges it has at hand, before any round is shuffled.

As a map-side combine does for sums, each run of edges is replaced by less that says the same.  How much less depends on
which edges stand together; the result never does, as the rounds that follow settle the rest.  A run is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

#: Edges of a run.
_RUN = 1 << 20
#: Passes over a run for its strong components; what they leave is left to the rounds.
_PASSES = 16


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The node ids of a run, and both ends of its edges as places among these."""
    held: list[pa.RecordBatch] = []

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        ends = np.concatenate([table.column(i).to_numpy() for i in (0, 1)])
        ids, places = np.unique(ends, return_inverse=True)
        return ids, places[: table.num_rows], places[table.num_rows :]

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield run()
            held = []
    if held:
        yield run()


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _long(df: DataFrame) -> bool:
    return all(isinstance(f.dataType, LongType) for f in df.schema)


def forest(pairs: DataFrame, size: int = _RUN) -> DataFrame:
    """``pairs(high, low)`` without nulls, or fewer with the same components: each run as stars around its least ids."""
    if not _long(pairs):
        return pairs

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, a, b in _runs(batches, size):
            root = np.arange(len(ids))
            while len(a):
                ra, rb = root[a], root[b]
                apart = ra != rb
                a, b = a[apart], b[apart]
                np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
            below = root != np.arange(len(ids))
            yield _rows(["high", "low"], ids[below], ids[root[below]])

    return pairs.mapInArrow(stars, pairs.schema)


def on_cycles(arcs: DataFrame, size: int = _RUN) -> DataFrame | None:
    """``(src, dst)``: nodes of ``arcs(src, dst)`` without nulls that are found to lie on a cycle with ``dst``, another one.

    Each node takes the largest id that reaches it and the largest that it reaches, as in ``strong_components``.  An id that reaches a node and is reached by it within a run is in its strong component, whatever the passes leave out.
    None for ids that are not bigints.
    """
    if not _long(arcs):
        return None

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, src, dst in _runs(batches, size):
            found = np.arange(len(ids))
            for _ in range(_PASSES):
                above, below = np.arange(len(ids)), np.arange(len(ids))
                for _ in range(_PASSES):
                    before = above.copy(), below.copy()
                    np.maximum.at(above, dst, above[src])
                    np.maximum.at(below, src, below[dst])
                    if (above == before[0]).all() and (below == before[1]).all():
                        break
                same = above == below
                found = np.where(same & (above != np.arange(len(ids))), above, found)
                # a cycle has one pair of values
                open_ = (above[src] == above[dst]) & (below[src] == below[dst]) & ~same[src]
                src, dst = src[open_], dst[open_]
                if not len(src):
                    break
            inner = found != np.arange(len(ids))
            yield _rows(["src", "dst"], ids[inner], ids[found[inner]])

    return arcs.mapInArrow(pairs, arcs.schema)
