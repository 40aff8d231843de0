"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever the case: each is ``name`` plus underscores."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in order, cut at ASCII white space after about ``size`` bytes; no word is split."""
    begin = 0
    while len(data) - begin > size:
        cut = _SPACE.search(data, begin + size)
        if cut is None:
            break
        yield data[begin : cut.start()]
        begin = cut.start()
    yield data[begin:]


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, cut so that the texts of ``column`` have about ``size`` bytes in each; no text is split."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        limit = (ends[begin - 1] if begin else 0) + size
        stop = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (with the end of the last); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; a run ends where one of the texts begins."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[begins] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


def dictionary(data: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the runs of ``inside`` by their bytes, and the different ones."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    found = pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary
