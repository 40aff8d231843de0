"""Operator 4: hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TIERS = (1024, 512, 256)
END = 0
_CACHED = 1 << 19
#: A space that white space or the end follows: elsewhere a space begins a token of its own.
_LOOSE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")


class CachedTokenizer:
    """The ids of a byte-level BPE file, word by word.

    Its pattern begins a new token at every space before other than white space, so the ids of a text
    are those of its parts cut there, one after the other.  Parts are kept, up to a number that
    bounds memory only; new ones are encoded together, and a marked space shows where each begins.

    A text that spells an added token of the file (such as ``<|endoftext|>``) is encoded whole, so that it
    has the ids of a plain call, that token's among them; with ``spelled`` such a token has the ids of its letters.
    """

    def __init__(self, path: str, spelled: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelled
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (spelled and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("Ġ")
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w and " " not in w]
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = self._ids(["".join(" " + w for w in part)])[0]
            starts = np.flatnonzero(self.opens[ids])
            data = ids.tobytes()
            cuts = [*(4 * starts).tolist(), len(data)]
            self.known.update((w, data[a:b]) for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True))
        rest = [w for w in new if not w or " " in w]
        self.known.update(zip(rest, (ids.tobytes() for ids in self._ids([" " + w for w in rest]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        whole = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if whole:
            found = dict(zip(whole, self._ids([texts[i] for i in whole])))
            others = iter(self.encode([t for i, t in enumerate(texts) if i not in found]))
            return [found[i].tobytes() if i in found else next(others) for i in range(len(texts))]
        parts = [_CUT.split(t) if _LOOSE.search(t) else t.split(" ") for t in texts]
        if len(self.known) > _CACHED:
            self.known.clear()
        self._learn(list(set().union(*(p[1:] for p in parts)).difference(self.known)))
        heads = self._ids([p[0] for p in parts])
        return [head.tobytes() + b"".join(map(self.known.__getitem__, p[1:])) for head, p in zip(heads, parts)]


@cache
def _tokenizer(path: str, spelled: bool) -> CachedTokenizer:
    return CachedTokenizer(path, spelled)


class Packer:
    """Packs documents that come one after the other; a piece is (document, first id, number of ids).

    A document gives whole windows of the longest tier; what is left is routed to the shortest tier
    that holds it.  Each tier is packed from its largest piece down: a window opens with it and its gap
    is filled with the largest pieces of shorter tiers that fit, then with the front of one that is cut
    to fit, so that every window is full.  What opens a window that cannot be filled waits for the next
    documents; ``finish`` cuts it into windows of powers of two.
    """

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (ids, document, first id)

    def _route(self, doc: int, first: int, n: int) -> None:
        if n:
            tier = min(t for t in self.tiers if t >= n)
            pool = self.waiting[tier]
            pool.insert(bisect_right(pool, (n, doc, first)), (n, doc, first))

    def add(self, doc: int, n: int) -> Iterator[list[tuple[int, int, int]]]:
        top = self.tiers[0]
        for first in range(0, n - top + 1, top):
            yield [(doc, first, top)]
        self._route(doc, n // top * top, n % top)

    def _take(self, tier: int, gap: int) -> tuple[int, int, int] | None:
        """A piece of at most ``gap`` ids from the shorter tiers, or from this one if they are empty."""
        pools = [self.waiting[t] for t in self.tiers if t < tier and self.waiting[t]] or [self.waiting[tier]]
        for pool in pools:
            at = bisect_left(pool, (gap + 1,)) - 1
            if at >= 0:
                n, doc, first = pool.pop(at)
                return doc, first, n
        if not pools[0]:
            return None
        n, doc, first = pools[0].pop()
        self._route(doc, first + gap, n - gap)
        return doc, first, gap

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows from what waits; what cannot fill one goes on waiting."""
        for tier in self.tiers:
            while self.waiting[tier]:
                n, doc, first = self.waiting[tier].pop()
                window, gap = [(doc, first, n)], tier - n
                while gap and (piece := self._take(tier, gap)):
                    window.append(piece)
                    gap -= piece[2]
                if gap:
                    for doc, first, n in window:
                        self._route(doc, first, n)
                    break
                yield window

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        """The rest in windows of falling powers of two, which need no padding."""
        pieces = [(doc, first, n) for t in self.tiers for n, doc, first in reversed(self.waiting[t])]
        self.waiting = {t: [] for t in self.tiers}
        left = sum(n for _, _, n in pieces)
        while left:
            size = min(1 << (left.bit_length() - 1), self.tiers[0])
            left -= size
            window = []
            while size:
                doc, first, n = pieces.pop(0)
                if n > size:
                    pieces.insert(0, (doc, first + size, n - size))
                    n = size
                window.append((doc, first, n))
                size -= n
            yield window


_SCHEMA = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step_id", pa.int64()),
]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str | None = None,
    spelled: bool = False,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = 1 << 20,
    step_tokens: int = 1 << 14,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id``.

    A document is its ids and one 0; null and empty texts are the 0 alone.  Every id lies in one piece.
    A special token that a text spells has its own id, as in a plain call, or with ``spelled`` the ids of
    its letters.  Texts of any length are encoded whole and held by one task with their ids.
    ``tiers`` are falling powers of two.  Sequences are full but for the last of each input split, which
    have falling powers of two, so nothing is padded.  ``step_id`` groups sequences of one ``tier`` (their
    length) to steps of ``step_tokens`` ids, so that steps cost the same.  Repeated rows are packed one by
    one; other columns are not read.  Each input split is packed for itself, in blocks of about
    ``block_tokens`` ids, without a shuffle: ``sequence_id`` and ``step_id`` count within a split, which
    gives the upper bits.  A lost task gives the same rows when it runs again.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _tokenizer(path, spelled), Packer(tiers)
        base = TaskContext.get().partitionId() << 33
        ids: dict[int, tuple[object, bytes]] = {}  # by number: id of the document and its ids, while pieces wait
        number = sequence = tokens = 0
        in_tier: dict[int, int] = {}
        steps: dict[int, int] = {}
        n_steps = 0
        out: list[tuple] = []

        def place(window: list[tuple[int, int, int]]) -> None:
            nonlocal sequence, n_steps
            tier, offset = sum(n for _, _, n in window), 0
            if in_tier.get(tier, 0) % max(1, step_tokens // tier) == 0:
                steps[tier], n_steps = n_steps, n_steps + 1
            in_tier[tier] = in_tier.get(tier, 0) + 1
            for doc, first, n in window:
                doc_id, data = ids[doc]
                crc = zlib.crc32(memoryview(data)[4 * first : 4 * (first + n)])
                out.append((doc_id, first, n, crc, len(data) // 4, base + sequence, offset, tier, base + steps[tier]))
                offset += n
            sequence += 1

        def drain() -> pa.RecordBatch:
            cols = [pa.array([r[0] for r in out], kind)]
            cols += [pa.array([r[i + 1] for r in out], t) for i, (_, t) in enumerate(_SCHEMA)]
            out.clear()
            waiting = {doc for pool in packer.waiting.values() for _, doc, _ in pool}
            for doc in [d for d in ids if d not in waiting]:
                del ids[doc]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *(n for n, _ in _SCHEMA)])

        end = np.array([END], "<u4").tobytes()
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, data in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    ids[number] = (doc_id, data + end)
                    for window in packer.add(number, len(data) // 4 + 1):
                        place(window)
                    number, tokens = number + 1, tokens + len(data) // 4 + 1
                if tokens >= block_tokens:
                    tokens = 0
                    for window in packer.windows():
                        place(window)
                    yield drain()
        if kind is not None:
            for window in packer.windows():
                place(window)
            for window in packer.finish():
                place(window)
            yield drain()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"`{n}` bigint" for n, _ in _SCHEMA)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_packing``: all documents in sequences of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
