"""Operator 5: language ID by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 6
CLASSES = 1 << BITS
#: The table for all languages has at most so many contexts times languages.
_CELLS = 1 << 18
UND = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Sparse:
    """Bits to add for a key, in each of the languages that have it: those of ``keys[i]`` from ``start[i]`` on."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(key: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Sparse:
        order = np.lexsort((lang, key))
        keys, start = np.unique(key[order], return_index=True)
        return Sparse(keys, np.r_[start, len(key)], lang[order].astype(np.int32), value[order].astype(np.float32))

    def add(self, total: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
        """Add the bits of ``key``, ``n`` times each, to ``total`` of the languages."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        at, n = at[hit], n[hit]
        size = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(at) else at
        total += np.bincount(self.lang[entry], np.repeat(n, size) * self.value[entry], len(total))


@dataclass(frozen=True)
class Model:
    """Frozen statistics: code lengths by context node, byte class and language.

    ``classes`` gives each byte its class, ``node`` each context of three classes the longest context
    that any language keeps (the last two classes if none has all three), ``cost`` the bits of the next
    class there, in each language by its own longest context.  ``deep`` has the contexts that found no
    place there: the bits to add for the context, and for context and class.  A byte of class 0 is followed by
    the byte itself: ``even`` bits if nothing is known, ``first`` after the byte before it, and ``bytes_``
    to add for the last two and three bytes, likewise.
    """

    langs: list[str]
    classes: np.ndarray
    node: np.ndarray
    cost: np.ndarray
    deep: tuple[Sparse, ...] = ()
    even: float = 0.0
    first: np.ndarray | None = None
    bytes_: tuple[tuple[Sparse, ...], ...] = ()

    def bits(self, data: bytes, size: int = 1 << 18) -> np.ndarray:
        """The code length of the whole text in each language."""
        total = np.zeros(len(self.langs))
        raw = np.frombuffer(b"\n\n\n" + data, np.uint8)
        for begin in range(0, len(data), size):
            c = self.classes[raw[begin : begin + size + 3]]
            context = (c[:-3] << (2 * BITS)) | (c[1:-2] << BITS) | c[2:-1]
            total += self.cost[(self.node[context] << BITS) | c[3:]].sum(axis=0, dtype=np.float64)
            if self.deep and len(self.deep[0].keys):
                _add(total, self.deep, *np.unique((context << BITS) | c[3:], return_counts=True), BITS, 3 * BITS)
            other = np.flatnonzero(c[3:] == 0)
            if len(other):
                b = _FOLD[raw[begin : begin + size + 3]]
                gram = (b[other] << 24) | (b[other + 1] << 16) | (b[other + 2] << 8) | b[other + 3]
                gram, n = np.unique(gram, return_counts=True)
                total += n @ self.first[gram & 0xFFFF]
                for width, level in zip((2, 3), self.bytes_):
                    _add(total, level, gram, n, 8, 8 * width)
        return total

    def even_bits(self, data: bytes) -> float:
        """The code length of the text if every class, and every byte of class 0, is as likely as another."""
        return BITS * len(data) + self.even * int((self.classes[np.frombuffer(data, np.uint8)] == 0).sum())

    def predict(self, data: bytes | None) -> tuple[str, float, float | None]:
        """Language, its share of the likelihood, bits a byte."""
        if not data or not self.langs or not has_letter(data):
            return UND, 0.0, None
        bits = self.bits(data)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(bits[best] - bits).sum()), float(bits[best] / len(data))


def has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER.search(data)) or any(c.isalpha() for c in data.decode("utf-8", "replace"))


def _folded() -> np.ndarray:
    """A-Z as a-z, digits as one."""
    out = np.arange(256)
    out[65:91] += 32
    out[48:58] = 48
    return out


_FOLD = _folded()


def _add(total: np.ndarray, level: tuple[Sparse, ...], gram: np.ndarray, n: np.ndarray, symbol: int, width: int) -> None:
    """Add a level's bits: the last ``symbol`` bits of a gram are its symbol, the ``width`` before these its context."""
    gram = gram & ((1 << (symbol + width)) - 1)
    level[0].add(total, gram >> symbol, n)
    level[1].add(total, gram, n)


def _level(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, shorter: np.ndarray, symbol: int, kinds: int, keep: np.ndarray) -> tuple[tuple[Sparse, ...], np.ndarray]:
    """One order more by method C with exclusion, and the bits of each gram with it.

    ``gram`` is seen ``n`` times in ``lang``, each pair once and sorted, and costs ``shorter`` bits by the next
    shorter context; contexts not in ``keep`` stay as they are.
    """
    context = gram >> symbol
    begin = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (context[1:] != context[:-1])]) if len(gram) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(gram)])
    total = np.add.reduceat(n, begin) if len(gram) else size
    left = np.maximum(1 - (np.add.reduceat(np.exp2(-shorter), begin) if len(gram) else size), 1e-12)
    escape = np.where(size < kinds, size, 0)
    # what an unseen kind costs more; there is none if all kinds were seen
    more = np.where(escape > 0, np.log2(left * (total + escape) / np.maximum(escape, 1)), 0)
    seen = np.log2(np.repeat(total + escape, size) / n)
    own = keep[begin] if len(gram) else np.zeros(0, bool)
    tables = Sparse.of(context[begin][own], lang[begin][own], more[own]), Sparse.of(gram[keep], lang[keep], (seen - shorter - np.repeat(more, size))[keep])
    return tables, np.where(keep, seen, shorter)


def _summed(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    both, at = np.unique(lang.astype(np.int64) << 32 | gram, return_inverse=True)
    return both >> 32, both & 0xFFFFFFFF, np.bincount(at, n, len(both))


def _frequent(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, symbol: int, most: int) -> np.ndarray:
    """Which grams have one of the ``most`` most frequent contexts of their language."""
    both, at = np.unique(lang << 32 | gram >> symbol, return_inverse=True)
    order = np.lexsort((both, -np.bincount(at, n, len(both)), both >> 32))
    of = both[order] >> 32
    rank = np.empty(len(both), np.int64)
    rank[order] = np.arange(len(both)) - np.searchsorted(of, of)
    return rank[at] < most


def build(langs: list[str], which: np.ndarray, grams: np.ndarray, counts: np.ndarray, max_contexts: int) -> Model:
    """The model from counts of four-byte strings: ``counts[i]`` of ``grams[i]`` in language ``which[i]``.

    The 63 most frequent folded bytes have classes of their own, the others share class 0, after which the
    byte itself is coded by the three bytes before it.  Each language keeps its ``max_contexts`` most
    frequent contexts of three classes, of two and of three bytes, and all shorter ones; how many languages
    there are only decides which contexts stand in the table for all languages and which in sparse ones.  Escapes follow method C, with exclusion: a context with n symbols of d kinds
    gives kind s, seen c times, c / (n + d), and shares d / (n + d) among the unseen kinds as the next
    shorter context does; below all stands the even code.
    """
    fold, n_langs = _FOLD, len(langs)
    seen = np.bincount(fold[grams & 255], counts, 256)
    order = [b for b in np.argsort(-seen, kind="stable") if seen[b] > 0][: CLASSES - 1]
    own = np.zeros(256, np.int64)
    own[order] = np.arange(1, len(order) + 1)
    classes = own[fold]
    code = np.zeros(len(grams), np.int64)
    for shift in (24, 16, 8, 0):
        code = (code << BITS) | classes[(grams >> shift) & 255]

    def table(width: int, keep: np.ndarray | None = None) -> np.ndarray:
        """Counts by language, context of ``width`` classes (those in ``keep``) and class."""
        context = (code >> BITS) & ((1 << (BITS * width)) - 1)
        size = 1 << (BITS * width) if keep is None else len(keep)
        mine, at = np.ones(len(code), bool), context
        if keep is not None:
            at = np.searchsorted(keep, context)
            mine = (at < size) & (np.r_[keep, -1][at] == context)
        flat = (which * size + at) * CLASSES + (code & (CLASSES - 1))
        return np.bincount(flat[mine], counts[mine], n_langs * size * CLASSES).reshape(n_langs, size, CLASSES)

    def extend(shorter: np.ndarray, c: np.ndarray) -> np.ndarray:
        n, d = c.sum(axis=2, keepdims=True), (c > 0).sum(axis=2, keepdims=True)
        rest = np.where(c > 0, 0, shorter)
        left = rest.sum(axis=2, keepdims=True)
        escape = np.where(left > 0, d, 0)
        seen_part = c / np.maximum(n + escape, 1)
        unseen = rest / np.where(left > 0, left, 1) * escape / np.maximum(n + escape, 1)
        return np.where(n > 0, np.where(c > 0, seen_part, unseen), shorter)

    p = extend(np.full((n_langs, 1, CLASSES), 1 / CLASSES), table(0))
    p = extend(np.repeat(p, CLASSES, axis=1), table(1))
    p = extend(np.tile(p, (1, CLASSES, 1)), table(2))
    lang, gram, n = _summed(which, code, counts)
    mine = _frequent(lang, gram, n, BITS, max_contexts)
    keep = np.unique(gram[mine] >> BITS)
    if len(keep) * n_langs > _CELLS:
        keep = np.unique(gram[_frequent(lang, gram, n, BITS, min(max_contexts, _CELLS // n_langs**2))] >> BITS)
    short = 1 << (2 * BITS)
    node = np.arange(1 << (3 * BITS), dtype=np.int64) & (short - 1)
    node[keep] = short + np.arange(len(keep))
    cost = [-np.log2(p).astype(np.float32)]
    for part in np.array_split(keep, len(keep) // 4096 + 1):
        cost.append(-np.log2(extend(p[:, part & (short - 1)], table(3, part))).astype(np.float32))
    rest = mine & ~np.isin(gram >> BITS, keep)
    lang, gram, n = lang[rest], gram[rest], n[rest]
    deep, _ = _level(lang, gram, n, -np.log2(p[lang, (gram >> BITS) & (short - 1), gram & (CLASSES - 1)]), BITS, CLASSES, np.ones(len(gram), bool))
    cost = np.ascontiguousarray(np.concatenate(cost, axis=1).reshape(n_langs, -1).T)

    others = np.flatnonzero((classes == 0) & (fold == np.arange(256)))
    spot = np.zeros(256, np.int64)
    spot[others] = np.arange(len(others))
    folded = sum(fold[(grams >> shift) & 255] << shift for shift in (24, 16, 8, 0))
    mine = classes[folded & 255] == 0
    lang, gram, n = _summed(which[mine], folded[mine], counts[mine])

    def pairs(context: np.ndarray | int, size: int) -> np.ndarray:
        return np.bincount((lang * size + context) * len(others) + spot[gram & 255], n, n_langs * size * len(others)).reshape(n_langs, size, -1)

    q = extend(np.full((n_langs, 1, len(others)), 1 / len(others)), pairs(0, 1))
    first = np.zeros((n_langs, 256, 256), np.float32)
    first[:, :, others] = -np.log2(extend(np.repeat(q, 256, axis=1), pairs((gram >> 8) & 255, 256)))
    first = first.reshape(n_langs, -1).T
    l2, g2, n2 = _summed(lang, gram & 0xFFFFFF, n)
    second, bits = _level(l2, g2, n2, first[g2 & 0xFFFF, l2].astype(np.float64), 8, len(others), _frequent(l2, g2, n2, 8, max_contexts))
    shorter = bits[np.searchsorted(l2 << 32 | g2, lang << 32 | gram & 0xFFFFFF)]
    third, _ = _level(lang, gram, n, shorter, 8, len(others), _frequent(lang, gram, n, 8, max_contexts))
    return Model(langs, classes, node.astype(np.int32), cost, deep, float(np.log2(len(others))), np.ascontiguousarray(first), (second, third))


def held_out(id_col: str) -> Column:
    """One document in five, by the CRC-32 of its id as text; a document without id is held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            raw = np.frombuffer(b"\n\n\n" + text.as_py(), np.uint8).astype(np.int64)
            grams, n = np.unique((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(n)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    sample_rows: int = 400,
    sample_bytes: int = 1 << 20,
    max_contexts: int = 16_384,
) -> Model:
    """Learn from the documents that are not held out and have a text and a language.

    The sample is bounded: about ``sample_rows`` whole texts of up to ``sample_bytes`` of each language,
    those whose hashed id is smallest.  The counts are summed by Spark; what reaches the driver is
    one row for each language, then the summed four-byte strings of the sample.  The model takes a table of up to
    64 MiB for all languages, and about 1 MB for each plus 12 bytes for each string it keeps besides.
    """
    usable = docs.filter(~held_out(id_col) & (F.octet_length(text_col).between(1, sample_bytes)) & F.col(lang_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    share = {r["lang"]: min(1.0, sample_rows / r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], np.zeros(256, np.int64), np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    limit = F.create_map(*[F.lit(x) for lang in langs for x in (lang, share[lang])])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.filter(place < limit[F.col("lang")]).select("lang", "text")
    counted = sample.mapInArrow(_gram_counts, "lang string, gram bigint, n bigint")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    which = np.searchsorted(langs, got["lang"].to_numpy()).astype(np.int64) if langs else np.zeros(0, np.int64)
    order = np.lexsort((got["gram"].to_numpy(), which))
    return build(langs, which[order], got["gram"].to_numpy()[order], got["n"].to_numpy()[order], max_contexts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as ``(doc_id, held_out, lang_pred, score, bits_per_byte)``, one row for each of its rows.

    The prediction is the language in which the whole text has the shortest code.  ``score`` is
    2^-bits of it over the sum of all languages' (0 to 1).  Null texts, texts without a letter and
    all texts if nothing was learned are ``und`` with score 0 and null bits.  Ties go to the language
    first by code point.  Only id and text are read; id takes part in ``held_out`` alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", *, margin: float = 64.0) -> DataFrame:
    """``docs`` without the rows whose text is in no language: ``und``, or shorter in the even code than in any
    language by ``margin`` bits or more (a short text has too little to say so).

    Kept rows are unchanged and may be repeated; null texts go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(data: bytes | None) -> bool:
        lang, _, bits = shared.value.predict(data)
        return lang != UND and bits * len(data) - shared.value.even_bits(data) < margin

    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([known(t.as_py()) for t in part], pa.bool_())

    return docs.filter(F.arrow_udf(good, "boolean")(F.col(text_col).cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_language_id``: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
