"""Operator 11: quality classifier by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import dictionary, joined, runs, slices

_WORD_BREAK = np.zeros(256, bool)
_WORD_BREAK[list(b" \t\n\x0b\x0c\r")] = True
_LINE_BREAK = np.zeros(256, bool)
_LINE_BREAK[10] = True
#: Kinds of bytes: lower, upper, digit, blank, line end, sentence end, comma and the like, quotes and brackets,
#: other signs, control, first byte of a longer character, later byte of one.
_KINDS = 12
_KIND = np.full(256, 8, np.uint8)
_KIND[:32], _KIND[127] = 9, 9
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".!?", b",;:-", b"\"'()[]")):
    _KIND[list(_set)] = _i
_KIND[192:], _KIND[128:192] = 10, 11

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "long_words", "short_words", "different_words", "top_word", "seen_pairs",
    "lower", "upper", "digits", "sentence_ends", "commas", "quotes", "signs", "controls", "wide", "shouted_words", "signed_words",
    "log_lines", "line_words", "line_words_sd", "seen_lines", "ended_lines", "sentence_words", "byte_entropy",
]


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)[:n]


def _groups(at: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` texts how many different numbers it has, and how often it has the most frequent one."""
    width = int(number.max()) + 1 if len(number) else 1
    key, times = np.unique(at * width + number, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, key // width, times)
    return np.bincount(key // width, minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text, from the whole of it; null is empty.  Shares of nothing are 0."""
    n = len(texts)
    data, begins = joined(texts)
    size = np.diff(begins)
    each_byte = np.zeros((n, 256))
    for i in range(n):
        for a in range(begins[i], begins[i + 1], 1 << 20):
            each_byte[i] += np.bincount(data[a : min(a + (1 << 20), begins[i + 1])], minlength=256)
    kind = _KIND[data]
    kinds = each_byte @ (_KIND[:, None] == np.arange(_KINDS)).astype(float)
    chars = np.maximum(size - kinds[:, 11], 1)
    each_byte /= np.maximum(size, 1)[:, None]

    inside = ~_WORD_BREAK[data]
    starts, ends = runs(inside, begins)
    word, _ = dictionary(data, inside, ends - starts)
    of = np.searchsorted(begins, starts, side="right") - 1
    words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(words, 1)

    def within(inside: np.ndarray) -> np.ndarray:
        """For each word how many of its bytes are ``inside``."""
        total = np.zeros(len(inside) + 1, np.int32)
        np.cumsum(inside, out=total[1:])
        return (total[ends] - total[starts]).astype(float)

    length = within(kind != 11)
    mean = _sums(length, of, n) / some
    spread = np.sqrt(np.maximum(_sums(length**2, of, n) / some - mean**2, 0))
    different, most = _groups(of, word, n)
    together = of[1:] == of[:-1]
    width = int(word.max()) + 1 if len(word) else 1
    _, pair = np.unique(word[:-1][together] * width + word[1:][together], return_inverse=True)
    different_pairs, _ = _groups(of[1:][together], pair, n)

    lower, upper, signs = within((kind == 0) | (kind == 10)), within(kind == 1), within(kind == 8)

    line_bytes = ~_LINE_BREAK[data]
    line_starts, line_ends = runs(line_bytes, begins)
    line, _ = dictionary(data, line_bytes, line_ends - line_starts)
    line_of = np.searchsorted(begins, line_starts, side="right") - 1
    lines = np.bincount(line_of, minlength=n).astype(float)
    some_lines = np.maximum(lines, 1)
    in_line = np.bincount(np.searchsorted(line_starts, starts, side="right") - 1, minlength=len(line_starts)).astype(float) if len(starts) else np.zeros(len(line_starts))
    line_mean = _sums(in_line, line_of, n) / some_lines
    line_spread = np.sqrt(np.maximum(_sums(in_line**2, line_of, n) / some_lines - line_mean**2, 0))
    different_lines, _ = _groups(line_of, line, n)
    ended = kind[line_ends - 1] == 5

    with np.errstate(divide="ignore"):
        entropy = -(each_byte * np.where(each_byte > 0, np.log2(np.maximum(each_byte, 1e-300)), 0)).sum(axis=1)
    pairs = np.maximum(words - 1, 1)
    columns = [
        np.log1p(size), np.log1p(words), mean, spread, _sums(length >= 13, of, n) / some, _sums(length <= 2, of, n) / some,
        different / some, most / some, np.where(words > 1, 1 - different_pairs / pairs, 0),
        kinds[:, 0] / chars, kinds[:, 1] / chars, kinds[:, 2] / chars, kinds[:, 5] / some, kinds[:, 6] / some, kinds[:, 7] / some,
        kinds[:, 8] / chars, kinds[:, 9] / chars, kinds[:, 10] / chars, _sums((upper > 1) & (lower == 0), of, n) / some, _sums(signs > 0, of, n) / some,
        np.log1p(lines), line_mean, line_spread, np.where(lines > 0, 1 - different_lines / some_lines, 0), _sums(ended, line_of, n) / some_lines,
        words / np.maximum(kinds[:, 5], 1), entropy,
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Model:
    """Lookup tables: one for the bins of each feature and one for those of each chosen pair of features.

    ``edges`` cut a feature into bins, ``coarse`` into the fewer bins of pairs.  Scores are added in log odds.
    """

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, l2: float) -> np.ndarray:
    """Newton steps of a tree over ordered bins: the best cut is made until there are ``leaves`` parts."""
    parts = [(0, len(g))]

    def cut(part: tuple[int, int]) -> tuple[float, int]:
        a, b = part
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        right_g, right_h = g[a:b].sum() - left_g, h[a:b].sum() - left_h
        gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - g[a:b].sum() ** 2 / (h[a:b].sum() + l2)
        gain[(left_h < least) | (right_h < least)] = 0
        best = int(gain.argmax()) if len(gain) else 0
        return (float(gain[best]), a + best + 1) if len(gain) else (0.0, a)

    while len(parts) < leaves:
        found = [cut(p) for p in parts]
        i = max(range(len(parts)), key=lambda j: found[j][0])
        if found[i][0] <= 1e-12:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, found[i][1]), (found[i][1], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), l2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of a tree that cuts the first axis once and then each side once on the second."""

    def sides(m: np.ndarray) -> np.ndarray:
        """Sums by side of the first cut, first cut, and up to each bin of the second axis."""
        up = np.cumsum(m, axis=0)[:-1]
        return np.cumsum(np.stack([up, m.sum(axis=0) - up]), axis=2)

    sum_g, sum_h = sides(g), sides(h)
    left_g, left_h, all_g, all_h = sum_g[..., :-1], sum_h[..., :-1], sum_g[..., -1:], sum_h[..., -1:]
    if not left_g.size:
        return 0.0, np.zeros_like(g)
    gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2)
    gain[(left_h < least) | (all_h - left_h < least)] = 0
    second = gain.argmax(axis=2)
    total = gain.max(axis=2).sum(axis=0)
    first = int(total.argmax())
    out = np.zeros_like(g)
    for side, rows in enumerate((slice(0, first + 1), slice(first + 1, None))):
        at = int(second[side, first]) + 1
        for columns in (slice(0, at), slice(at, None)):
            out[rows, columns] = _leaf(g[rows, columns].sum(), h[rows, columns].sum(), l2)
    return float(total[first] - g.sum() ** 2 / (h.sum() + l2)), out


def boost(
    x: np.ndarray, y: np.ndarray, *, bins: int = 64, pair_bins: int = 12, pairs: int = 10, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, leaves: int = 3,
    least: float = 2.0, l2: float = 1.0,
) -> Model:
    """Cyclic boosting: in every round each feature in turn gets a shallow tree on the residuals of all before it.

    Each tree is added to the feature's table.  The ``pairs`` of features whose trees explain most of what the
    single features leave are then boosted likewise.  With labels of one kind only the base is learned.
    """
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < n:
        return Model(base, [], [], [], [], [])

    def cuts(column: np.ndarray, k: int) -> np.ndarray:
        """Between different values, about as many rows in each bin."""
        return np.unique(np.quantile(column, np.arange(1, k) / k, method="higher"))

    edges, coarse = ([cuts(x[:, j], k) for j in range(width)] for k in (bins, pair_bins))
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = residuals()
            step = rate * _tree(np.bincount(fine[j], g, len(tables[j])), np.bincount(fine[j], h, len(tables[j])), leaves, least, l2)
            tables[j] += step
            total += step[fine[j]]

    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def cells(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(rough[a] * shape[1] + rough[b], weights, shape[0] * shape[1]).reshape(shape)

    g, h = residuals()
    gains = {(a, b): _pair_tree(cells(a, b, g), cells(a, b, h), least, l2)[0] for a, b in combinations(range(width), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(chosen):
            g, h = residuals()
            step = rate * _pair_tree(cells(a, b, g), cells(a, b, h), least, l2)[1]
            pair_tables[i] += step
            total += step[rough[a], rough[b]]
    return Model(base, edges, tables, coarse, chosen, pair_tables)


def held_out(id_col: str) -> Column:
    """One document in three, by the CRC-32 of its id as text; a document without id is held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            x = features(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample_rows: int = 16_384) -> Model:
    """Learn from the labelled documents that are not held out.

    The sample is bounded: the ``sample_rows`` labelled ids whose hash is smallest, with their whole texts; their
    features, not their texts, reach the driver.  Ids with labels of both kinds, other labels than 0
    and 1, and null ids teach nothing; rows that repeat an id of the sample all take part.  Without any the model is the base alone.
    """
    usable = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    one = usable.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("id", "label")
    # at most sample_rows rows
    some = one.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(some), "id").select("label", "text")
    got = rows.mapInArrow(_featured, "label int, x array<double>").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = got["label"].to_numpy().astype(float)
    # the rows come in any order: sums of floats should not
    order = np.lexsort((*x.T, y))
    return boost(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``, from its whole text alone.

    ``score`` is the model's probability that the label is 1, and ``predicted`` 1 from 0.5 on.  Null texts are scored
    as empty ones; repeated rows stay; other columns are not read; the id takes part in ``held_out`` only.  A few
    megabytes of text are scored at a time, a longer text by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                p = shared.value.score(features(part.column(2)))
                cols = [part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_quality``: the quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
