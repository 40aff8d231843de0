"""Operator 12: phrase collocation mining by dynamic itemset counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.common import dictionary, joined, runs, slices
from factlake.plans.scratch import Scratch

UND = "und"
_NEVER = 255
#: Bytes of text that a task works on at a time, and those hashed at a time.
_SLICE, _BLOCK = 1 << 22, 1 << 18
#: Rows of phrases that a task holds to add them up.
_HELD = 1 << 19
_BLANKS = b" \t"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ``key`` is a number for the phrase and its language, ``about`` its first step and length.
_COUNTS = "key bigint, about int, n bigint"
_PHRASES = "lang string, k int, phrase string, f bigint"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for the bytes of each word: a polynomial in them, summed for a block of words at a time."""
    out = np.empty(len(starts), np.uint64)
    powers = np.cumprod(np.full(int((ends - starts).max()), 0x9E3779B97F4A7C15, np.uint64))
    cut = np.searchsorted(ends, np.arange(0, len(data) + _BLOCK, _BLOCK), side="right")
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if a < b:
            size = (ends - starts)[a:b]
            first = np.cumsum(size) - size
            spot = np.arange(int(size.sum())) - np.repeat(first, size)
            byte = data[spot + np.repeat(starts[a:b], size)].astype(np.uint64) + np.uint64(1)
            out[a:b] = np.add.reduceat(byte * powers[spot], first)
    return _mixed(out)


class Words:
    """The words of some texts, their pieces and languages, and numbers for the phrases they begin."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, begins = joined(texts)
        self.data = _LOWER[data]
        kind = _KIND[self.data]
        self.starts, self.ends = runs(kind == 0, begins)
        breaks = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind == 2, out=breaks[1:])
        doc = np.searchsorted(begins, self.starts, side="right") - 1
        # neighbours in one piece have this in common
        self.piece = breaks[self.starts] + doc
        lang_of = langs.dictionary_encode()
        self.langs = lang_of.dictionary
        self.lang = lang_of.indices.to_numpy().astype(np.int64)[doc]

    def __len__(self) -> int:
        return len(self.starts)

    def keys(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each k up to ``longest``: numbers of the phrases of k words from each word on, across pieces too."""
        own = _hashed(self.data, self.starts, self.ends)
        seed = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs.to_pylist()], np.uint64)
        key = _mixed(own ^ seed[self.lang])
        for k in range(1, min(longest, len(self)) + 1):
            if k > 1:
                key = _mixed(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :])
            yield k, key

    def split(self, k: int) -> np.ndarray:
        """Whether the phrase of ``k`` words from each word on lies in more than one piece."""
        return self.piece[: len(self) - k + 1] != self.piece[k - 1 :]


def _shift(slots: np.ndarray) -> np.uint64:
    """A phrase's slot is what its number has beyond these bits."""
    return np.uint64(64 - (len(slots).bit_length() - 1))


def count_open(words: Words, since: np.ndarray, step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """How often each open phrase occurs, by its number.

    ``since`` has for each slot (leading bits of a phrase's number) the step from which a phrase filed there may be part
    of longer ones.  A phrase begins once both its parts, without the last and without the first word, may; it
    is counted in ``shards`` steps from then on, one full cycle.  Phrases that share a slot make others
    begin early, never late.
    """
    shift, allowed = _shift(since), np.zeros(0, np.uint8)
    for k, key in words.keys(longest):
        if k == 1:
            begun = np.zeros(len(key), np.uint8)
        else:
            # a part that is new at this step was found after the last one
            begun = np.maximum(allowed[:-1], allowed[1:])
            begun[words.split(k)] = _NEVER
        for first in range(max(0, step - shards + 1), step + 1):
            mine = key[begun == first]
            if len(mine):
                mine, n = np.unique(mine, return_counts=True)
                cols = [mine.view(np.int64), np.full(len(mine), first << 8 | k, np.int32), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "about", "n"])
        allowed = since[(key >> shift).astype(np.int32)]


def read_phrases(words: Words, wanted: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """How often each phrase occurs that is ``wanted`` with all its parts, by its words; as k = 0, all words of a language."""
    n = np.bincount(words.lang, minlength=len(words.langs))
    none = pa.array([""] * len(n), pa.string())
    yield pa.RecordBatch.from_arrays([words.langs, pa.array(np.zeros(len(n), np.int32)), none, pa.array(n.astype(np.int64))], ["lang", "k", "phrase", "f"])
    shift, found = _shift(wanted), []
    for k, key in words.keys(longest):
        here = wanted[(key >> shift).astype(np.int32)]
        if k > 1:
            # what is left has no part that is not, so a slot shared by chance rarely counts
            here &= ~words.split(k) & both[:-1] & both[1:]
        both = here
        at = np.flatnonzero(here)
        if len(at):
            found.append((k, at, key[at]))
    if not found:
        return
    # only words of these phrases are read as such
    used = np.zeros(len(words), bool)
    for k, at, _ in found:
        for j in range(k):
            used[at + j] = True
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.starts[used]] += 1
    edge[words.ends[used]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    number, different = dictionary(words.data, inside, (words.ends - words.starts)[used])
    word = np.zeros(len(words), np.int32)
    word[used] = number
    del edge, inside, number, used
    for k, at, key in found:
        yield phrase_rows(at, k, key, word, different, words.lang, words.langs)


def phrase_rows(at: np.ndarray, k: int, key: np.ndarray, word: np.ndarray, words: pa.Array, lang: np.ndarray, langs: pa.Array) -> pa.RecordBatch:
    """One row for each different phrase of the ``k`` words from ``at`` on, told apart by its words."""
    _, first, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if any((p != p[first][number]).any() for p in (lang[at], *(word[at + j] for j in range(k)))):  # two phrases have one hash
        parts = np.stack([lang[at], *(word[at + j] for j in range(k))])
        _, first, n = np.unique(parts, axis=1, return_index=True, return_counts=True)
    at = at[first]
    phrase = [words.take(pa.array(word[at + j])) for j in range(k)]
    phrase = pc.binary_join_element_wise(*phrase, pa.scalar(b" ", pa.large_binary())) if k > 1 else phrase[0]
    cols = [langs.take(pa.array(lang[at])), pa.array(np.full(len(at), k, np.int32)), phrase.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(cols, ["lang", "k", "phrase", "f"])


def added_up(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``read_phrases`` with those of one phrase made one, as far as ``held`` rows reach."""
    rows: list[pa.RecordBatch] = []
    total = 0

    def one_each() -> list[pa.RecordBatch]:
        summed = pa.Table.from_batches(rows).group_by(["lang", "k", "phrase"]).aggregate([("f", "sum")])
        return summed.select(["lang", "k", "phrase", "f_sum"]).rename_columns(["lang", "k", "phrase", "f"]).combine_chunks().to_batches()

    for batch in batches:
        rows.append(batch)
        total += batch.num_rows
        if total >= held:
            rows = one_each()
            total = sum(b.num_rows for b in rows)
            if 4 * total >= 3 * held:
                yield from rows
                rows, total = [], 0
    if total:
        yield from one_each()


def frequent_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    least: int = 100,
    longest: int = 5,
    shards: int = 2,
    slot_bits: int = 24,
) -> tuple[DataFrame, DataFrame]:
    """``(lang, k, phrase, f)`` of all phrases of 1 to ``longest`` words with ``f >= least``, and ``(lang, n)``: all words.

    The rows are dealt over ``shards`` by a hash of the text.  Each step scans the next shard, round and round, and counts
    phrases of all lengths that are open: words from the first step on, a longer phrase from the step
    after both its parts have reached ``least``.  After one full cycle a phrase's count is final; below ``least``
    it goes.  The scan ends a full cycle after the last phrase that reached ``least``.  These counts are by a number
    of 64 bits for the phrase, which keeps the words of rare phrases out of the shuffles; phrases that share a
    number can only gain.  A last scan of all rows counts the phrases that are left by their words, which each task
    adds up over all it reads, so the result is exact.

    What the tasks know of the phrases so far is one byte for each of 2^``slot_bits`` slots, whatever the size of
    the corpus; the driver collects numbers of slots only.  ``docs`` is read in each step (up to ``shards * longest``, at
    most 250) and in the last scan: a costly plan should be written first.
    """
    if shards * longest > 250 or not 1 <= slot_bits <= 31:
        raise ValueError("at most 250 steps and 2^31 slots")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UND)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.filter(F.octet_length("text") > 0)
    since = np.full(1 << slot_bits, _NEVER, np.uint8)
    wanted = np.zeros(1 << slot_bits, bool)
    empty = spark.createDataFrame([], _COUNTS)
    begun, k = F.shiftright("about", 8), F.col("about").bitwiseAND(255)

    def slots_of(counts: DataFrame) -> np.ndarray:
        slot = F.shiftrightunsigned("key", 64 - slot_bits).cast("int").alias("slot")
        return counts.filter(F.col("n") >= least).select(slot).distinct().toArrow()["slot"].to_numpy()

    open_, open_path = empty, None
    step = last = 0
    while step < last + shards:
        shared = spark.sparkContext.broadcast(since)

        def scan(batches: Iterator[pa.RecordBatch], step: int = step, shared=shared) -> Iterator[pa.RecordBatch]:
            for words in _words(batches):
                yield from count_open(words, shared.value, step, shards, longest)

        shard = rows.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == step % shards)
        every = open_.unionByName(shard.mapInArrow(scan, _COUNTS))
        counts = scratch.save(every.groupBy("key", "about").agg(F.sum("n").alias("n")), "c")
        shared.destroy()
        if open_path:
            scratch.drop(open_path)
        slots = slots_of(counts.df.filter(k < longest))
        new = slots[since[slots] == _NEVER]
        step += 1
        if len(new):
            since = since.copy()
            since[new] = step
            last = step
        ended = begun + shards <= step
        wanted[slots_of(counts.df.filter(ended))] = True
        open_, open_path = counts.df.filter(~ended), counts.path
    if open_path:
        scratch.drop(open_path)
    shared = spark.sparkContext.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (rows for words in _words(batches) for rows in read_phrases(words, shared.value, longest))
        yield from added_up(found, _HELD)

    by_words = rows.mapInArrow(read, _PHRASES).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    table = scratch.save(by_words.filter((F.col("k") == 0) | (F.col("f") >= least)), "f").df
    shared.destroy()
    return table.filter("k > 0"), table.filter("k = 0 AND f > 0").select("lang", F.col("f").alias("n"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in slices(batch, 1, _SLICE):
            words = Words(part.column(1), part.column(0))
            if len(words):
                yield words


def _part(first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    share: int = 100,
    shards: int = 2,
    slot_bits: int = 24,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` collocations of each language.

    A-Z in the texts are lower-cased; texts are split at ``. , ; : ! ?`` and line ends into pieces, these at blanks
    and tabs into words.  Phrases of 2 to ``longest`` words with a >= ``least`` occurrences are candidates.  A cut
    after k words gives l and r, the counts of both parts, and floor(1000 a n / (l r)) with n, all words of the
    language; the least score over the cuts is the phrase's (the smallest k of those that have it).  A
    candidate goes if a longer one that holds it has at least ``share`` percent of its occurrences; as counts fall
    with length, it suffices to look at those with one word more.  Order: score and a falling, phrase by bytes.

    Null texts and texts without words have no phrases; a null language is ``und``; repeated rows count each;
    texts are read whole; other columns are not read; empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    every, totals = frequent_phrases(docs, text_col, lang_col, least=least, longest=longest, shards=shards, slot_bits=slot_bits)
    longer = every.filter(F.col("k") > 1).withColumn("words", F.split("phrase", " "))
    ends = F.array(_part(1, F.col("k") - 1), _part(2, F.col("k") - 1))
    inside = longer.filter(F.col("k") > 2).select("lang", F.explode(ends).alias("phrase"), "f")
    # written, so that joins to it are between plain tables and AQE can split a hot side
    inside = scratch.save(inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer")), "i").df
    kept = longer.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    one = every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    two = every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(one, ["lang", "left"]).join(two, ["lang", "right"]).join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"], exact["l"] * exact["r"])
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_collocations``: the first 2000 collocations of each language in all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
x AS (
  SELECT lang, k, f, array_to_string(w[i:i + j - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))),
o AS (SELECT lang, phrase, max(f) AS longer FROM x GROUP BY lang, phrase),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, n.n, 1000 * c.f * n.n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN n USING (lang)
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
  LEFT JOIN o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE longer IS NULL OR 100 * longer < 100 * c.f),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000"""
