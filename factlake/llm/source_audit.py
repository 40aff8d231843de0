"""Operator 13: source divergence audit by chunk factorization."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.common import dictionary, joined, runs, slices
from factlake.plans.scratch import Scratch

SCALE = 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_CHUNKS = "lang string, source string, chunk string, n bigint, docs bigint, lo bigint, hi bigint"
#: Pairs of sources of as many are compared at a time.
_PAIRS = 1 << 20


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each document, counted, then added up by language and source for a few megabytes of text."""
    for batch in batches:
        for part in slices(batch, 3):
            data, begins = joined(part.column(3))
            inside = ~_SPACE[data]
            starts, ends = runs(inside, begins)
            if not len(starts):
                continue
            chunk, chunks = dictionary(data, inside, ends - starts)
            group_of = pa.StructArray.from_arrays([part.column(1), part.column(2)], ["lang", "source"])
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in group_of.to_pylist()], np.int64)
            doc = np.searchsorted(begins, starts, side="right") - 1
            # one number for group, chunk and document: the counts of each document, in this order
            key, n = np.unique((group[doc] * len(chunks) + chunk) * len(part) + doc, return_counts=True)
            pair, doc = np.divmod(key, len(part))
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            last = np.append(first[1:], len(pair)) - 1
            which, chunk = np.divmod(pair[first], len(chunks))
            ids, keys = part.column(0).to_numpy(), list(names)
            cols = [
                pa.array([keys[g][0] for g in which.tolist()], pa.string()), pa.array([keys[g][1] for g in which.tolist()], pa.string()),
                chunks.take(pa.array(chunk)).cast(pa.binary()).cast(pa.string()), pa.array(np.add.reduceat(n, first)),
                pa.array(last - first + 1), pa.array(ids[doc[first]]), pa.array(ids[doc[last]]),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "chunk", "n", "docs", "lo", "hi"])


def chunk_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, chunk, n, docs, lo, hi)`` from ``(row, lang, source, text)``: occurrences, the number of
    documents, the smallest and the largest of them, for each white-space chunk of each source.

    A document lies in one group and one task, so their numbers add up exactly.
    """
    counted = docs.mapInArrow(_count_chunks, _CHUNKS)
    return counted.groupBy("lang", "source", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``chunks`` with a row for each ``term`` of a chunk, only A-Z lower-cased, in its place; a term that it has twice gives two rows."""
    lower = F.translate("chunk", _UPPER, _LOWER)
    rest = [c for c in chunks.columns if c != "chunk"]
    return chunks.select(*rest, F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)), exactly."""
    exact = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", exact, F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)")) + 1


def _excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a term adds to a pair of sources that both have it, beyond what each of them adds alone."""

    def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for batch in batches:
        names: dict[tuple, int] = {}
        groups = batch.column(1).flatten()
        langs = np.repeat(np.array(batch.column(0).to_pylist(), object), np.diff(batch.column(1).offsets.to_numpy()))
        at = np.array([names.setdefault((x, s), len(names)) for x, s in zip(langs, groups.field(0).to_pylist())], np.int64)
        p, zero = (groups.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        border = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
        size = np.diff(border)
        # the left side of a pair is each row, the right side each row of the same term
        width, begin = np.repeat(size, size), np.repeat(border[:-1], size)
        ends = np.cumsum(width)
        row, sums = 0, {}
        while row < len(at):
            limit = (ends[row - 1] if row else 0) + _PAIRS
            stop = max(row + 1, int(np.searchsorted(ends, limit, side="right")))
            w = width[row:stop]
            left = np.repeat(np.arange(row, stop), w)
            right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[row:stop], w)
            left, right = left[left != right], right[left != right]
            more = excess(p[left], p[right]) - excess(p[left], zero[right]) - excess(zero[left], p[right]) + excess(zero[left], zero[right])
            pair, number = np.unique(at[left] * len(names) + at[right], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, number, more)
            for k, v in zip(pair.tolist(), total.tolist()):
                sums[k] = sums.get(k, 0) + v
            row = stop
        keys = list(names)
        found = [(keys[k // len(keys)], keys[k % len(keys)], v) for k, v in sums.items()]
        cols = [[a[0] for a, _, _ in found], [a[1] for a, _, _ in found], [b[1] for _, b, _ in found], [v for *_, v in found]]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "source", "item", "value"])


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    *,
    min_docs: int = 3,
    top: int = 200,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far the sources of a language are from each other and from it.

    A language keeps the V terms that at least ``min_docs`` (3 at most) of its rows have.  Every group (language and
    source) and every language gives a kept term with n occurrences the share p = 1 + floor(10^9 (n + 1) / (N + V)),
    N being all its occurrences of kept terms; the excess of p over q is floor((p - q)^2 / q).  Part ``pair`` has for
    each other source of the language the sum of the group's excess over it, all ranks; part ``term``
    the kept terms that the group has more of than its language, with the excess, to rank ``top``.  Larger
    values come first, then items by bytes.

    Texts are cut at white space into chunks, which are counted in each document and added up by source; each
    different chunk of a source is cut into terms once, where it is added up.  Whether a term stands in enough documents
    follows from its chunks' numbers of documents, or else from the one or two documents of each.  The sum of a pair is that of two sources
    without terms, plus what each adds by its own terms (alike for equal shares), plus a correction for
    terms that both have: memory for a block of pairs, output for each pair of sources.

    Null texts, languages and sources are empty strings; groups without terms take part; with V = 0 pairs are 0;
    repeated rows are documents of their own; texts are read whole; empty tables give no rows.
    """
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs is 1, 2 or 3")
    scratch = Scratch(docs.sparkSession, "divergence")

    def filled(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), filled(lang_col, "lang"), filled(source_col, "source"), F.col(text_col).cast("binary").alias("text"))
    groups = scratch.save(rows.select("lang", "source").distinct(), "g").df
    # one row for each group, chunk and term: written, as the counts and the exact test read it
    having = scratch.save(chunk_terms(chunk_counts(rows)), "t").df
    bounds = [F.sum("docs").alias("most"), F.max("docs").alias("fewest")]
    counts = scratch.save(having.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), *bounds), "n").df
    # a document is in one source, so the sources' bounds add up (a chunk that has a term twice only raises the upper one); only terms between both are looked at again, and all
    # chunks of these stand in one or two documents, which are known
    known = counts.groupBy("lang", "term").agg(F.sum("most").alias("most"), F.sum("fewest").alias("fewest")).filter(F.col("most") >= min_docs)
    known = scratch.save(known, "b").df
    open_ = known.filter(F.col("fewest") < min_docs).select("lang", "term")
    each = having.join(open_, ["lang", "term"], "left_semi").select("lang", "term", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("doc")).distinct()
    enough = each.groupBy("lang", "term").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = known.filter(F.col("fewest") >= min_docs).select("lang", "term").unionByName(enough.select("lang", "term"))
    kept = scratch.save(kept, "k").df
    counts = scratch.save(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "n").df

    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = groups.join(size, "lang", "left").join(total, ["lang", "source"], "left").fillna(0, ["v", "total"])
    groups = scratch.save(groups.withColumn("none", _share(zero, F.col("total"), F.col("v"))), "g").df
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "none")
    shares = scratch.save(shares, "p").df

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    whole = scratch.save(whole.join(langs, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q")), "q").df
    over = shares.join(whole, ["lang", "term"]).filter(F.col("p") > F.col("q"))
    terms = over.select("lang", "source", F.col("term").alias("item"), _excess(F.col("p"), F.col("q")).alias("value"))

    def ranked(found: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    pairs = scratch.save(_pairs(groups, shares), "o").df
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the summed excess of each group over each other source of its language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    different = F.col("source") != F.col("item")
    plain = groups.join(other, "lang").filter(different)
    plain = plain.select("lang", "source", "item", (F.col("v") * _excess(F.col("none"), F.col("other"))).alias("value"))
    # terms of equal share add alike, so one row stands for all of them
    alike = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("times"))
    alone = alike.join(other, "lang").filter(different)
    p, none, far = F.col("p"), F.col("none"), F.col("other")
    ahead = F.struct("lang", "source", "item", (F.col("times") * (_excess(p, far) - _excess(none, far))).alias("value"))
    back = F.struct("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * (_excess(far, p) - _excess(far, none))).alias("value"))
    alone = alone.select(F.inline(F.array(ahead, back)))
    # a term's sources: at most all of its language, of which the result has every pair
    together = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("sources"))
    both = together.filter(F.size("sources") > 1).select("lang", "sources").mapInArrow(_both, "lang string, source string, item string, value bigint")
    every = reduce(DataFrame.unionByName, [plain, alone, both])
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13_source_audit``: the divergence of all sources of the documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (
  SELECT doc_id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source) USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(c.n)::HUGEINT + 1) // (max(w.n) + max(v.v)) AS q
  FROM c JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM c GROUP BY lang) w USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a
  JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200"""
