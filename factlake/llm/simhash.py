"""Operator 2: SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import blocks
from factlake.operators.graph import connected_components
from factlake.plans.scratch import Scratch

SHINGLE = 3
SEED = 42


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        # 255 ones fit a byte, so the inner sums stay in bytes
        out += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(data: bytes | None, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text in UTF-8, worked through in blocks of about a megabyte."""
    digest, seed = xxhash.xxh64_intdigest, SEED
    total, n, words = np.zeros(64, np.int64), 0, []
    for block in blocks(data or b""):
        words = words[-(k - 1) :] + block.lower().split() if n or words else block.lower().split()
        if len(words) < k:
            continue
        hashes = np.fromiter(
            (digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))), np.uint64, len(words) - k + 1
        )
        total += _counts(hashes)
        n += len(hashes)
    if not n and words:
        total, n = _counts(np.array([digest(b" ".join(words), seed)], np.uint64)), 1
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` for each row of ``docs``, ``fp`` a bigint with the bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, fp bigint"
    )


def _pieces(value: Column, width: int, count: int) -> Column:
    """``count`` segments of ``width`` bits, lowest first."""
    mask = F.lit((1 << width) - 1)
    return F.array(*[F.shiftrightunsigned(value, width * i).bitwiseAND(mask) for i in range(count)])


def _ball(width: int) -> Column:
    """Masks of the Hamming ball of radius 1 around a segment."""
    return F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(width)])


def links(fps: DataFrame, hot_bucket: int = 512) -> DataFrame:
    """``(src, dst)``: all pairs of the distinct fingerprints ``fps(fp)`` that differ in 1 to 3 bits.

    Two values that differ in at most 3 bits differ in at most one bit in one of their 32-bit halves:
    each fingerprint is filed under both halves and looks up the 33 values around each of its own,
    and found pairs are verified over all 64 bits.  A half that more than ``hot_bucket`` fingerprints
    share is not paired out: there the other half is cut in two, and one of the two 16-bit parts must
    again be within one bit, so that a fingerprint meets at most 2 * 17 * 65,536 others in such a bucket
    whatever the size of the table, and no link is lost.

    Spark takes what ``explode`` makes for as large as its input, so it would broadcast the lookups, 66 for each
    fingerprint and 17 times that in hot buckets, of a table that it sizes below the broadcast limit: a hint keeps
    these joins shuffled.
    """
    scratch = Scratch(fps.sparkSession, "simhash")
    filed = fps.select("fp", F.posexplode(_pieces(F.col("fp"), 32, 2)).alias("seg", "val"))
    asked = filed.select(F.col("fp").alias("q"), "seg", F.explode(_ball(32)).alias("_m"), "val")
    asked = asked.select("q", "seg", F.col("val").bitwiseXOR(F.col("_m")).alias("val"))
    near = (F.col("q") < F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= 3)
    pair = [F.col("q").alias("src"), F.col("fp").alias("dst")]

    hot = scratch.save(filed.groupBy("seg", "val").count().filter(F.col("count") > hot_bucket).select("seg", "val"), "hot")
    if not hot.rows:
        return filed.hint("merge").join(asked, ["seg", "val"]).filter(near).select(*pair).distinct()
    cold = filed.join(hot.df, ["seg", "val"], "left_anti").hint("merge").join(asked, ["seg", "val"])

    def parts(rows: DataFrame, name: str) -> DataFrame:
        other = F.when(F.col("seg") == 0, F.shiftrightunsigned(name, 32)).otherwise(F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)))
        return rows.select(name, "seg", "val", F.posexplode(_pieces(other, 16, 2)).alias("part", "pval"))

    fine = parts(filed.join(hot.df, ["seg", "val"], "left_semi"), "fp")
    seek = parts(asked.join(hot.df, ["seg", "val"], "left_semi"), "q")
    seek = seek.select("q", "seg", "val", "part", F.explode(_ball(16)).alias("_m"), "pval")
    seek = seek.select("q", "seg", "val", "part", F.col("pval").bitwiseXOR(F.col("_m")).alias("pval"))
    deep = fine.hint("merge").join(seek, ["seg", "val", "part", "pval"])
    return cold.filter(near).select(*pair).unionByName(deep.filter(near).select(*pair)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hot_bucket: int = 512) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``.

    Words are the runs of other than ASCII white space after A-Z are lower-cased; shingles are three
    words, repeats included, a shorter text is one shingle, a text without words (null, empty, white
    space) has fingerprint zero and is linked like any other.  Equal fingerprints are one node, so
    copies never meet in pairs.  ``component_id`` is the smallest id that can be reached by links of at
    most 3 bits, null only if all ids there are null.  Repeated rows stay repeated; rows with one id and
    different texts are not linked by their id.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col), "fp").df
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("first")), "n").df
    pairs = scratch.save(links(nodes.select("fp"), hot_bucket), "e").df
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    label = connected_components(pairs, ends).withColumnRenamed("node", "fp")
    linked = label.join(nodes, "fp")
    least = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
    known = linked.join(least, "comp").select("fp", "component_id")
    known = nodes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # a written table: the last join then has plain shuffles on both sides, which AQE splits at a hot fingerprint
    known = scratch.save(known, "c").df
    return rows.join(known, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one with the smallest id.

    Columns stay as they are.  Rows without id cannot be told apart and stay; of rows that repeat an id
    one stays if the id is the smallest of its group.
    """
    known = near_duplicates(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    kept = known.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias(id_col)).distinct()
    one = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.filter(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_simhash_dups``: every document with its fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
