"""Reading text corpora and cutting them into records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.plans.scratch import Scratch


def read_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row ``(path, text)`` for each file below ``path`` whose name matches ``glob``."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
    )
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(
        F.col("text").isNotNull()
    )


def _records(text: Column, delim: str) -> Column:
    """The records of a text: each keeps its delimiter, the last one may lack it."""
    parts = F.split(text, re.escape(delim), -1)
    closed = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: F.concat(part, F.lit(delim))
    )
    last = F.filter(F.slice(parts, F.size(parts), F.lit(1)), lambda part: part != "")
    return F.concat(closed, last)


def split_records(df: DataFrame, col: str, delim: str = "\n") -> DataFrame:
    """``(…, pos, record)`` for each record of ``col``; an empty text gives none."""
    if len(delim) != 1:
        raise ValueError("the delimiter is one character")
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(_records(F.col(col), delim)).alias("pos", "record"))


def read_records(spark: SparkSession, path: str, delim: str = "\n", glob: str = "*") -> DataFrame:
    """S2 over files: ``(path, pos, record)``, as ``split_records`` of each file's text, but record by record.

    Files of any size are cut into splits, which Spark reads by ``delim``: a record is a value, a file never is.
    What is read is written once, with each record's place in its split; its position in the file is that and
    the number of records in the splits before, of which there is one row each.  The reader drops the
    delimiters; a file's last record lacks one where its size says so.  A byte order mark is dropped.
    """
    if len(delim) != 1:
        raise ValueError("the delimiter is one character")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    info = F.col("_metadata")
    read = files.text(path, lineSep=delim).select(
        info["file_path"].alias("path"), info["file_block_start"].alias("_split"), info["file_size"].alias("_size"),
        # the records of a split follow each other in one task
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("record"),
    )
    scratch = Scratch(spark, "records")
    stored = scratch.put(read, "r").df
    width = len(delim.encode())
    splits = stored.groupBy("path", "_split", "_size").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("record") + width).alias("_bytes")
    )
    splits = scratch.put(splits, "s").df
    whole = Window.partitionBy("path")
    earlier = whole.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.sum("_bytes").over(whole) - F.col("_size")
    # the mark is three bytes; only a delimiter of three bytes leaves no way to tell
    open_end = (beyond == width) | ((beyond == width - 3) & (width != 3))
    placed = splits.select(
        "path", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.when(open_end, F.sum("_n").over(whole)).alias("_open"),
    )
    pos = F.col("_before") + F.col("_at") - F.col("_first")
    closed = F.when(pos + 1 == F.col("_open"), F.col("record")).otherwise(F.concat("record", F.lit(delim)))
    return stored.join(placed, ["path", "_split"]).select("path", pos.alias("pos"), closed.alias("record"))


def chunk_records(df: DataFrame, col: str, n: int) -> DataFrame:
    """S3: ``(…, pos, part, chunk)`` with binary chunks of at most ``n - 1`` bytes.

    A chunk ends right after a newline: chunk ``part`` of record ``pos``.
    """
    if n < 2:
        raise ValueError("a chunk holds n - 1 bytes, so n is at least 2")
    size = n - 1
    records = split_records(df, col, "\n").withColumn("_bytes", F.encode("record", "utf-8"))
    last = F.floor((F.octet_length("_bytes") - 1) / F.lit(size)).cast("int")
    keep = [c for c in df.columns if c != col]
    parts = records.select(
        *keep, "pos", "_bytes", F.explode(F.sequence(F.lit(0), last)).alias("part")
    )
    chunk = F.substring("_bytes", F.col("part") * size + 1, F.lit(size))
    return parts.select(*keep, "pos", "part", chunk.alias("chunk"))


def union_sources(inputs: list[tuple[str, DataFrame]], tag: str = "origin") -> DataFrame:
    """Several inputs as one table, each row tagged with its input's name."""
    if not inputs:
        raise ValueError("no inputs")
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in inputs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def changed_only(before: DataFrame, after: DataFrame, key: list[str], col: str) -> DataFrame:
    """K3: rows of ``after`` whose ``col`` differs from ``before``."""
    old = before.select(*key, F.col(col).alias("_old"))
    joined = after.join(old, key)
    return joined.filter(~F.col(col).eqNullSafe(F.col("_old"))).select(*after.columns)
