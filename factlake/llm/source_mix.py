"""Operator 9: mix sources to target weights by Efraimidis-Spirakis sampling, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.common import fresh
from factlake.plans.scratch import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 16
GROUP = 1 << 8


def text_quality(size: Column, chars: Column) -> Column:
    """2 for texts of six characters a word, less for shorter or longer ones."""
    return 2 - F.abs(chars / F.greatest(size, F.lit(1)) - 6) / 4


def _key(id_col: Column, size: Column, chars: Column, quality: Column) -> Column:
    """Exponential key with rate ``quality``: the smallest keys are a weighted sample without replacement."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), size.cast("string"), chars.cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / F.least(F.greatest(quality, F.lit(0.5)), F.lit(2.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row for each source.

    Sources by code point, null last, have the ``weights`` in turn and share ``ratio`` times all sizes by
    weight; none has more than ``cap`` times its size, the rest goes to the others by weight again.
    That ends where target = min(cap * size, level * weight): the level is found in one pass over the
    sources by cap * size / weight, of which those below the level are full.  There is one row for
    each source, so these windows are over a table as long as the list of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    table = sizes.withColumn("w", turn).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    table = table.withColumn("r", F.col("most") / F.col("w"))
    by_ratio = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    table = table.withColumn("level", (ratio * F.sum("source_size").over(whole) - full) / F.sum("w").over(after))
    table = table.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(whole)["level"])
    most = F.coalesce(F.least("most", F.col("level") * F.col("w")), F.col("most"))
    return table.select("source", "source_size", most.alias("target"))


def _where(sums: DataFrame, budget: DataFrame) -> DataFrame:
    """``(source, at, rest, ahead)``: of ``sums(source, at, n)`` the row of each source in which ``rest`` runs out, with
    ``ahead``, what comes before it, from ``budget(source, rest, base)``.  A source has at most 256 rows."""
    order = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    known = budget.select(F.col("source").alias("s"), "rest", "base")
    found = before.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("ahead", F.col("base") + F.col("before"))
    return found.filter("ahead < rest AND rest <= ahead + n").select("source", "at", "rest", "ahead")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    ratio: float = 1.5,
    cap: float = 2.0,
    quality: Callable[[Column, Column], Column] = text_quality,
    cut: bool = True,
) -> tuple[DataFrame, list[str]]:
    """``docs`` with four columns more, and their names: size, source size, target of the source, words taken.

    The size is the number of runs of other than ASCII white space (null: 0).  A source whose target is n
    sizes and a rest has n complete epochs; the rest goes to the documents with the smallest
    exponential keys, whose rate ``quality(size, characters)`` is held between 0.5 and 2.  The document at
    which the rest runs out gives its first words (``cut``), or is taken whole if half of it or more fits.
    Keys come from hashed id, size and length, so reruns agree; ties go by id, nulls first, then
    size, and repeated rows count one by one.  Null sources are one source; documents without words take
    nothing.

    The sort within a source is done by ranges of keys: sizes are summed for each source and each of 65,536
    ranges (combined on the map side), prefix sums over groups of 256 ranges and then over those of one group
    find the range in which the budget ends, and only its rows, about one in 65,536 of the source, are sorted one by one.
    """
    size_, key_, bucket_, total_, target_, taken_, src_ = names = fresh(
        docs, "size", "_key", "_bucket", "source_size", "target", "taken", "_source"
    )
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("bigint")
    rows = docs.withColumn(size_, size)
    chars = F.coalesce(F.length(text_col), F.lit(0))
    rows = rows.withColumn(key_, _key(F.col(id_col), F.col(size_), chars, quality(F.col(size_), chars)))
    place = F.floor(BUCKETS * (1 - F.exp(-F.col(key_))))
    rows = rows.withColumn(bucket_, F.least(place, F.lit(BUCKETS - 1)).cast("int"))

    sums = rows.groupBy(F.col(source_col).alias("source"), F.col(bucket_).alias("bucket")).agg(F.sum(size_).alias("n"))
    sums = Scratch(docs.sparkSession, "mix").save(sums, "b").df
    budget = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, ratio, cap)
    words, each = F.round("target").cast("bigint"), F.greatest("source_size", F.lit(1))
    budget = budget.withColumn("epochs", F.floor(words / each)).withColumn("rest", words - F.col("epochs") * each)
    # the range in which the rest runs out: first among groups of ranges, then within the group found
    group = F.floor(F.col("bucket") / GROUP).cast("int")
    wide = sums.groupBy("source", group.alias("at")).agg(F.sum("n").alias("n"))
    wide = _where(wide, budget.withColumn("base", F.lit(0).cast("bigint")))
    own = wide.select(F.col("source").alias("s"), "at", "rest", F.col("ahead").alias("base"))
    same = F.col("source").eqNullSafe(F.col("s")) & (group == F.col("at"))
    narrow = sums.join(own, same, "left_semi").select("source", F.col("bucket").alias("at"), "n")
    last = _where(narrow, own.select(F.col("s").alias("source"), "rest", "base"))
    last = last.select("source", F.col("at").alias("bucket"), "ahead")
    plan = budget.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.select(
        F.col("source").alias(src_), F.col("source_size").alias(total_), F.col("target").alias(target_),
        F.struct("epochs", "rest", "ahead", F.coalesce("bucket", F.lit(-1)).alias("bucket")).alias(taken_),
    )
    plan = Scratch(docs.sparkSession, "mix").save(plan, "p").df

    joined = rows.join(plan, rows[source_col].eqNullSafe(plan[src_]))
    info = F.col(taken_)
    within = F.when(F.col(bucket_) < info["bucket"], F.col(size_)).otherwise(F.lit(0)).cast("bigint")
    sure = joined.filter(F.col(bucket_) != info["bucket"]).withColumn(taken_, info["epochs"] * F.col(size_) + within)
    order = Window.partitionBy(src_).orderBy(key_, id_col, size_).rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.filter(F.col(bucket_) == info["bucket"])
    left = info["rest"] - info["ahead"] - F.coalesce(F.sum(size_).over(order), F.lit(0))
    if cut:
        part = F.greatest(F.lit(0), F.least(F.col(size_), F.col(key_)))
    else:
        part = F.when(2 * F.col(key_) >= F.col(size_), F.col(size_)).otherwise(F.lit(0))
    # the key has done its work: its column carries what is left of the budget
    edge = edge.withColumn(key_, left).withColumn(taken_, info["epochs"] * F.col(size_) + part.cast("bigint"))
    out = [size_, total_, target_, taken_]
    keep = [*(F.col(c) for c in docs.columns), *(F.col(c) for c in out)]
    return sure.select(*keep).unionByName(edge.select(*keep)), out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: whole documents, each as many times as it is taken.

    Columns are unchanged; documents of which nothing is taken, those without words among them, go.
    """
    rows, (size, _, _, taken) = mix(docs, id_col, text_col, source_col, cut=False)
    (copies,) = fresh(rows, "_copies")
    times = F.floor(F.col(taken) / F.greatest(F.col(size), F.lit(1))).cast("int")
    repeated = rows.withColumn(copies, F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*[F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_source_mix``: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows, (size, total, target, taken) = mix(docs)
    return rows.select("doc_id", F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(target).alias("target"), F.col(taken).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) AS chars FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || chars), 1, 13))::BIGINT + 1)
         / 4503599627370496.0) / least(greatest(2 - abs(chars / greatest(size, 1) - 6) / 4, 0.5), 2.0) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 2.0 * source_size / w AS r,
         (1.5 * sum(source_size) OVER ()
          - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, source_size,
         least(2.0 * source_size, w * (SELECT arg_min(level, r) FROM l WHERE level <= r))::DOUBLE AS target FROM l),
b AS (
  SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS epochs,
         round(target)::BIGINT % greatest(source_size, 1) AS rest FROM t),
c AS (
  SELECT k.*, b.source_size, b.target, b.epochs, b.rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM c"""
