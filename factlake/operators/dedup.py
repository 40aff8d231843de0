"""Structural de-duplication of named records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.plans.loop import DEFAULT_MAX_ROUNDS, NotConverged
from factlake.plans.scratch import Scratch
from factlake.plans.skew import attach_group

_LANES = 4
_HEX_PER_LANE = 15


def _lanes(text: Column) -> list[Column]:
    """A SHA-256 digest as four numbers of 60 bits, which add up without overflow."""
    digest = F.sha2(text.cast("binary"), 256)
    return [
        F.conv(F.substring(digest, 1 + i * _HEX_PER_LANE, _HEX_PER_LANE), 16, 10).cast("decimal(38,0)")
        for i in range(_LANES)
    ]


def _bag_digest(df: DataFrame, by: list[str], text: Column, out: str) -> DataFrame:
    """Digest of the multiset of ``text`` per group.

    The sum of digests combines on the map side, so a record with very many fields is never
    gathered in one place; positions are part of ``text``, which makes the bag an ordered list.
    """
    lanes = [f"_l{i}" for i in range(_LANES)]
    wide = df.select(*by, *[c.alias(n) for c, n in zip(_lanes(text), lanes)])
    sums = wide.groupBy(*by).agg(*[F.sum(n).alias(n) for n in lanes])
    return sums.select(*by, F.sha2(F.concat_ws("|", *[F.col(n) for n in lanes]).cast("binary"), 256).alias(out))


def _quoted(value: Column | str) -> Column:
    """A value that cannot be confused with its neighbours once concatenated."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def structural_classes(
    nodes: DataFrame, fields: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """``(id, rep, colour)``: records are one class iff they agree all the way down.

    ``nodes(id, name, generated)`` and ``fields(id, pos, name, type, child)``; ``type`` describes a
    field apart from its record and ``child`` is the id of the record it leads to, or null.  The
    starting colour covers the name (unless generated) and the fields' names and types; each round
    mixes in the children's colours, in order.  Recursive records settle because classes can only
    split; the loop ends when a round splits none.  ``rep`` is the smallest id of the class.
    """
    scratch = Scratch(nodes.sparkSession, "classes")
    base = nodes.select("id", F.when(~F.col("generated"), F.col("name")).alias("_name")).distinct()
    fact = scratch.save(fields.select("id", "pos", "name", "type", "child").distinct(), "f").df
    shallow = F.concat(_quoted("pos"), _quoted("name"), _quoted("type"), _quoted(F.col("child").isNotNull()))
    body = _bag_digest(fact, ["id"], shallow, "_body")
    first = base.join(body, "id", "left").select(
        "id", F.sha2(F.concat(_quoted("_name"), _quoted("_body")).cast("binary"), 256).alias("colour")
    )
    current = scratch.save(first, "c")
    count = current.df.select("colour").distinct().count()
    links = fact.filter(F.col("child").isNotNull()).select("id", "pos", "child")
    for _ in range(max_rounds):
        child = current.df.select(F.col("id").alias("child"), F.col("colour").alias("_child"))
        mixed = _bag_digest(
            links.join(child, ["child"], "left"),
            ["id"],
            # a child without record counts by its id, so different unknown children stay apart
            F.concat(_quoted("pos"), _quoted("_child"), _quoted(F.when(F.col("_child").isNull(), F.col("child")))),
            "_deep",
        )
        finer = current.df.join(mixed, "id", "left").select(
            "id", F.sha2(F.concat(_quoted("colour"), _quoted("_deep")).cast("binary"), 256).alias("colour")
        )
        following = scratch.save(finer, "c")
        now = following.df.select("colour").distinct().count()
        if now == count:
            scratch.drop(following.path)
            break
        scratch.drop(current.path)
        current, count = following, now
    else:
        raise NotConverged(f"structural classes: still splitting after {max_rounds} rounds")
    return attach_group(current.df, ["colour"], F.min("id").alias("rep")).select("id", "rep", "colour")


def same_name_classes(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``(name, n_records, n_classes)`` over the records that carry a name of their own."""
    named = nodes.filter(~F.col("generated")).join(classes, "id")
    return named.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("rep").alias("n_classes")
    )


def _definitions(nodes: DataFrame, opaque: DataFrame) -> DataFrame:
    named = nodes.join(opaque.select("id"), "id", "left_anti").filter(~F.col("generated"))
    return named.groupBy("name").agg(F.min("id").alias("target"), F.countDistinct("id").alias("n_definitions"))


def ambiguous_definitions(nodes: DataFrame, opaque: DataFrame) -> DataFrame:
    """``(name, target, n_definitions)`` of opaque names with several definitions; ``target`` is the one taken."""
    asked = opaque.select("name").distinct()
    return _definitions(nodes, opaque).filter("n_definitions > 1").join(asked, "name", "left_semi")


def resolve_opaque(fields: DataFrame, nodes: DataFrame, opaque: DataFrame) -> DataFrame:
    """Fields whose child is an opaque declaration point to the record of the same name.

    ``opaque(id, name)`` lists declarations without a body.  A name defined more than once takes
    the smallest id, and ``ambiguous_definitions`` lists it; a name without definition stays as it is.
    """
    target = _definitions(nodes, opaque).select("name", F.col("target").alias("_def"))
    found = opaque.select(F.col("id").alias("child"), "name").join(target, "name").select("child", "_def")
    joined = fields.join(found, ["child"], "left")
    rest = [c for c in fields.columns if c != "child"]
    return joined.select(*rest, F.coalesce("_def", "child").alias("child")).select(*fields.columns)


def canonicalise(
    df: DataFrame, classes: DataFrame, ref_cols: list[str], *, key: str | None = None
) -> DataFrame:
    """D3: references rewritten to their class representative, then distinct rows.

    With ``key`` only the representative's own row is kept.
    """
    kept = df
    if key is not None:
        own = classes.filter(F.col("id") == F.col("rep")).select(F.col("id").alias(key))
        kept = df.join(own, key, "left_semi")
    for col in ref_cols:
        mapping = classes.select(F.col("id").alias(col), F.col("rep").alias("_rep"))
        joined = kept.join(mapping, [col], "left")
        kept = joined.withColumn(col, F.coalesce("_rep", col)).select(*df.columns)
    return kept.distinct()
