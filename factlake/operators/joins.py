"""Lookup, range, as-of and overlap joins (J1-J11; J2 is ``graph.split_by_closure``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.checks import CheckFailed
from factlake.plans.skew import join_summary, next_value, previous_value


def _one_each(table: DataFrame, key: str, value: str) -> DataFrame:
    """``table(key, value)``; reading the value of a key that has several rows raises."""
    grouped = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    message = F.concat(F.lit(f"several rows for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return grouped.select(key, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(value)).alias(value))


def resolve_refs(
    refs: DataFrame,
    defs: DataFrame,
    hints: DataFrame,
    *,
    ref_id: str,
    def_id: str,
    match_cols: list[str],
    hint_key: str,
) -> DataFrame:
    """``(ref, match columns, target, status)`` — each reference with what it resolves to.

    A hint ``(hint_key, target)`` wins, and two for one key are an error; else exactly one definition with equal ``match_cols``;
    otherwise the status is ``ambiguous`` or ``missing``.  Leaving a column out of ``match_cols``
    ignores it.  Candidates are counted, never paired, so a popular name costs one row.
    """
    candidates = defs.groupBy(*match_cols).agg(
        F.countDistinct(def_id).alias("_n"), F.min(def_id).alias("_only")
    )
    chosen = _one_each(hints, hint_key, "target").withColumnRenamed("target", "_hint")
    joined = join_summary(join_summary(refs, candidates, match_cols), chosen, [hint_key])
    count = F.coalesce("_n", F.lit(0))
    status = F.when(F.col("_hint").isNotNull(), "hint").when(count == 1, "unique")
    return joined.select(
        ref_id,
        *match_cols,
        F.coalesce("_hint", F.when(count == 1, F.col("_only"))).alias("target"),
        status.when(count > 1, "ambiguous").otherwise("missing").alias("status"),
    )


def retain_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a known node; sources are not looked at."""
    known = nodes.select(F.col("id").alias("dst"))
    return edges.join(known, "dst", "left_semi").select(*edges.columns)


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges ``[root, end]`` that the range before them reaches into.

    Neighbours in sort order are enough: if any two ranges meet, some neighbours do.
    """
    known = ranges.filter(F.col("root").isNotNull() & F.col("end").isNotNull())
    ordered = next_value(
        known.select("root", "end", F.lit(0).alias("_all")), ["_all"], ["root", "end"], F.col("root"), "_next"
    )
    return ordered.filter(F.col("_next") <= F.col("end")).select("root", "end")


def range_lookup(points: DataFrame, ranges: DataFrame, *, point: str, check: bool = True) -> DataFrame:
    """Each point with the range ``[root, end]`` that holds it and its ``offset``.

    A point in no range keeps null ``root``.  Ranges must be disjoint, so only the one that begins last at or
    before a point can hold it: ranges and points are swept together in one order, in slices of it.  A
    range is one row whatever its length.  Null points and ranges with null ends match nothing.
    """
    if check and not overlapping_ranges(ranges).isEmpty():
        raise CheckFailed("ranges overlap")
    kept = [F.struct(*[F.col(c) for c in points.columns]).alias("_row")]
    begin = ranges.filter(F.col("root").isNotNull() & F.col("end").isNotNull()).select(
        F.lit(0).alias("_all"), F.col("root").alias("_at"), F.lit(0).alias("_is_point"), F.struct("root", "end").alias("_range")
    )
    asked = points.select(F.lit(0).alias("_all"), F.col(point).alias("_at"), F.lit(1).alias("_is_point"), *kept)
    swept = previous_value(
        begin.unionByName(asked, allowMissingColumns=True), ["_all"], ["_at", "_is_point"], F.col("_range"), "_found"
    ).filter(F.col("_is_point") == 1)
    inside = F.col("_at") <= F.col("_found.end")
    root = F.when(inside, F.col("_found.root"))
    return swept.select(
        *[F.col("_row")[c].alias(c) for c in points.columns], root.alias("root"), (F.col("_at") - root).alias("offset")
    )


def overlapping_members(
    members: DataFrame,
    *,
    group: str,
    owner: str,
    element: str,
    exclude: DataFrame | None = None,
    size: str | None = None,
) -> DataFrame:
    """The ``(group, owner)`` that share an element with another owner of their group.

    Elements in ``exclude`` are subtracted first.  With ``size`` two owners count only when their
    sizes agree or one of them has none.  Whether an owner meets another one is read off the
    distinct owners of each (group, element), so no pair is ever formed.
    """
    kept = members if exclude is None else members.join(exclude, element, "left_anti")
    cell = [group, element]
    if size is None:
        # two different owners exist exactly when the smallest and the largest differ
        ends = kept.groupBy(*cell).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
        shared = ends.filter("_lo <> _hi").select(*cell)
        return kept.join(shared, cell, "left_semi").select(group, owner).distinct()
    # the size takes part in the join key, so a cell with many sizes does not multiply its rows
    keyed = kept.withColumn("_s", F.coalesce(F.col(size).cast("string"), F.lit("")))
    unsized = F.col("_s") == ""
    by_size = keyed.groupBy(*cell, "_s").agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
    per_cell = by_size.groupBy(*cell).agg(
        F.min("_lo").alias("_all_lo"),
        F.max("_hi").alias("_all_hi"),
        F.min(F.when(unsized, F.col("_lo"))).alias("_un_lo"),
        F.max(F.when(unsized, F.col("_hi"))).alias("_un_hi"),
    )
    rows = join_summary(keyed, by_size.join(per_cell, cell), [*cell, "_s"], "inner")

    def other(lo: str, hi: str) -> Column:
        """Whether someone else is among the owners whose least and largest these are."""
        mine = F.col(owner)
        return F.coalesce((F.col(lo) != mine) | (F.col(hi) != mine), F.lit(False))

    sized_partner = other("_lo", "_hi") | other("_un_lo", "_un_hi")
    partner = F.when(unsized, other("_all_lo", "_all_hi")).otherwise(sized_partner)
    return rows.filter(partner).select(group, owner).distinct()


def inverse_index(
    sets: DataFrame,
    *,
    owner: str,
    element: str,
    allowed: DataFrame,
    local: DataFrame | None = None,
    pred: Column | None = None,
) -> DataFrame:
    """Distinct ``(element, owner)`` for allowed, non-local elements that pass ``pred``.

    Long form: a popular element has one row for each owner instead of one huge set.
    """
    kept = sets if pred is None else sets.filter(pred)
    kept = kept.select(element, owner).distinct().join(allowed, element, "left_semi")
    return kept if local is None else kept.join(local, element, "left_anti")


def asof_attribute(
    log: DataFrame, *, by: list[str], order: list[str], is_source: Column, is_check: Column, id: str
) -> DataFrame:
    """Each check with the nearest strictly earlier source of its group, as ``source_id``.

    Checks without an earlier source are dropped.  One pass over the ordered log.
    """
    source = F.when(is_source, F.col(id))
    seen = previous_value(log, by, order, source, "source_id")
    return seen.filter(is_check & F.col("source_id").isNotNull())


def conflicts(live: DataFrame, invalid: DataFrame) -> DataFrame:
    """The ``(point, label)`` that are both live and invalid."""
    return live.intersect(invalid.select(*live.columns))


def zip_positional(
    args: DataFrame, specs: DataFrame, by: list[str], pos: str = "pos", keep: Column | None = None
) -> DataFrame:
    """Arguments and specs paired by position, up to the shorter list, then filtered."""
    paired = args.join(specs, [*by, pos])
    return paired if keep is None else paired.filter(keep)


def lookup_with_default(
    df: DataFrame, dim: DataFrame, *, key: str, value: str, policy: str = "null", default=None
) -> DataFrame:
    """``df`` with ``value`` from ``dim``, which has one row for each key; more are an error.

    Unknown keys: ``conservative`` takes ``default``, ``null`` stays null, ``noop`` drops the row
    because nothing follows from it.
    """
    if policy not in ("conservative", "noop", "null"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "conservative" and default is None:
        raise ValueError("the conservative policy needs a default")
    small = _one_each(dim, key, value)
    if policy == "noop":
        return df.join(small, key, "inner")
    joined = df.join(small, key, "left")
    if policy == "null":
        return joined
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def neighbours(
    nodes: DataFrame, edges: DataFrame, fields: DataFrame, *, kinds: DataFrame, parent_kind: str
) -> DataFrame:
    """``(id, relation, other)``: one-hop predecessors of a kind, and a node's own fields.

    ``nodes(id)`` are the targets, ``kinds(id, kind)``, ``fields(id, field)``.  Both relations have
    at least one row for every target; ``other`` is null when its set is empty.
    """
    targets = nodes.select("id").distinct()
    parents = kinds.filter(F.col("kind") == parent_kind).select(F.col("id").alias("src"))
    back = edges.join(parents, "src", "left_semi").select(F.col("dst").alias("id"), "src").distinct()
    up = targets.join(back, "id", "left").select(
        "id", F.lit("parent").alias("relation"), F.col("src").cast("string").alias("other")
    )
    own = fields.select("id", F.col("field").cast("string").alias("other")).distinct()
    down = targets.join(own, "id", "left").select("id", F.lit("field").alias("relation"), "other")
    return up.unionByName(down)
