"""Group flags, lattices, bit masks and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.plans.skew import attach_group, global_row_number, join_summary

MAX_MASK_BITS = 63


def all_of_group(
    df: DataFrame, outer: list[str], group: str, flag: str, out: str = "all_set"
) -> DataFrame:
    """A1: a row stays true only if every row of its group (inside ``outer``) is true.

    A null group means no group: such a row becomes false, unless its ``outer`` key has no group at
    all, in which case flags pass unchanged.
    """
    grouped = F.col(group).isNotNull()
    per_group = df.groupBy(*outer, group).agg(
        F.bool_and(flag).alias("_all"), F.lit(True).alias("_seen")
    )
    per_outer = F.max(grouped).alias("_any_group")
    with_outer = attach_group(df, outer, per_outer)
    keys = [*outer, group]
    joined = join_summary(with_outer, per_group.filter(grouped).drop("_seen"), keys)
    value = F.when(~F.coalesce("_any_group", F.lit(False)), F.col(flag)).otherwise(
        F.coalesce("_all", F.lit(False))
    )
    return joined.select(*[F.col(c) for c in df.columns], value.alias(out))


def any_of_group(
    df: DataFrame,
    outer: list[str],
    group: str,
    flag: str,
    out: str = "any_set",
    *,
    drop_empty: bool = False,
) -> DataFrame:
    """A2: a row is true if any row of its group is; a row without group keeps its flag.

    ``drop_empty`` leaves out the outer keys in which nothing is true.
    """
    joined = attach_group(df, [*outer, group], F.bool_or(flag).alias("_any"))
    value = F.when(F.col(group).isNull(), F.col(flag)).otherwise(F.col("_any"))
    result = joined.select(*[F.col(c) for c in df.columns], value.alias(out))
    if not drop_empty:
        return result
    alive = df.groupBy(*outer).agg(F.bool_or(flag).alias("_any")).filter("_any").select(*outer)
    return result.join(alive, outer, "left_semi")


def _flat(df: DataFrame, by: list[str], value: str, state: str | None, many: str, none: str) -> DataFrame:
    """Flat lattice over the values: none seen, one distinct value, or several / an absorbing one."""
    kind = F.col(state) if state else F.when(F.col(value).isNull(), none).otherwise("elem")
    elem = F.when(kind == "elem", F.col(value))
    merged = df.groupBy(*by).agg(
        F.min(elem).alias("_lo"), F.max(elem).alias("_hi"), F.bool_or(kind == many).alias("_many")
    )
    several = F.coalesce("_many", F.lit(False)) | F.coalesce(
        F.col("_lo") != F.col("_hi"), F.lit(False)
    )
    result = F.when(several, many).when(F.col("_lo").isNull(), none).otherwise("elem")
    single = ~several & F.col("_lo").isNotNull()
    return merged.select(
        *by, result.alias("state"), F.when(single, F.col("_lo")).alias("value")
    )


def lattice_meet(df: DataFrame, by: list[str], value: str, state: str | None = None) -> DataFrame:
    """A3: meet per group.  Rows are top (null value), elem, or bottom (by the state column)."""
    return _flat(df, by, value, state, many="bottom", none="top")


def lattice_join(df: DataFrame, by: list[str], value: str, state: str | None = None) -> DataFrame:
    """A3, the dual: rows are bottom (null value), elem, or top."""
    return _flat(df, by, value, state, many="top", none="bottom")


def bit(index: Column) -> Column:
    """A4: the mask of one member; members are 0 to 62, an index outside gives null."""
    inside = (index >= 0) & (index < MAX_MASK_BITS)
    # the shift count is an int column, which F.shiftleft does not take
    return F.when(inside, F.call_function("shiftleft", F.lit(1).cast("bigint"), index.cast("int")))


def full_mask(width: int) -> Column:
    """All members below ``width``: a long up to 63 members, beyond that a wide mask."""
    if width < 0:
        raise ValueError("a mask has no negative width")
    if width > MAX_MASK_BITS:
        ones = [(1 << min(64, width - i)) - 1 for i in range(0, width, 64)]
        # the sign bit is a member like any other
        return F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("bigint") for w in ones])
    return F.lit((1 << width) - 1).cast("bigint")


def mask_union(mask: Column | str) -> Column:
    """Aggregate: members of any mask."""
    return F.bit_or(mask)


def mask_intersect(mask: Column | str) -> Column:
    """Aggregate: members of every mask."""
    return F.bit_and(mask)


def mask_subtract(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def mask_count(mask: Column) -> Column:
    return F.bit_count(mask).cast("bigint")


def mask_superset(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) == b


def zero_mask(width: int) -> Column:
    """The empty wide mask: an array of longs, member i is bit ``i % 64`` of word ``i // 64``."""
    return F.array(*[F.lit(0).cast("bigint")] * (-(-width // 64)))


def wide_bit(index: Column, width: int) -> Column:
    """A4 for any declared width: the wide mask of one member; an index outside gives null."""
    shift = F.call_function("shiftleft", F.lit(1).cast("bigint"), (index % 64).cast("int"))
    words = [
        F.when((index >= i) & (index < i + 64), shift).otherwise(F.lit(0).cast("bigint")) for i in range(0, width, 64)
    ]
    return F.when((index >= 0) & (index < width), F.array(*words))


def _wide(fold, mask: Column, width: int) -> Column:
    words = F.array(*[fold(F.get(mask, F.lit(i))) for i in range(-(-width // 64))])
    return F.when(F.count(mask) > 0, words)


def wide_union(mask: Column, width: int) -> Column:
    """Aggregate: members of any wide mask; null without one."""
    return _wide(F.bit_or, mask, width)


def wide_intersect(mask: Column, width: int) -> Column:
    """Aggregate: members of every wide mask; null without one."""
    return _wide(F.bit_and, mask, width)


def wide_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def wide_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def wide_superset(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y) == y), lambda same: same)


def wide_members(mask: Column) -> Column:
    """The members of a wide mask as a sorted array."""
    bits = F.sequence(F.lit(0), F.lit(63))

    def members(word: Column, number: Column) -> Column:
        return F.transform(F.filter(bits, lambda i: F.getbit(word, i) == 1), lambda i: number * 64 + i)

    return F.flatten(F.transform(mask, members))


def single_def_single_use(
    df: DataFrame, by: list[str], is_def: Column, extra: DataFrame | None = None
) -> DataFrame:
    """A5: keys with exactly one definition and exactly two mentions, and those of ``extra``."""
    counts = df.groupBy(*by).agg(
        F.count_if(is_def).alias("_defs"), F.count(F.lit(1)).alias("_mentions")
    )
    keys = counts.filter("_defs = 1 AND _mentions = 2").select(*by)
    return keys if extra is None else keys.unionByName(extra.select(*by)).distinct()


def weighted_rank(
    keys: DataFrame, rows: DataFrame, *, key: str, kind: str, weights: dict[str, int]
) -> DataFrame:
    """Every key with its summed weight and its place in descending order, ties by key."""
    weight = F.lit(0).cast("bigint")
    for name, points in weights.items():
        weight = F.when(F.col(kind) == name, F.lit(points).cast("bigint")).otherwise(weight)
    sums = rows.groupBy(key).agg(F.sum(weight).alias("_w"))
    scored = (
        keys.select(key)
        .join(sums, key, "left")
        .select(key, F.coalesce("_w", F.lit(0).cast("bigint")).alias("score"))
    )
    return global_row_number(scored, [F.col("score").desc(), F.col(key)], "place")


def equivalence_classes(df: DataFrame, id: str, key_exprs: list[Column]) -> DataFrame:
    """``(id, rep, class_id)``: rows with equal keys, the smallest id as representative.

    Class ids are dense from 0 in the order of the representatives.
    """
    # the digest stands for the key, so long key values are not shuffled
    parts = [F.coalesce(F.sha2(k.cast("binary"), 256), F.lit("-")) for k in key_exprs]
    keyed = df.select(F.col(id), F.concat_ws("|", *parts).alias("_key"))
    reps = keyed.groupBy("_key").agg(F.min(id).alias("rep"))
    numbered = global_row_number(reps, ["rep"], "class_id")
    return keyed.join(numbered, ["_key"]).select(
        id, "rep", (F.col("class_id") - 1).alias("class_id")
    )


def duration_stages(
    df: DataFrame,
    by: list[str],
    *,
    label: str,
    mark: str,
    stages: list[tuple[str, str, str]],
    totals: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Per group ``later − earlier`` for each stage ``(name, earlier, later)``, never below 0.

    The first mark of a label counts and a missing mark is 0.  ``totals`` adds ``(name, label)``
    columns with the mark itself.  Labels are given, so no pass looks for pivot values.
    """
    labels = {x for _, a, b in stages for x in (a, b)} | {x for _, x in totals or []}
    names = {x: f"_m{i}" for i, x in enumerate(sorted(labels))}
    firsts = [
        F.coalesce(F.min(F.when(F.col(label) == x, F.col(mark))), F.lit(0)).alias(n)
        for x, n in names.items()
    ]
    marks = df.groupBy(*by).agg(*firsts)
    columns = [
        F.greatest(F.col(names[b]) - F.col(names[a]), F.lit(0)).alias(name) for name, a, b in stages
    ]
    columns += [F.col(names[x]).alias(name) for name, x in totals or []]
    return marks.select(*by, *columns)
