"""Group-wise work that stays even when one group holds a large share of all rows.

Aggregates combine on the map side.  They are joined back on the key as a struct: an aggregate is already
dealt by its key, and a join that uses that dealing is one stage with the aggregate, which AQE never splits; the
struct makes both sides plain exchanges, so AQE splits a hot key (set
``spark.sql.adaptive.forceOptimizeSkewedJoin`` where a split needs another shuffle).

A plain window sends a whole group to one task.  Here windows of large groups run inside slices: groups are large if they
fill half a slice or more of a bounded sample of the keys, borders are taken from the same sample, and the slice of a
row of a large group is an expression of its (group, order) and these literals; all other rows only look their group up
among the large ones.  The carry table, which says what came before a slice, has two rows for each border at most,
whatever the sizes of table and groups, and is safe to broadcast; without large groups there is none.
The table is read twice (sample, window), with large groups three times, and shuffled once: a costly plan, or one that
gives other rows each time, should be written first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.plans.scratch import Scratch

#: Rows of the sample for each slice.
_SAMPLED = 20


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality on ``columns``."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def join_summary(df: DataFrame, summary: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of ``summary``, an aggregate by ``on``; null keys match nothing.  A hot key can be split."""
    for c in on:
        summary = summary.filter(F.col(c).isNotNull())
    rest = [c for c in summary.columns if c not in on]
    keyed = summary.select(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(on)]).alias("_key"), *rest)
    key = F.struct(*[df[c].alias(f"_{i}") for i, c in enumerate(on)])
    return df.join(keyed, key == keyed["_key"], how).drop("_key")


def attach_group(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """Add group aggregates to every row: combined on the map side, then joined back.

    Rows whose key is null get null aggregates.
    """
    return join_summary(df, df.groupBy(*by).agg(*aggregates), by)


def _sample(df: DataFrame, columns: list[str]) -> tuple[list, int]:
    """A bounded random sample of the keys in order, and how many of its rows make a slice, of which there are about as many as a shuffle has partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*columns)
    some = keys.orderBy(F.rand(17)).limit(_SAMPLED * n).orderBy(*columns).collect()
    return some, max(1, len(some) // n)


def _borders(df: DataFrame, columns: list[str]) -> list:
    """Rows of the sample that cut the table into ranges of one slice."""
    some, every = _sample(df, columns)
    return some[every::every]


def _large(some: list, by: list[str], every: int, least: float) -> tuple[list, list]:
    """A row of each group that fills ``least`` of a slice of the sample or more and holds a border, and the borders in these."""
    groups, borders = [], []
    begin = 0
    for _, rows in groupby(some, key=lambda row: [row[c] for c in by]):
        rows = list(rows)
        inside = [r for i, r in enumerate(rows, begin) if i and i % every == 0]
        begin += len(rows)
        if inside and (not least or len(rows) > 1 and len(rows) >= least * every):
            groups.append(rows[0])
            borders += inside
    return groups, borders


def _literals(df: DataFrame, columns: list[str], found: list) -> Column:
    types = [df.schema[c].dataType for c in columns]
    return F.array(*[F.struct(*[F.lit(row[c]).cast(t).alias(c) for c, t in zip(columns, types)]) for row in found])


def _place(df: DataFrame, columns: list[str], borders: list) -> Column:
    """How many of the sorted ``borders`` are at or before a row: found by halving, so by few comparisons."""
    if not borders:
        return F.lit(0)
    table, key = _literals(df, columns, borders), F.struct(*[F.col(c) for c in columns])

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        # beyond the last border there is nothing to compare with
        above = F.coalesce(F.get(table, middle) <= key, F.lit(False))
        return F.struct(F.when(above, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))
    return F.aggregate(steps, start, halve, lambda acc: acc["lo"])


@dataclass(frozen=True)
class Sliced:
    df: DataFrame
    by: list[str]
    order: list[str]
    #: Whether a row's group is cut into slices; None if none is.
    cut: Column | None

    @property
    def window(self):
        # whole groups may share the shuffle of another window on some of their columns
        return Window.partitionBy(*self.by, *([] if self.cut is None else ["_slice"])).orderBy(*self.order)

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row for each slice of the groups that are cut."""
        return self.df.filter(self.cut).groupBy(*self.by, "_slice").agg(*aggregates)

    def across(self):
        return Window.partitionBy(*self.by).orderBy("_slice")

    def carry(self, df: DataFrame, table: DataFrame, column: str) -> DataFrame:
        keys = [*self.by, "_slice"]
        renamed = [f"_k{i}" for i in range(len(keys))]
        right = table.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], column)
        match = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)]
        )
        return df.join(F.broadcast(right), match, "left").drop(*renamed)


def slice_groups(df: DataFrame, by: list[str], order: list[str], least: float = 0.5) -> Sliced:
    """Cut the large groups into ranges of (group, order); ``_slice`` numbers them and is 0 in other groups.

    Groups are large if they hold a border and fill ``least`` of a slice.
    """
    columns = list(dict.fromkeys([*by, *order]))
    some, every = _sample(df, columns)
    groups, borders = _large(some, by, every, least)
    if not groups:
        return Sliced(df.withColumn("_slice", F.lit(0)), by, order, None)
    types = [df.schema[c].dataType for c in by]
    keys = [F.struct(*[F.lit(row[c]).cast(t).alias(c) for c, t in zip(by, types)]) for row in groups]
    cut = F.struct(*[F.col(c) for c in by]).isin(*keys)
    place = F.when(cut, _place(df, columns, borders)).otherwise(0)
    return Sliced(df.withColumn("_slice", place), by, order, cut)


def running_sum(
    df: DataFrame, by: list[str], order: list[str], value: Column, out: str
) -> DataFrame:
    """Exclusive running total of ``value`` inside each group (0 for the first row)."""
    parts = slice_groups(df, by, order)
    before = parts.window.rowsBetween(Window.unboundedPreceding, -1)
    local = parts.df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
    if parts.cut is None:
        return local.drop("_slice")
    earlier = parts.across().rowsBetween(Window.unboundedPreceding, -1)
    table = parts.summary(F.sum(value).alias("_v")).withColumn("_c", F.sum("_v").over(earlier))
    joined = parts.carry(local, table, "_c")
    return joined.withColumn(out, F.col(out) + F.coalesce("_c", F.lit(0))).drop("_c", "_slice")


def previous_value(
    df: DataFrame, by: list[str], order: list[str], value: Column, out: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its group."""
    parts = slice_groups(df, by, order)
    before = parts.window.rowsBetween(Window.unboundedPreceding, -1)
    local = parts.df.withColumn(out, F.last(value, ignorenulls=True).over(before))
    if parts.cut is None:
        return local.drop("_slice")
    latest = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))
    earlier = parts.across().rowsBetween(Window.unboundedPreceding, -1)
    table = parts.summary(latest.alias("_m")).withColumn(
        "_c", F.last("_m", ignorenulls=True).over(earlier)["_v"]
    )
    joined = parts.carry(local, table, "_c")
    return joined.withColumn(out, F.coalesce(out, "_c")).drop("_c", "_slice")


def next_value(df: DataFrame, by: list[str], order: list[str], value: Column, out: str, *, nullable: bool = True) -> DataFrame:
    """``value`` of the following row of the group, null for the last.

    A null ``value`` reads as the first one behind the next border, if the group has one.  So every group with a
    border is cut unless ``nullable`` is false; then only large ones are.
    """
    parts = slice_groups(df, by, order, 0 if nullable else 0.5)
    local = parts.df.withColumn(out, F.lead(value).over(parts.window))
    if parts.cut is None:
        return local.drop("_slice")
    first = F.min(F.struct(*order, value.alias("_v")))
    table = parts.summary(first.alias("_m")).withColumn(
        "_c", F.lead("_m").over(parts.across())["_v"]
    )
    joined = parts.carry(local, table, "_c")
    return joined.withColumn(out, F.coalesce(out, "_c")).drop("_c", "_slice")


def global_running_sum(df: DataFrame, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Exclusive running total over the whole table in ``order``, without a one-task window.

    Columns are ordered by borders as above; for other sort expressions the rows are range partitioned and written
    once.  The carry table has one row for each range.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    if all(isinstance(c, str) for c in order):
        ranges = df.withColumn("_part", _place(df, order, _borders(df, order)))
    else:
        ranged = df.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id())
        ranges = Scratch(df.sparkSession, "ranges").save(ranged, "r").df
    before = Window.partitionBy("_part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_part").agg(F.sum(value).alias("_v"))
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select("_part", F.sum("_v").over(earlier).alias("_c"))
    zero = F.lit(0)
    return (
        ranges.withColumn(out, F.coalesce(F.sum(value).over(before), zero))
        .join(F.broadcast(offsets), "_part", "left")
        .withColumn(out, F.col(out) + F.coalesce("_c", zero))
        .drop("_c", "_part")
    )


def global_row_number(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """1-based position in ``order`` over the whole table."""
    numbered = global_running_sum(df, order, F.lit(1), out)
    return numbered.withColumn(out, (F.col(out) + 1).cast("bigint"))
