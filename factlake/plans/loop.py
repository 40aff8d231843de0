"""The loop kernel under all graph operators: semi-naive evaluation with one table per round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.plans.scratch import Scratch, Table

DEFAULT_MAX_ROUNDS = 10_000
_COMPACT_AFTER = 12
#: Steps that one plan takes.
_HOPS = 2
#: A state of up to so many rows is joined as it is; a larger one is first cut down to what a round may change.
_DIRECT_ROWS = 1 << 21


class NotConverged(RuntimeError):
    """A loop hit ``max_rounds`` before its fixpoint; nothing is truncated silently."""


def follow(rows: DataFrame, arcs: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``key`` moved along ``arcs(src, dst)``, one row for each arc."""
    to = arcs.select(F.col("src").alias(key), F.col("dst").alias("_to"))
    rest = [c for c in rows.columns if c != key]
    return rows.join(to, key).select(F.col("_to").alias(key), *rest)


def grow(
    start: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    *,
    name: str,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
    hops: int | None = None,
) -> DataFrame:
    """Least set containing ``start`` and closed under ``step``.

    Each round takes a few steps, in one plan, from the rows that were new in the round before.  Of what it finds the
    known rows are taken off and the rest is appended as a further Parquet folder: known rows are neither
    rewritten nor, if there are many, shuffled: then what is found is written first, and known rows are looked
    up by a semi join that keeps the state where it is while the finds are small enough to broadcast.  A
    merge every few rounds bounds the number of folders.
    ``hops`` stops after that many steps on purpose; ``max_rounds`` raises.
    """
    scratch = Scratch(start.sparkSession, name)
    keys = start.columns
    delta = scratch.save(start.distinct(), "d")
    parts, known = [delta.path], delta.rows
    done = 0
    while delta.rows and (hops is None or done < hops):
        if done >= max_rounds:
            raise NotConverged(f"{name}: no fixpoint after {max_rounds} rounds")
        done += 1
        steps = [step(delta.df).select(*keys).distinct()]
        while hops is None and len(steps) < _HOPS:
            steps.append(step(steps[-1]).select(*keys).distinct())
        found = reduce(DataFrame.unionByName, steps).distinct()
        state = scratch.read(parts, start)
        if known <= _DIRECT_ROWS:
            delta = scratch.save(found.join(state, keys, "left_anti"), "d")
        else:
            found = scratch.save(found, "f")
            near = state.join(found.df, keys, "left_semi")
            delta = scratch.save(found.df.join(near, keys, "left_anti"), "d")
            scratch.drop(found.path)
        known += delta.rows
        if delta.rows:
            parts.append(delta.path)
        if len(parts) > _COMPACT_AFTER:
            merged = scratch.save(scratch.read(parts[:-1], start), "m")
            for path in parts[:-1]:
                scratch.drop(path)
            parts = [merged.path, parts[-1]]
    return scratch.read(parts, start)


def spread(
    start: DataFrame,
    arcs: DataFrame,
    lower: list[str],
    upper: list[str],
    *,
    name: str,
    add: str | None = None,
    back: list[str] | None = None,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """Send values along ``arcs(src, dst)`` and keep the extremes at each node.

    ``start(id, …)`` has one row for each node; columns in ``lower`` keep the smallest value that
    arrives, those in ``upper`` the largest.  Each hop adds the arc's column ``add``.  Columns in ``back`` go
    against the arcs.  Nulls are not sent.
    """
    folds = {**dict.fromkeys(lower, (F.min, F.least)), **dict.fromkeys(upper, (F.max, F.greatest))}
    ways = [(False, [c for c in folds if c not in (back or [])]), (True, [c for c in folds if c in (back or [])])]
    more = F.col("_add") if add else F.lit(0)
    links = {
        turned: arcs.select(F.col("dst" if turned else "src").alias("id"), F.col("src" if turned else "dst").alias("_to"), *([F.col(add).alias("_add")] if add else []))
        for turned, _ in ways
    }

    def hop(rows: DataFrame) -> DataFrame:
        sent = []
        for turned, columns in ways:
            if columns:
                some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
                moved = rows.filter(some).select("id", *columns).join(links[turned], "id")
                sent.append(moved.select(F.col("_to").alias("id"), *[(F.col(c) + more if add else F.col(c)).alias(c) for c in columns]))
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sent)
        # combined on the map side: a node with very many arcs gets one row per task
        return every.groupBy("id").agg(*[f(c).alias(c) for c, (f, _) in folds.items()])

    def step(changed: DataFrame) -> DataFrame:
        # what a further hop sends on is a value of some path, improved or not
        steps = [hop(changed)]
        while len(steps) < _HOPS:
            steps.append(hop(steps[-1]))
        every = reduce(DataFrame.unionByName, steps).groupBy("id")
        return every.agg(*[f(c).alias(f"_{c}") for c, (f, _) in folds.items()])

    def merge(state: DataFrame, offers: DataFrame) -> DataFrame:
        best = {c: g(F.col(c), F.col(f"_{c}")) for c, (_, g) in folds.items()}
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in best.items()])
        return state.join(offers, "id", "left").select(
            "id", *[v.alias(c) for c, v in best.items()], (~same).alias("changed")
        )

    return relax(start, step, merge, keys=["id"], name=name, max_rounds=max_rounds)


def relax(
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    keys: list[str],
    name: str,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """Iterate a keyed state whose rows can be improved.

    ``step(changed)`` proposes at most one row for each key from the rows that changed last;
    ``merge(rows, proposed)`` gets rows of the state, those of the proposed keys among them, and returns them, and
    new ones, with a boolean ``changed`` column.  Ends when nothing changes.  A small state is merged in one plan
    and written anew.  Of a large one a round appends the changed rows as a further version: it is neither
    rewritten nor shuffled while the proposals are small enough to broadcast.  Every few rounds the
    versions, but not the first table, become one.
    """
    scratch = Scratch(state.sparkSession, name)
    first = scratch.save(state, "s")
    if first.rows > _DIRECT_ROWS:
        return _relax_large(scratch, first, step, merge, keys, name, max_rounds)
    now, path, changed = first.df, first.path, first.df
    for _ in range(max_rounds):
        merged = scratch.put(merge(now, step(changed)).select(*state.columns, "changed"), "s")
        changed = merged.df.filter("changed").drop("changed")
        scratch.drop(path)
        now, path = merged.df.drop("changed"), merged.path
        if changed.isEmpty():
            return now
    raise NotConverged(f"{name}: no fixpoint after {max_rounds} rounds")


def _relax_large(
    scratch: Scratch,
    table: Table,
    step: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    keys: list[str],
    name: str,
    max_rounds: int,
) -> DataFrame:
    state = table.df
    rest = [c for c in state.columns if c not in keys]

    def latest(paths: list[str], among: DataFrame | None = None) -> DataFrame:
        rows = scratch.read(paths, like)
        if among is not None:
            rows = rows.join(among.select(*keys), keys, "left_semi")
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_round").alias("_v"), F.max("_round").alias("_round"))
        return newest.select(*keys, *[F.col("_v")[c].alias(c) for c in rest], "_round")

    first = scratch.save(state.withColumn("_round", F.lit(0)), "s")
    scratch.drop(table.path)
    like, parts, changed = first.df, [first.path], first.df.drop("_round")
    for number in range(1, max_rounds + 1):
        offers = scratch.save(step(changed), "o")
        if offers.rows:
            merged = merge(latest(parts, offers.df).drop("_round"), offers.df).filter("changed")
            better = scratch.save(merged.select(*state.columns, F.lit(number).alias("_round")), "v")
        scratch.drop(offers.path)
        if not offers.rows or not better.rows:
            if len(parts) == 1:
                return first.df.drop("_round")
            final = scratch.save(latest(parts).drop("_round"), "r").df
            for path in parts:
                scratch.drop(path)
            return final
        parts.append(better.path)
        changed = better.df.drop("_round")
        if len(parts) > _COMPACT_AFTER:
            versions = scratch.save(latest(parts[1:-1]), "m")
            for path in parts[1:-1]:
                scratch.drop(path)
            parts = [parts[0], versions.path, parts[-1]]
    raise NotConverged(f"{name}: no fixpoint after {max_rounds} rounds")
