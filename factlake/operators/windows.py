"""Layout, log order and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.plans.loop import DEFAULT_MAX_ROUNDS, NotConverged, relax
from factlake.plans.scratch import Scratch
from factlake.plans.skew import (
    global_row_number,
    global_running_sum,
    join_summary,
    next_value,
    running_sum,
)


def layout_ranges(
    df: DataFrame, owner: str, pos: str, width: Column, *, initial: int = 0
) -> DataFrame:
    """``start`` is the exclusive running total of widths over all owners in order.

    ``end`` is ``start + width``; width 0 gives an empty range.  ``(owner, pos)`` must be unique.
    """
    sized = df.withColumn("_width", width.cast("bigint"))
    placed = global_running_sum(sized, [owner, pos], F.col("_width"), "start")
    start = (F.col("start") + F.lit(initial)).cast("bigint")
    return (
        placed.withColumn("start", start)
        .withColumn("end", F.col("start") + F.col("_width"))
        .drop("_width")
    )


def flatten_offsets(
    fields: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """Offsets of nested records, bottom up.

    ``fields(owner, pos, child, kind)``: ``child`` names the nested record and is null for a
    primitive; ``kind`` is ``field`` or ``union``.  A field starts at the summed lengths of the
    fields before it; the length of an array or slice field is that of its element, which ``child``
    names.  An empty record has a row with null ``pos`` and counts as 1.  Returns
    ``lengths(owner, length)`` and ``offsets(owner, pos, child, kind, offset, length)``.
    """
    scratch = Scratch(fields.sparkSession, "offsets")
    facts = scratch.save(fields.select("owner", "pos", "child", "kind"), "f").df
    owners = facts.select("owner").distinct()
    inner = facts.filter(F.col("child").isNotNull() & F.col("pos").isNotNull())
    like = owners.select("owner", F.lit(0).cast("bigint").alias("length"))
    known_paths: list[str] = []
    open_ = scratch.save(owners, "o")
    for _ in range(max_rounds):
        if not open_.rows:
            break
        # an owner is ready when no child of it is still open
        waiting = inner.join(open_.df.select(F.col("owner").alias("child")), "child", "left_semi")
        ready = open_.df.join(waiting.select("owner"), "owner", "left_anti")
        part = facts.join(ready, "owner", "left_semi")
        if known_paths:
            known = scratch.read(known_paths, like).select(
                F.col("owner").alias("child"), F.col("length").alias("_len")
            )
            part = part.join(known, "child", "left")
        else:
            part = part.withColumn("_len", F.lit(None).cast("bigint"))
        size = F.when(F.col("pos").isNull(), 0).otherwise(F.coalesce("_len", F.lit(1)))
        solved = scratch.save(
            part.groupBy("owner").agg(F.greatest(F.sum(size), F.lit(1)).alias("length")), "l"
        )
        if not solved.rows:
            raise ValueError("records contain each other: offsets need finite nesting")
        known_paths.append(solved.path)
        open_ = scratch.save(open_.df.join(solved.df, "owner", "left_anti"), "o")
    else:
        raise NotConverged(f"records are nested deeper than {max_rounds}")
    lengths = scratch.read(known_paths, like) if known_paths else like
    child = lengths.select(F.col("owner").alias("child"), "length")
    sized = (
        facts.filter(F.col("pos").isNotNull())
        .join(child, "child", "left")
        .select("owner", "pos", "child", "kind", F.coalesce("length", F.lit(1)).alias("length"))
    )
    offsets = running_sum(sized, ["owner"], ["pos"], F.col("length"), "offset")
    return lengths, offsets.select("owner", "pos", "child", "kind", "offset", "length")


def flatten_leaves(
    offsets: DataFrame, roots: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """``(root, path, offset)``: every primitive below ``roots(owner)`` with its flat offset.

    ``path`` is the list of field positions.  An empty record is a primitive of its own.  Takes the
    offsets of ``flatten_offsets``.
    """
    scratch = Scratch(offsets.sparkSession, "leaves")
    facts = scratch.save(offsets.select("owner", "pos", "child", "offset"), "f").df
    path = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")
    front = scratch.save(
        roots.select(
            F.col("owner").alias("root"),
            F.col("owner").alias("node"),
            path.alias("path"),
            zero.alias("offset"),
        ),
        "n",
    )
    done: list[str] = []
    like = front.df.select("root", "path", "offset")
    # whether a child is a record is looked up once; a primitive has none, and nulls would all meet in one task
    records = facts.select(F.col("owner").alias("child")).distinct().withColumn("_more", F.lit(True))
    named = join_summary(facts.filter("child IS NOT NULL"), records, ["child"])
    named = named.unionByName(facts.filter("child IS NULL").withColumn("_more", F.lit(None).cast("boolean")))
    step = named.select("owner", "pos", "child", F.col("offset").alias("_add"), F.coalesce("_more", F.lit(False)).alias("_more"))
    step = scratch.put(step, "s").df
    for _ in range(max_rounds):
        if not front.rows:
            break
        opened = scratch.put(
            front.df.join(step, F.col("node") == F.col("owner")).select(
                "root",
                F.col("child").alias("node"),
                F.concat("path", F.array(F.col("pos").cast("bigint"))).alias("path"),
                (F.col("offset") + F.col("_add")).alias("offset"),
                "_more",
            ),
            "o",
        ).df
        leaves = scratch.save(opened.filter("NOT _more").select("root", "path", "offset"), "l")
        if leaves.rows:
            done.append(leaves.path)
        front = scratch.save(opened.filter("_more").drop("_more"), "n")
    else:
        raise NotConverged(f"records are nested deeper than {max_rounds}")
    return scratch.read(done, like) if done else like.filter(F.lit(False))


def range_of(df: DataFrame, owner: str, pos: str, offset: str) -> DataFrame:
    """Range i of an owner is ``[offset i, offset i+1)``; the last offset only closes a range."""
    following = next_value(df, [owner], [pos], F.col(offset), "end")
    return following.filter(F.col("end").isNotNull()).withColumnRenamed(offset, "start")


def first_wins_propagation(
    defs: DataFrame,
    copies: DataFrame,
    blocked: DataFrame,
    *,
    result: int = 0,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """``(scope, var, grp, t)``: copies applied in time order, the first one to hit wins.

    ``defs(scope, var)`` start in their own group at time -1; ``copies(scope, t, dst, src)`` give
    ``dst`` the group that ``src`` has by then, unless ``dst`` already has one, is in
    ``blocked(scope, var)``, or is the result variable.  ``t`` is unique in a scope and not negative.
    """
    spark = defs.sparkSession
    keys = ["scope", "var"]
    arcs = copies.filter(F.col("dst") != result).select(
        "scope", F.col("dst").alias("var"), F.col("src").alias("_src"), F.col("t").alias("_t")
    )
    barred = blocked.select(*keys).unionByName(defs.select(*keys)).distinct()
    arcs = Scratch(spark, "copies").save(arcs.join(barred, keys, "left_anti"), "c").df
    start = defs.select(
        *keys, F.col("var").alias("grp"), F.lit(-1).cast("bigint").alias("t")
    ).distinct()

    def step(changed: DataFrame) -> DataFrame:
        from_ = changed.select("scope", F.col("var").alias("_src"), "grp", "t")
        usable = arcs.join(from_, ["scope", "_src"]).filter("_t > t")
        best = usable.groupBy(*keys).agg(F.min(F.struct("_t", "grp")).alias("_m"))
        return best.select(*keys, F.col("_m._t").alias("_t"), F.col("_m.grp").alias("_grp"))

    def merge(state: DataFrame, offers: DataFrame) -> DataFrame:
        better = F.col("_t").isNotNull() & (
            F.col("t").isNull()
            | (F.col("_t") < F.col("t"))
            # same copy, but its source was found to belong elsewhere
            | ((F.col("_t") == F.col("t")) & (F.col("_grp") != F.col("grp")))
        )
        return state.join(offers, keys, "full").select(
            *keys,
            F.when(better, F.col("_grp")).otherwise(F.col("grp")).alias("grp"),
            F.when(better, F.col("_t")).otherwise(F.col("t")).alias("t"),
            better.alias("changed"),
        )

    return relax(start, step, merge, keys=keys, name="first-wins", max_rounds=max_rounds)


def dead_writes(
    log: DataFrame,
    key: list[str],
    order: list[str],
    *,
    is_write: Column,
    excluded: DataFrame | None = None,
    owner: str | None = None,
) -> DataFrame:
    """Writes that no read of the key follows before the next write or the end.

    Every row of ``log`` is a write or a read.  Owners in ``excluded`` are skipped.
    """
    rows = log if excluded is None else log.join(excluded.select(owner), owner, "left_anti")
    marked = rows.withColumn("_write", is_write)
    following = next_value(marked, key, order, F.col("_write"), "_next")
    dead = F.col("_write") & F.coalesce("_next", F.lit(True))
    return following.filter(dead).drop("_write", "_next")


def rank_order(df: DataFrame, score: str, ties: list[str], out: str = "place") -> DataFrame:
    """The place of every row in descending order of ``score``; ties by the given columns."""
    return global_row_number(df, [F.col(score).desc(), *ties], out)
