"""J7 and N5 over branching flow graphs: edges ``(src, dst)`` between blocks, rows in order inside a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.plans.loop import DEFAULT_MAX_ROUNDS, grow
from factlake.plans.scratch import Scratch
from factlake.plans.skew import next_value


def dead_writes_flow(
    log: DataFrame,
    edges: DataFrame,
    *,
    block: str,
    key: list[str],
    order: list[str],
    is_write: Column,
    excluded: DataFrame | None = None,
    owner: str | None = None,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """Writes that no read of the key follows on any path before the next write or the end.

    Every row of ``log`` is a write or a read.  A block whose first row of a key is a read needs the key on entry; the
    need goes back over the edges up to blocks that write the key first.  Inside a block the next row decides, and
    a key's last write in a block is dead if no following block needs the key.  Without edges this is
    ``dead_writes`` by block and key.  Rows without block or key are left out; owners in ``excluded`` are skipped.
    The state is one row for each block and key needed there.
    """
    rows = log if excluded is None else log.join(excluded.select(owner), owner, "left_anti")
    keys = [block, *key]
    marked = rows.dropna(subset=keys).withColumn("_write", is_write)
    scratch = Scratch(log.sparkSession, "dead-writes")
    heads = marked.groupBy(*keys).agg(F.min_by("_write", F.struct(*order)).alias("_first"))
    heads = scratch.put(heads, "h").df
    arcs = scratch.put(edges.select(F.col("src").alias("_to"), F.col("dst").alias(block)).distinct(), "e").df
    written = heads.filter("_first").select(*keys)

    def before(rows: DataFrame) -> DataFrame:
        return rows.join(arcs, block).select(F.col("_to").alias(block), *key)

    needed = grow(
        heads.filter(~F.col("_first")).select(*keys),
        lambda delta: before(delta).join(written, keys, "left_anti"),
        name="needed",
        max_rounds=max_rounds,
    )
    after = before(needed).distinct()
    following = next_value(marked, keys, order, F.col("_write"), "_next").filter("_write")
    inside = following.filter("_next")
    last = following.filter(F.col("_next").isNull()).join(after, keys, "left_anti")
    return inside.unionByName(last).drop("_write", "_next").select(*rows.columns)


def dominators(
    edges: DataFrame,
    entries: DataFrame,
    among: DataFrame | None = None,
    *,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """``(entry, dom, node)``: every path from ``entry`` to ``node`` passes ``dom``, another node.

    ``entries(id)`` starts one flow graph each; nodes that no entry reaches have no dominators.  ``among(id)`` names the
    nodes to consider as dominators.  The nodes reached around each of them are found by one loop for all; so
    the work and the state are at most the considered nodes times the nodes of the same flow graph: quadratic
    in one function without ``among``, but never across functions.
    """
    scratch = Scratch(edges.sparkSession, "dominators")
    arcs = scratch.put(edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct(), "e").df

    def ahead(rows: DataFrame) -> DataFrame:
        return rows.join(arcs, "node").select(*[F.col("_to" if c == "node" else c).alias(c) for c in rows.columns])

    start = entries.select(F.col("id").alias("entry"), F.col("id").alias("node"))
    reached = scratch.put(grow(start, ahead, name="flow", max_rounds=max_rounds), "r").df
    doms = reached.select("entry", F.col("node").alias("dom"))
    if among is not None:
        doms = doms.join(among.select(F.col("id").alias("dom")), "dom", "left_semi").select("entry", "dom")
    doms = scratch.put(doms, "d").df
    around = grow(
        doms.filter("dom <> entry").withColumn("node", F.col("entry")),
        lambda delta: ahead(delta).filter("node <> dom"),
        name="around",
        max_rounds=max_rounds,
    )
    pairs = doms.join(reached, "entry").filter("node <> dom")
    return pairs.join(around, ["entry", "dom", "node"], "left_anti").select("entry", "dom", "node")


def immediate_dominators(edges: DataFrame, entries: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS) -> DataFrame:
    """``(entry, node, idom)`` for every node but the entry that is reached."""
    return _nearest(Scratch(edges.sparkSession, "idom"), dominators(edges, entries, max_rounds=max_rounds)).withColumnRenamed("dom", "idom")


def _nearest(scratch: Scratch, doms: DataFrame) -> DataFrame:
    """Of a node's dominators, which lie on one chain, the one that most of them dominate."""
    doms = scratch.put(doms, "n").df
    depth = doms.groupBy("entry", F.col("node").alias("dom")).agg(F.count("*").alias("_depth"))
    ranked = doms.join(depth, ["entry", "dom"], "left").withColumn("_depth", F.coalesce("_depth", F.lit(0)))
    return ranked.groupBy("entry", "node").agg(F.max_by("dom", "_depth").alias("dom"))


def dominating_source(
    checks: DataFrame,
    sources: DataFrame,
    edges: DataFrame,
    entries: DataFrame,
    *,
    order: list[str] | None = None,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """J7 over a flow graph: ``(entry, id, source_id)`` for each check that a source precedes on every path.

    ``checks(id, block)`` and ``sources(id, block)`` stand in blocks.  A check takes the nearest block above its own, up the
    chain of dominators, that has a source, and there the last one by ``order`` (by id if not given).  Its own
    block is not looked at; a check without such a block is dropped.  Only blocks with sources are considered
    as dominators.
    """
    scratch = Scratch(edges.sparkSession, "dominating")
    by = F.struct(*(order or ["id"]))
    last = scratch.put(sources.groupBy("block").agg(F.max_by("id", by).alias("source_id")), "s").df
    found = dominators(edges, entries, last.select(F.col("block").alias("id")), max_rounds=max_rounds)
    nearest = _nearest(scratch, found).join(last.withColumnRenamed("block", "dom"), "dom")
    return checks.select("id", F.col("block").alias("node")).join(nearest, "node").select("entry", "id", "source_id")
