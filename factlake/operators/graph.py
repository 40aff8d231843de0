"""Graph operators (G1-G17, J2): edges ``(src, dst)``, nodes ``(id)``.

Every loop is a bounded driver loop over DataFrames (see ``factlake.plans.loop``): each round is one
join on the rows that changed, so its cost follows the new facts and not the whole state.  Nodes are
a table of their own because an isolated node has no edge.  Full closures are built only by
``transitive_closure``; the other operators keep one or two values for each node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.aggs import wide_bit, wide_union, zero_mask
from factlake.operators.checks import assert_edges_closed
from factlake.plans.contract import Contraction, contract_all, no_values
from factlake.plans.loop import DEFAULT_MAX_ROUNDS, NotConverged, follow, grow, relax, spread
from factlake.plans.near import forest, on_cycles
from factlake.plans.scratch import Scratch
from factlake.plans.skew import (
    attach_group,
    global_row_number,
    join_summary,
    running_sum,
)


#: Rounds in which a shallow graph is done; only a deeper one is worth contracting.
_SHALLOW = 4


def _stored(edges: DataFrame, name: str) -> DataFrame:
    """Distinct edges, written once so that no round computes them again."""
    distinct = edges.select("src", "dst").distinct()
    return Scratch(edges.sparkSession, f"{name}-edges").save(distinct, "e").df


def swap(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def inverse(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G1: ``(id, pred)`` for every node; ``pred`` is null for a node nothing points to."""
    assert_edges_closed(edges, nodes)
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("pred")).distinct()
    return nodes.select("id").distinct().join(back, "id", "left")


def reachable(
    edges: DataFrame, seeds: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """Ids reachable from ``seeds(id)``, the seeds included."""
    return _reach(_stored(edges, "reach"), seeds, max_rounds)


def _reach(arcs: DataFrame, seeds: DataFrame, max_rounds: int) -> DataFrame:
    return grow(
        seeds.select("id"), lambda delta: follow(delta, arcs, "id"), name="reach", max_rounds=max_rounds
    )


def split_by_closure(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(reached, rest)`` — an exact partition of ``nodes`` by reachability from ``seeds``."""
    hit = reachable(edges, seeds)
    return nodes.join(hit, "id", "left_semi"), nodes.join(hit, "id", "left_anti")


def transitive_closure(
    edges: DataFrame,
    sources: DataFrame | None = None,
    *,
    nodes: DataFrame | None = None,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """Pairs ``(src, dst)`` joined by a path of at least one edge; ``(v, v)`` only on a cycle.

    With ``nodes(id)`` every edge must end in one of them (``CheckFailed`` otherwise).  The closure is taken of the
    components, which have no cycles, and expanded to their members at the end.  The result can be quadratic
    in the nodes: give ``sources(id)`` to bound it.
    """
    if nodes is not None:
        assert_edges_closed(edges, nodes)
    scratch = Scratch(edges.sparkSession, "closure")
    # as found: edges that stand together are settled together
    arcs = scratch.put(edges.select("src", "dst"), "e").df
    ends = arcs.select(F.col("src").alias("id")).unionByName(arcs.select(F.col("dst").alias("id"))).distinct()
    comp = scratch.save(strong_components(arcs, ends, max_rounds=max_rounds), "c").df
    from_ = comp if sources is None else comp.join(sources.select(F.col("id").alias("node")), "node", "left_semi")
    dag = scratch.save(condense(arcs, comp), "d").df
    start = dag.join(from_.select(F.col("comp").alias("src")), "src", "left_semi").select("src", "dst")
    pairs = grow(start, lambda delta: follow(delta, dag, "dst"), name="closure", max_rounds=max_rounds)
    # a component reaches itself if it has a cycle: more than one member, or an edge from a node to itself
    many = comp.filter("node <> comp").select("comp")
    loops = arcs.filter("src = dst").select(F.col("src").alias("comp"))
    cyclic = many.unionByName(loops).distinct().select(F.col("comp").alias("src"), F.col("comp").alias("dst"))
    heads = from_.select(F.col("comp").alias("src"), F.col("node").alias("_from"))
    tails = comp.select(F.col("comp").alias("dst"), F.col("node").alias("_to"))
    every = pairs.unionByName(cyclic).join(heads, "src").join(tails, "dst")
    return every.select(F.col("_from").alias("src"), F.col("_to").alias("dst"))


def reflexive_closure(
    edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None
) -> DataFrame:
    """The transitive closure and ``(v, v)`` for every node (every source when given); edges end in ``nodes``."""
    own = (nodes if sources is None else sources).select(
        F.col("id").alias("src"), F.col("id").alias("dst")
    )
    return transitive_closure(edges, sources, nodes=nodes).unionByName(own).distinct()


def strong_components(
    edges: DataFrame, nodes: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """``(node, comp)`` with ``comp`` the smallest member; singletons included.

    Cycles that stand together are contracted first: each task looks among the edges it reads (``plans.near``), and what several
    tasks found of a node is joined.  Edges that cannot lie on a cycle are trimmed: nothing enters their source or nothing leaves their target.  Then
    each node takes the largest id that reaches it and the largest that it reaches: where both are the
    same, the node is in the component of that id.  Edges between nodes that differ in either are never
    part of a component; what is left goes round again.  Where that takes more than a few rounds, chains are
    first contracted to single edges (``plans.contract``), so a long path or ring takes few; inner nodes of a
    chain are in the component of its ends if these are in one.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    plain = scratch.put(edges.select("src", "dst").filter(F.col("src") != F.col("dst")), "a").df
    near = on_cycles(plain)
    if near is not None:
        near = _stars(near, max_rounds).select(F.col("high").alias("node"), F.col("low").alias("_near"))
        for end in ("src", "dst"):
            plain = plain.join(near.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("_near", end)).drop("_near")
        plain = plain.select("src", "dst").filter(F.col("src") != F.col("dst"))
    arcs = scratch.save(plain.distinct().withColumn("steps", F.lit(1).cast("bigint")), "e")
    none = no_values(nodes)
    passes: list[Contraction] = []
    ids = nodes.select(F.col("id").alias("node"), F.col("id").alias("comp"))
    found = [ids.limit(0)]
    for _ in range(max_rounds):
        before = None
        # as long as it takes off a tenth
        while arcs.rows and (before is None or 10 * arcs.rows < 9 * before):
            before, arcs = arcs.rows, scratch.save(_trimmed(_trimmed(arcs.df)), "e")
        if not arcs.rows:
            break
        try:
            colours = _colours(arcs.df, min(_SHALLOW, max_rounds))
        except NotConverged:
            arcs, _, contracted = contract_all(scratch, arcs, none)
            passes += contracted
            found += [c.rings.select(F.col("id").alias("node"), F.col("least").alias("comp")) for c in contracted]
            if not arcs.rows:
                break
            colours = _colours(arcs.df, max_rounds)
        found.append(colours.filter("above = below").select(F.col("id").alias("node"), F.col("above").alias("comp")))
        open_ = colours.filter("above <> below")
        src, dst = (open_.select(F.col("id").alias(c), "above", "below") for c in ("src", "dst"))
        arcs = scratch.save(arcs.df.join(src, "src").join(dst, ["dst", "above", "below"]).select("src", "dst", "steps"), "e")
    if arcs.rows:
        raise NotConverged(f"strong components: edges left after {max_rounds} rounds")
    label = reduce(DataFrame.unionByName, found)
    for c in reversed(passes):
        label = scratch.put(label, "l").df
        head = label.select(F.col("node").alias("head"), F.col("comp").alias("_head"))
        tail = label.select(F.col("node").alias("tail"), F.col("comp").alias("_tail"))
        ends = c.inner.select("id", "tail", "last").join(c.heads, "last").join(head, "head", "left").join(tail, "tail", "left")
        ends = ends.select("id", F.coalesce("_head", "head").alias("_a"), F.coalesce("_tail", "tail").alias("_b"))
        label = label.unionByName(ends.filter("_a = _b").select(F.col("id").alias("node"), F.col("_a").alias("comp")))
    # members of a cycle get their smallest member, everything else is alone
    every = nodes.select(F.col("id").alias("node")).distinct().withColumn("_near", F.col("node"))
    if near is not None:
        every = every.drop("_near").join(near, "node", "left").select("node", F.coalesce("_near", "node").alias("_near"))
    label = label.select(F.col("node").alias("_near"), F.col("comp").alias("_comp"))
    every = every.join(label, "_near", "left").select("node", F.coalesce("_comp", "_near").alias("_comp"))
    return attach_group(scratch.put(every, "r").df, ["_comp"], F.min("node").alias("comp")).select("node", "comp")


def _colours(arcs: DataFrame, max_rounds: int) -> DataFrame:
    """``(id, above, below)``: the largest id that reaches each node and the largest that it reaches."""
    ids = arcs.select(F.col("src").alias("id")).unionByName(arcs.select(F.col("dst").alias("id"))).distinct()
    own = ids.select("id", F.col("id").alias("above"), F.col("id").alias("below"))
    return spread(own, arcs, [], ["above", "below"], back=["below"], name="colour", max_rounds=max_rounds)


def _trimmed(arcs: DataFrame) -> DataFrame:
    """Edges whose source is entered and whose target is left."""
    entered = arcs.select(F.col("dst").alias("src"))
    left = arcs.select(F.col("src").alias("dst"))
    return arcs.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst", "steps")


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    src, dst = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst")


def condense(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """The distinct edges between different components."""
    src = comp.select(F.col("node").alias("src"), F.col("comp").alias("_from"))
    dst = comp.select(F.col("node").alias("dst"), F.col("comp").alias("_to"))
    return (
        edges.select("src", "dst")
        .join(src, "src")
        .join(dst, "dst")
        .filter("_from <> _to")
        .select(F.col("_from").alias("src"), F.col("_to").alias("dst"))
        .distinct()
    )


def sink_levels(
    comp_edges: DataFrame, nodes: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """``(id, level)``: the longest distance to a node without successors.  Needs an acyclic graph.

    In a deep graph chains are contracted first; their nodes have the level of the chain's end and their distance to it.
    """
    scratch = Scratch(comp_edges.sparkSession, "levels")
    once = scratch.save(comp_edges.select("src", "dst").distinct().withColumn("steps", F.lit(1).cast("bigint")), "e")
    ids = nodes.select("id").distinct()
    try:
        return _levels(ids, once.df, min(_SHALLOW, max_rounds))
    except NotConverged:
        arcs, _, passes = contract_all(scratch, once, no_values(nodes))
    for c in passes:
        if not c.rings.isEmpty():
            raise ValueError("levels need a graph without cycles")
        ids = ids.join(c.inner.select("id"), "id", "left_anti")
    levels = _levels(ids, arcs.df, max_rounds)
    for c in reversed(passes):
        ends = c.inner.select("id", F.col("tail"), "steps").join(levels.select(F.col("id").alias("tail"), "level"), "tail")
        levels = scratch.put(levels.unionByName(ends.select("id", (F.col("level") + F.col("steps")).alias("level"))), "l").df
    return levels


def _levels(ids: DataFrame, arcs: DataFrame, max_rounds: int) -> DataFrame:
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "steps")
    start = ids.withColumn("level", F.lit(0).cast("bigint"))
    return spread(start, back, [], ["level"], name="levels", add="steps", max_rounds=max_rounds)


def post_order(
    comp_edges: DataFrame, nodes: DataFrame, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """``(id, level, position)``; every successor has a smaller position."""
    levels = sink_levels(comp_edges, nodes, max_rounds=max_rounds)
    return global_row_number(levels, ["level", "id"], "position")


def connected_components(
    edges: DataFrame, nodes: DataFrame, *, max_rounds: int = 1_000
) -> DataFrame:
    """``(node, comp)`` of the undirected graph, ``comp`` the smallest member.

    Large-star / small-star contraction, after each task has made stars of the edges it reads: the number of rounds
    grows with the logarithm of the component size.  Ends when the edges are stars, which is checked exactly.
    """
    stars = _stars(edges, max_rounds)
    label = stars.select(F.col("high").alias("node"), F.col("low").alias("comp"))
    return (
        nodes.select(F.col("id").alias("node"))
        .distinct()
        .join(label, "node", "left")
        .select("node", F.coalesce("comp", "node").alias("comp"))
    )


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``(high, low)``: each node that is not the smallest member of its component, and that member."""
    scratch = Scratch(edges.sparkSession, "cc")
    pairs = edges.filter(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")
    )
    stars = scratch.save(forest(pairs).distinct(), "s")
    settled = _is_stars(stars.df)
    for _ in range(max_rounds):
        if settled:
            break
        # neither star has more edges than it was given
        wide = scratch.save(_large_star(stars.df), "l")
        narrow = scratch.save(_small_star(wide.df), "s")
        scratch.drop(stars.path)
        scratch.drop(wide.path)
        # a round that keeps the number of edges may be the last: only then it is worth a look
        settled = narrow.rows == stars.rows and _is_stars(narrow.df)
        stars = narrow
    else:
        raise NotConverged(f"connected components: no fixpoint after {max_rounds} rounds")
    return stars.df


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node around it."""
    ends = pairs.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
        pairs.select(F.col("low").alias("u"), F.col("high").alias("v"))
    )
    least = ends.groupBy(F.col("u").alias("low")).agg(F.min("v").alias("_m"))
    joined = join_summary(pairs, least, ["low"], "inner")
    return joined.select("high", F.least("low", "_m").alias("low")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = pairs.groupBy("high").agg(F.min("low").alias("_m"))
    joined = join_summary(pairs, least, ["high"], "inner")
    moved = joined.filter("low <> _m").select(F.col("low").alias("high"), F.col("_m").alias("low"))
    return moved.unionByName(least.select("high", F.col("_m").alias("low"))).distinct()


def _is_stars(pairs: DataFrame) -> bool:
    """No node is both a centre and a leaf, and no leaf has two centres."""
    roles = pairs.groupBy(F.col("high").alias("id")).agg(F.count(F.lit(1)).alias("leaf"))
    roles = roles.withColumn("centre", F.lit(0)).unionByName(
        pairs.select(F.col("low").alias("id")).distinct().select(
            "id", F.lit(0).cast("bigint").alias("leaf"), F.lit(1).alias("centre")
        )
    )
    totals = roles.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return totals.filter("leaf > 1 OR (leaf = 1 AND centre = 1)").isEmpty()


def find(comp: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, comp)`` for each asked id; null when the id is unknown."""
    known = comp.select(F.col("node").alias("id"), "comp")
    return ids.select("id").join(known, "id", "left")


def equiv(comp: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, equiv)`` for each asked pair; null when either id is unknown."""
    left = comp.select(F.col("node").alias("a"), F.col("comp").alias("_a"))
    right = comp.select(F.col("node").alias("b"), F.col("comp").alias("_b"))
    joined = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left")
    return joined.select("a", "b", (F.col("_a") == F.col("_b")).alias("equiv"))


def component_members(comp: DataFrame) -> DataFrame:
    """``(comp, member, size)`` in long form, so that no component is gathered into one row."""
    sized = attach_group(comp, ["comp"], F.count(F.lit(1)).alias("size"))
    return sized.select("comp", F.col("node").alias("member"), "size")


def propagate_labels(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    max_hops: int | None = None,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """``(node, label)`` for every node reachable from a seed of that label, seeds included."""
    arcs = _stored(edges, "labels")
    return grow(
        seeds.select("node", "label"),
        lambda delta: follow(delta, arcs, "node"),
        name="labels",
        max_rounds=max_rounds,
        hops=max_hops,
    )


def propagate_blocked(
    edges: DataFrame,
    gen: DataFrame,
    kill: DataFrame | None = None,
    require: DataFrame | None = None,
    *,
    direction: str = "forward",
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """The ``(node, label)`` facts that hold on entry to each node.

    A node passes on ``((in ∩ require) − kill) ∪ gen`` and takes the union over its predecessors
    (its successors when ``direction`` is ``backward``).  ``gen``, ``kill`` and ``require`` are
    ``(node, label)`` tables; a missing ``require`` asks for nothing.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be forward or backward, not {direction!r}")
    if direction == "backward" and require is not None:
        raise ValueError("the backward form has no require table")
    arcs = _stored(edges if direction == "forward" else swap(edges), "blocked")
    keys = ["node", "label"]

    def step(delta: DataFrame) -> DataFrame:
        kept = delta if require is None else delta.join(require.select(*keys), keys, "left_semi")
        kept = kept if kill is None else kept.join(kill.select(*keys), keys, "left_anti")
        return follow(kept, arcs, "node")

    start = follow(gen.select(*keys), arcs, "node").select(*keys)
    return grow(start, step, name="blocked", max_rounds=max_rounds)


def propagate_blocked_masks(
    edges: DataFrame,
    gen: DataFrame,
    kill: DataFrame | None = None,
    require: DataFrame | None = None,
    *,
    width: int,
    direction: str = "forward",
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """G11 with one row for each node: ``(node, mask)``, the labels on entry as a wide mask (A4).

    Tables are those of ``propagate_blocked`` with labels from 0 to ``width - 1``; another label is an error.  Nodes without any
    label are left out.  A round sends one mask an edge instead of one row a label.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be forward or backward, not {direction!r}")
    if direction == "backward" and require is not None:
        raise ValueError("the backward form has no require table")
    scratch = Scratch(edges.sparkSession, "blocked-masks")
    arcs = scratch.put((edges if direction == "forward" else swap(edges)).select("src", "dst").distinct(), "e").df
    none, every = zero_mask(width), F.array(*[F.lit(-1).cast("bigint")] * (-(-width // 64)))

    def masks(facts: DataFrame, out: str) -> DataFrame:
        inside = (F.col("label") >= 0) & (F.col("label") < width)
        label = F.when(inside, wide_bit(F.col("label"), width)).otherwise(F.raise_error(F.lit("label outside the mask")))
        return facts.groupBy("node").agg(wide_union(label, width).alias(out))

    ids = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    own = ids.join(masks(gen, "_gen"), "node", "left")
    own = own.withColumn("_kill", none) if kill is None else own.join(masks(kill, "_kill"), "node", "left")
    own = own.withColumn("_need", every) if require is None else own.join(masks(require, "_need"), "node", "left")
    passes = F.zip_with(F.coalesce("_need", none), F.coalesce("_kill", none), lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    own = scratch.put(own.select("node", F.coalesce("_gen", none).alias("_gen"), passes.alias("_pass")), "o").df

    def step(changed: DataFrame) -> DataFrame:
        kept = F.zip_with("mask", "_pass", lambda x, y: x.bitwiseAND(y))
        out = F.zip_with(kept, "_gen", lambda x, y: x.bitwiseOR(y))
        sent = changed.join(own, "node").select("node", out.alias("mask")).filter(F.col("mask") != none)
        return follow(sent, arcs, "node").groupBy("node").agg(wide_union(F.col("mask"), width).alias("_mask"))

    def merge(state: DataFrame, offers: DataFrame) -> DataFrame:
        more = F.zip_with("mask", F.coalesce("_mask", none), lambda x, y: x.bitwiseOR(y))
        both = state.join(offers, "node", "left").select("node", "mask", more.alias("_more"))
        return both.select("node", F.col("_more").alias("mask"), (F.col("_more") != F.col("mask")).alias("changed"))

    final = relax(own.select("node", none.alias("mask")), step, merge, keys=["node"], name="blocked-masks", max_rounds=max_rounds)
    return final.filter(F.col("mask") != none)


def taint(
    edges: DataFrame, variables: DataFrame, bottoms: DataFrame, tops: DataFrame
) -> DataFrame:
    """Greatest model ``(id, value)`` of guard→guarded constraints.

    A variable is false iff a bottom reaches it.  If a top is reached everything is false.
    """
    false = reachable(edges, bottoms)
    if not tops.select("id").join(false, "id", "left_semi").isEmpty():
        return variables.select("id", F.lit(False).alias("value"))
    marked = variables.select("id").join(false.withColumn("_false", F.lit(True)), "id", "left")
    return marked.select("id", F.col("_false").isNull().alias("value"))


def reverse_taint(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids that reach a seed (callers of a flagged node, transitively), seeds included."""
    return reachable(swap(edges), seeds)


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no root reaches; roots survive."""
    return nodes.join(reachable(edges, roots), "id", "left_anti")


def prune_unreachable(
    nodes: DataFrame, edges: DataFrame, roots: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The nodes that roots reach and the edges between them."""
    hit = reachable(edges, roots)
    return nodes.join(hit, "id", "left_semi"), _between(edges, hit)


def lineage_producers(
    copies: DataFrame,
    calls: DataFrame,
    seeds: DataFrame,
    excluded: DataFrame,
    *,
    result: int = 0,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """Owners whose result comes from a seed or from another producer (least fixpoint).

    ``copies(owner, dst, src)``, ``calls(owner, dst, callee)``, ``seeds(owner, dst)``; locals in
    ``excluded(owner, local)`` take no value at all, which cuts every path through them.
    """
    scratch = Scratch(copies.sparkSession, "producers")
    cut = excluded.select("owner", F.col("local").alias("dst")).distinct()
    flows = copies.select("owner", "dst", F.col("owner").alias("from_owner"), "src").unionByName(
        calls.select(
            "owner", "dst", F.col("callee").alias("from_owner"), F.lit(result).cast("bigint").alias("src")
        )
    )
    arcs = scratch.save(flows.distinct().join(cut, ["owner", "dst"], "left_anti"), "e").df.select(
        F.col("owner").alias("_owner"), "dst", F.col("from_owner").alias("owner"), F.col("src").alias("local")
    )
    start = seeds.select("owner", "dst").join(cut, ["owner", "dst"], "left_anti")

    def step(delta: DataFrame) -> DataFrame:
        moved = delta.join(arcs, ["owner", "local"])
        return moved.select(F.col("_owner").alias("owner"), F.col("dst").alias("local"))

    facts = grow(
        start.select("owner", F.col("dst").alias("local")),
        step,
        name="producers",
        max_rounds=max_rounds,
    )
    return facts.filter(F.col("local") == result).select("owner").distinct()


def reach_summary(
    edges: DataFrame,
    nodes: DataFrame,
    labels: DataFrame,
    *,
    max_rounds: int = DEFAULT_MAX_ROUNDS,
) -> DataFrame:
    """``(id, state, value)``: the meet of the labels on a node and on all it reaches.

    No label gives ``top``, one distinct label ``elem``, several ``bottom``.  Only the smallest and
    the largest label travel, so the state is two values for each node however many labels exist; in a deep
    graph chains are contracted first, with the extremes of what stands on them.
    """
    scratch = Scratch(edges.sparkSession, "summary")
    own = scratch.put(labels.groupBy("id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "o").df
    once = edges.select("src", "dst").filter("src <> dst").distinct().withColumn("steps", F.lit(1).cast("bigint"))
    once = scratch.save(once, "e")
    ids = nodes.select("id").distinct()

    def solve(ids: DataFrame, own: DataFrame, arcs: DataFrame, rounds: int) -> DataFrame:
        return spread(ids.join(own, "id", "left"), swap(arcs), ["lo"], ["hi"], name="summary", max_rounds=rounds)

    try:
        final = solve(ids, own, once.df, min(_SHALLOW, max_rounds))
    except NotConverged:
        arcs, own, passes = contract_all(scratch, once, own)
        # what stands on chains and rings takes its value from their ends at last
        for c in passes:
            ids = ids.join(c.inner.select("id").unionByName(c.rings.select("id")), "id", "left_anti")
        final = solve(ids, own, arcs.df, max_rounds)
        for c in reversed(passes):
            ends = c.inner.join(final.select(F.col("id").alias("tail"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "tail", "left")
            ends = ends.select("id", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"))
            final = scratch.put(final.unionByName(ends).unionByName(c.rings.select("id", "lo", "hi")), "f").df
    # edges may end in nodes that are not asked for
    final = final.join(nodes.select("id").distinct(), "id", "left_semi")
    state = F.when(F.col("lo").isNull(), "top").when(F.col("lo") == F.col("hi"), "elem")
    return final.select(
        "id",
        state.otherwise("bottom").alias("state"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"),
    )


def expand_dependencies(
    deps: DataFrame, roots: DataFrame, is_leaf: Column, *, max_depth: int = 1_000
) -> DataFrame:
    """``(root, leaf, path, number)``: leaves depth first and left to right, from 0 per root.

    ``deps(parent, pos, child)`` lists children in order, ``roots(node)`` are the starts and
    ``is_leaf`` is a predicate over column ``node``.  A leaf reached twice appears twice.  The path
    is the list of positions from the root.  A cycle is reported once ``max_depth`` is passed.
    Where the predicate is null, as for a null child, the node is a leaf.
    """
    is_leaf = F.coalesce(is_leaf, F.lit(True))
    scratch = Scratch(deps.sparkSession, "expand")
    # in order, so that names that begin alike stand together and pack well
    arcs = scratch.put(
        deps.select(F.col("parent").alias("node"), "pos", "child").distinct().sortWithinPartitions("node", "pos"), "e"
    )
    begin = F.array().cast("array<bigint>")
    frontier = scratch.save(
        roots.select(F.col("node").alias("root"), "node", begin.alias("path")), "f"
    )
    leaves: list[str] = []
    like = frontier.df
    for _ in range(max_depth):
        hits = frontier.df.filter(is_leaf)
        found = hits.count()
        if found == frontier.rows:
            # nothing but leaves: they stay where they are
            leaves.append(frontier.path)
            break
        if found:
            leaves.append(scratch.put(hits, "l").path)
        inner = frontier.df.filter(~is_leaf)
        missing = scratch.some(inner.join(arcs.df, "node", "left_anti"))
        if missing:
            raise ValueError(f"no dependencies for {[r['node'] for r in missing]}")
        longer = F.concat("path", F.array(F.col("pos").cast("bigint")))
        done = frontier.path
        frontier = scratch.save(
            inner.join(arcs.df, "node").select(
                "root", F.col("child").alias("node"), longer.alias("path")
            ),
            "f",
        )
        scratch.drop(done)
    else:
        raise NotConverged(f"dependencies are deeper than {max_depth}: is there a cycle?")
    scratch.drop(arcs.path)
    visits = scratch.read(leaves, like)
    numbered = running_sum(visits, ["root"], ["path"], F.lit(1), "number")
    return numbered.select("root", F.col("node").alias("leaf"), "path", F.col("number").cast("bigint"))


def leaf_numbers(expanded: DataFrame) -> DataFrame:
    """The number each leaf keeps: that of its last visit."""
    return expanded.groupBy("root", "leaf").agg(F.max("number").alias("number"))


def leaf_counts(
    deps: DataFrame, roots: DataFrame, is_leaf: Column, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """``(node, leaves)``: how many leaves each inner node below ``roots`` expands to, repeated visits included.

    Arguments as for ``expand_dependencies``.  Counts go up from the leaves, so a shared node is counted once however often it
    is visited.  Nodes on a cycle never get a count, which is reported; a count beyond a bigint is an error.
    """
    return _counted(deps, roots, is_leaf, max_rounds)[1]


def _counted(deps: DataFrame, roots: DataFrame, is_leaf: Column, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The arcs ``(node, pos, child, leaf)`` below the roots and the counts of inner nodes."""
    scratch = Scratch(deps.sparkSession, "leaves")
    is_leaf = F.coalesce(is_leaf, F.lit(True))
    named = deps.select(F.col("parent").alias("_parent"), "pos", F.col("child").alias("node")).distinct()
    every = scratch.put(
        named.select(F.col("_parent").alias("node"), "pos", F.col("node").alias("child"), is_leaf.alias("leaf")), "e"
    ).df
    inner = every.filter("NOT leaf").select("node", "child")
    start = roots.select("node").distinct().filter(~is_leaf)
    used = grow(
        start, lambda delta: delta.join(inner, "node").select(F.col("child").alias("node")), name="below", max_rounds=max_rounds
    )
    used = scratch.put(used, "u").df
    missing = used.join(every, "node", "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"no dependencies for {[r['node'] for r in missing]}")
    arcs = scratch.put(every.join(used, "node", "left_semi"), "a").df
    up = arcs.filter("NOT leaf").select(F.col("child").alias("node"), F.col("node").alias("_parent"))
    state = arcs.groupBy("node").agg(
        F.count_if(~F.col("leaf")).alias("open"), F.count_if("leaf").alias("leaves")
    )

    def step(changed: DataFrame) -> DataFrame:
        # a node sends its count once: when the last of its children is counted
        sent = changed.filter("open = 0").join(up, "node")
        return sent.groupBy(F.col("_parent").alias("node")).agg(F.count("*").alias("_got"), F.sum("leaves").alias("_more"))

    def merge(rows: DataFrame, offers: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return rows.join(offers, "node", "left").select(
            "node",
            (F.col("open") - F.coalesce("_got", zero)).alias("open"),
            (F.col("leaves") + F.coalesce("_more", zero)).alias("leaves"),
            F.col("_got").isNotNull().alias("changed"),
        )

    counts = relax(state, step, merge, keys=["node"], name="leaves", max_rounds=max_rounds)
    cyclic = counts.filter("open > 0").limit(3).collect()
    if cyclic:
        raise ValueError(f"a cycle at or below {[r['node'] for r in cyclic]}")
    return arcs, counts.select("node", "leaves")


def leaf_numbers_by_counts(
    deps: DataFrame, roots: DataFrame, is_leaf: Column, *, max_rounds: int = DEFAULT_MAX_ROUNDS
) -> DataFrame:
    """G17 without expansion: ``(root, leaf, number)``, the number of each leaf's last visit.

    Equal to ``leaf_numbers(expand_dependencies(…))``, but the number of a child's first leaf is that of its parent plus the
    leaves of the children before it, and only the largest is kept: one row for each root and node, not one for
    each visit.  Children of one position go by name.
    """
    scratch = Scratch(deps.sparkSession, "leaf-numbers")
    arcs, counts = _counted(deps, roots, is_leaf, max_rounds)
    sized = arcs.join(counts.select(F.col("node").alias("child"), "leaves"), "child", "left")
    size = F.when(F.col("leaf"), F.lit(1).cast("bigint")).otherwise(F.col("leaves"))
    sized = scratch.put(sized.select("node", "pos", "child", "leaf", size.alias("size")), "w").df
    placed = running_sum(sized, ["node"], ["pos", "child"], F.col("size"), "before")
    placed = scratch.put(placed.select("node", "child", "leaf", F.col("before").cast("bigint").alias("before")), "p").df
    # of the arcs between two nodes only the last one matters
    last = placed.groupBy("node", "child", "leaf").agg(F.max("before").alias("before"))
    last = scratch.put(last, "l").df
    inner = last.filter("NOT leaf").select("node", F.col("child").alias("_child"), "before")

    def step(changed: DataFrame) -> DataFrame:
        sent = changed.join(inner, "node")
        return sent.groupBy("root", F.col("_child").alias("node")).agg(F.max(F.col("at") + F.col("before")).alias("_at"))

    def merge(rows: DataFrame, offers: DataFrame) -> DataFrame:
        later = F.col("_at").isNotNull() & (F.col("at").isNull() | (F.col("_at") > F.col("at")))
        return rows.join(offers, ["root", "node"], "full").select(
            "root", "node", F.greatest("at", "_at").alias("at"), later.alias("changed")
        )

    starts = roots.select("node").distinct().withColumn("_leaf", F.coalesce(is_leaf, F.lit(True)))
    inside = starts.filter("NOT _leaf").select(F.col("node").alias("root"), "node", F.lit(0).cast("bigint").alias("at"))
    at = relax(inside, step, merge, keys=["root", "node"], name="leaf-numbers", max_rounds=max_rounds)
    found = at.join(last.filter("leaf"), "node").groupBy("root", F.col("child").alias("leaf"))
    alone = starts.filter("_leaf").select(
        F.col("node").alias("root"), F.col("node").alias("leaf"), F.lit(0).cast("bigint").alias("number")
    )
    return found.agg(F.max(F.col("at") + F.col("before")).alias("number")).unionByName(alone)
