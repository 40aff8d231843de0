"""Path contraction: chains of nodes with one way in and one way out become single arcs.

A loop that walks a graph needs as many rounds as the longest path has arcs.  Here each inner node of a chain
points to the node behind it and pointers are doubled, so a chain of n nodes needs log n rounds; the loop then
runs on what is left, and the inner nodes take their results from the ends of their chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.plans.scratch import Scratch, Table

#: A pass is worth its jobs if one in so many arcs lies on a chain.
_WORTH = 8


@dataclass(frozen=True)
class Contraction:
    """What one pass made of a graph.

    ``arcs(src, dst, steps)`` joins the nodes that stay; ``steps`` is the most arcs it stands for.  ``inner(id, tail,
    steps, last, lo, hi)`` are the nodes on chains: the node that the chain leads to and how many arcs away it is,
    the chain's last inner node, and the extremes of the values from the node on.  ``heads(last, head)`` says
    where a chain begins.  ``rings(id, least, lo, hi)`` are cycles that nothing enters or leaves.  ``own(id, lo, hi)``
    has the values of the nodes that stay, with those of the chains that leave them.
    """

    arcs: Table
    inner: DataFrame
    heads: DataFrame
    rings: DataFrame
    own: DataFrame


def no_values(nodes_like: DataFrame, column: str = "id") -> DataFrame:
    """An empty ``own`` table for graphs whose nodes carry no values."""
    none = F.lit(None).cast("bigint")
    return nodes_like.select(F.col(column).alias("id"), none.alias("lo"), none.alias("hi")).limit(0)


def contract(scratch: Scratch, arcs: Table, own: DataFrame) -> Contraction | None:
    """One pass over ``arcs(src, dst, steps)``, distinct and without loops; None if few nodes lie on chains."""
    ways_out = arcs.df.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("dst").alias("to"), F.max("steps").alias("steps")
    )
    ways_in = arcs.df.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_m"))
    single = ways_out.filter("_n = 1").join(ways_in.filter("_m = 1"), "id").select("id", "to", "steps")
    single = scratch.save(single, "i")
    if not single.rows or single.rows * _WORTH < arcs.rows:
        scratch.drop(single.path)
        return None
    ids = single.df.select("id")
    follows = ids.select(F.col("id").alias("to"), F.lit(True).alias("_open"))
    begun = single.df.join(own, "id", "left").join(follows, "to", "left")
    pointers = scratch.put(
        begun.select(
            "id", "to", "steps", F.col("id").alias("last"), "lo", "hi", F.col("id").alias("least"),
            F.coalesce("_open", F.lit(False)).alias("open"), F.lit(False).alias("moved"),
        ),
        "p",
    ).df
    done, open_ = pointers.filter("NOT open"), pointers.filter("open")
    before = None
    while True:
        count = open_.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved")).first()
        # chains end one after the other: if none did, only rings are left, which are known once no minimum moves
        if not count["n"] or (count["n"] == before and not count["moved"]):
            break
        before = count["n"]
        target = done.unionByName(open_).select(F.col("id").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("to", "steps", "last", "lo", "hi", "least", "open")])
        jumped = open_.join(target, "to").select(
            "id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_last").alias("last"),
            F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"), F.least("least", "_least").alias("least"),
            F.col("_open").alias("open"), (F.col("_least") < F.col("least")).alias("moved"),
        )
        now = scratch.put(jumped, "p").df
        done, open_ = done.unionByName(now.filter("NOT open")), now.filter("open")
    inner = scratch.put(done.select("id", F.col("to").alias("tail"), "steps", "last", "lo", "hi"), "c").df
    rings = scratch.put(open_.select("id", "least", "lo", "hi"), "o").df
    src, dst = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    entering = arcs.df.join(src, "src", "left_anti")
    first = inner.select(F.col("id").alias("dst"), "tail", F.col("steps").alias("_more"), "last", "lo", "hi")
    # the ways into chains, with all that follows
    chains = scratch.put(entering.join(first, "dst").select("src", F.col("tail").alias("dst"), (F.col("steps") + F.col("_more")).alias("steps"), "last", "lo", "hi"), "h").df
    every = entering.join(dst, "dst", "left_anti").select("src", "dst", "steps").unionByName(chains.select("src", "dst", "steps"))
    fewer = scratch.save(every.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.max("steps").alias("steps")), "e")
    staying = own.join(ids, "id", "left_anti").unionByName(chains.select(F.col("src").alias("id"), "lo", "hi"))
    values = scratch.put(staying.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "v").df
    return Contraction(fewer, inner, chains.select("last", F.col("src").alias("head")), rings, values)


def contract_all(scratch: Scratch, arcs: Table, own: DataFrame) -> tuple[Table, DataFrame, list[Contraction]]:
    """Passes until few nodes lie on chains: the arcs and values that are left, and what each pass took out."""
    passes: list[Contraction] = []
    while arcs.rows and (found := contract(scratch, arcs, own)):
        passes.append(found)
        arcs, own = found.arcs, found.own
    return arcs, own, passes
