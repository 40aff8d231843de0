"""The test graphs, each built from whole tables, as DataFrames and as SQL.

LINES: a node for each (order, line number); an edge from every line to the next line of its order,
and one back to the nearest earlier line with the same return flag.  Orders are the components, and
the back edges make strong components of many shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.plans.scratch import Scratch
from factlake.plans.skew import next_value, slice_groups

NODES_SQL = """nodes AS (
    SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS ord, min(l_returnflag) AS flag,
           min(l_linestatus) AS status, min(l_suppkey) AS supp
    FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
EDGES_SQL = """edges AS (
    SELECT id AS src, lead(id) OVER (PARTITION BY ord ORDER BY id) AS dst FROM nodes
    QUALIFY dst IS NOT NULL
    UNION
    SELECT id AS src, lag(id) OVER (PARTITION BY ord, flag ORDER BY id) AS dst FROM nodes
    QUALIFY dst IS NOT NULL)"""
LINES_SQL = f"{NODES_SQL}, {EDGES_SQL}"
CLOSURE_SQL = """closure AS (
    SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src)"""
WITH_LINES = f"WITH RECURSIVE {LINES_SQL}"
WITH_CLOSURE = f"WITH RECURSIVE {LINES_SQL}, {CLOSURE_SQL}"
COMP_SQL = """comp AS (
    SELECT n.id AS node, least(n.id, coalesce(min(a.dst), n.id)) AS comp FROM nodes n
    LEFT JOIN (SELECT c.src, c.dst FROM closure c JOIN closure d ON c.src = d.dst AND c.dst = d.src) a
    ON a.src = n.id GROUP BY n.id)"""
WITH_COMP = f"{WITH_CLOSURE}, {COMP_SQL}"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    #: Distinct edges.
    edges: DataFrame
    #: The same edges as they were found, near ones together: one may be there twice, and operators that take distinct edges do so anyway.
    arcs: DataFrame | None = None
    #: ``(id, _next, _after)``: the next line, and the next one with the same flag.
    links: DataFrame | None = None

    def ids(self, condition: str) -> DataFrame:
        return self.nodes.filter(condition).select("id")


def lines(t) -> Graph:
    scratch = Scratch(t.spark, "lines")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("supp"),
    )
    whole = slice_groups(rows, ["ord"], ["line"]).cut is None
    if whole:
        # no order is large: nodes and both neighbours come out of one shuffle
        rows = rows.repartition("ord")
    found = rows.groupBy("ord", "line").agg(*[F.min(c).alias(c) for c in ("flag", "status", "supp")])
    nodes = found.withColumn("id", F.col("ord") * 8 + F.col("line"))
    if not whole:
        nodes = scratch.put(nodes, "n").df

    def ahead(df: DataFrame, by: list[str], out: str) -> DataFrame:
        if whole:
            return df.withColumn(out, F.lead("id").over(Window.partitionBy(*by).orderBy("line")))
        return next_value(df, by, ["id"], F.col("id"), out, nullable=False)

    # ``_after`` is the line whose earlier line with the same flag this one is
    both = ahead(ahead(nodes, ["ord"], "_next"), ["ord", "flag"], "_after")
    both = scratch.put(both.select("id", "ord", "flag", "status", "supp", "_next", "_after"), "n").df
    pair = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    arcs = both.select(F.explode(F.array(pair("id", "_next"), pair("_after", "id"))).alias("_e")).select("_e.*")
    arcs = arcs.filter("src IS NOT NULL AND dst IS NOT NULL")
    return Graph(both.drop("_next", "_after"), arcs.distinct(), arcs, both.select("id", "_next", "_after"))


def copies(t) -> Graph:
    """Documents, each linked to the first document with the same text."""
    from factlake.plans.skew import attach_group

    keyed = t.documents.select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    first = attach_group(keyed, ["k"], F.min("id").alias("dst"))
    edges = first.filter("id <> dst").select(F.col("id").alias("src"), "dst")
    return Graph(keyed.select("id"), edges)


def supply(t) -> Graph:
    """Suppliers and the parts they deliver: part p is node -1 - p."""
    part = -1 - F.col("l_partkey")
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), part.alias("dst")).distinct()
    parts = t.part.select((-1 - F.col("p_partkey")).alias("id"))
    return Graph(t.supplier.select(F.col("s_suppkey").alias("id")).unionByName(parts), edges)
