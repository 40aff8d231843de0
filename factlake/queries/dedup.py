"""Queries for D1-D3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators import dedup as op
from factlake.operators.aggs import equivalence_classes
from factlake.plans.skew import running_sum
from factlake.queries.registry import query


def _records(t):
    """Customers (named after their segment) with their orders and a nation; nations are unnamed."""

    def name(letter, col):
        return F.concat(F.lit(letter), F.col(col))

    def node(df, letter, col, title, generated):
        return df.select(
            name(letter, col).alias("id"), title.alias("name"), F.lit(generated).alias("generated")
        )

    def field(df, id_, pos, title, kind, child):
        return df.select(
            id_.alias("id"),
            pos.cast("bigint").alias("pos"),
            F.lit(title).alias("name"),
            kind.alias("type"),
            child.cast("string").alias("child"),
        )

    nodes = reduce(
        DataFrame.unionByName,
        [
            node(t.customer, "C", "c_custkey", F.col("c_mktsegment"), False),
            node(t.nation, "N", "n_nationkey", F.col("n_name"), True),
            node(t.region, "R", "r_regionkey", F.col("r_name"), False),
        ],
    )
    placed = running_sum(
        t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"),
        ["o_custkey"],
        ["o_orderkey"],
        F.lit(1),
        "_pos",
    )
    struct = F.lit("struct")
    fields = reduce(
        DataFrame.unionByName,
        [
            field(placed, name("C", "o_custkey"), F.col("_pos") + 1, "order", F.col("o_orderpriority"), F.lit(None)),
            field(t.customer, name("C", "c_custkey"), F.lit(0), "home", struct, name("N", "c_nationkey")),
            field(t.nation, name("N", "n_nationkey"), F.lit(0), "region", struct, name("R", "n_regionkey")),
        ],
    )
    return nodes, fields


_CLASSES = """WITH pri AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY 1),
    rec AS (SELECT 'C' || c_custkey AS id, c_mktsegment AS name,
              min('C' || c_custkey) OVER (PARTITION BY c_mktsegment, n_regionkey, l) AS rep
            FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN pri ON o_custkey = c_custkey
      UNION ALL SELECT 'R' || r_regionkey, r_name, 'R' || r_regionkey FROM region
      UNION ALL SELECT 'N' || n_nationkey, NULL, min('N' || n_nationkey) OVER (PARTITION BY n_regionkey)
            FROM nation)"""


@query("d1_structural_classes", f"{_CLASSES} SELECT id, rep FROM rec")
def d1(t):
    return op.structural_classes(*_records(t)).select("id", "rep")


@query(
    "d1_same_name_classes",
    f"""{_CLASSES} SELECT name, count(*) AS n_records, count(DISTINCT rep) AS n_classes
        FROM rec WHERE name IS NOT NULL GROUP BY name""",
)
def d1_names(t):
    nodes, fields = _records(t)
    return op.same_name_classes(nodes, op.structural_classes(nodes, fields))


@query(
    "d2_resolve_opaque",
    """SELECT 'C' || c_custkey AS id, 0::BIGINT AS pos, 'home' AS name, 'struct' AS type,
         CASE WHEN n_regionkey <> 4 THEN 'N' || n_nationkey ELSE 'X' || n_name END AS child
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def d2(t):
    home = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    fields = home.select(
        F.concat(F.lit("C"), "c_custkey").alias("id"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit("home").alias("name"),
        F.lit("struct").alias("type"),
        F.concat(F.lit("X"), "n_name").alias("child"),
    )
    opaque = t.nation.select(F.concat(F.lit("X"), "n_name").alias("id"), F.col("n_name").alias("name"))
    defined = t.nation.filter("n_regionkey <> 4").select(
        F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name")
    )
    nodes = opaque.unionByName(defined).withColumn("generated", F.lit(False))
    return op.resolve_opaque(fields, nodes, opaque)


@query(
    "d2_then_d1",
    # named nations: customers agree iff segment, nation and order priorities do, also where the nation stays opaque
    """WITH pri AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
       SELECT 'C' || c_custkey AS id, min('C' || c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey, l) AS rep
       FROM customer LEFT JOIN pri ON o_custkey = c_custkey
       UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey FROM region
       UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation WHERE n_regionkey <> 4""",
)
def d2_then_d1(t):
    nodes, fields = _records(t)
    nations = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    opaque = nations.select(F.concat(F.lit("X"), "name").alias("id"), "name")
    # homes are declared by name only, and the nations of one region have no body
    declared = nations.select(F.col("id").alias("child"), F.concat(F.lit("X"), "name").alias("_name"))
    homes = fields.join(declared, "child", "left").withColumn("child", F.coalesce("_name", "child"))
    defined = nations.filter("n_regionkey <> 4").select("id", "name", F.lit(False).alias("generated"))
    nodes = nodes.filter(~F.col("id").startswith("N")).unionByName(defined)
    homes = homes.join(nodes.select("id"), "id", "left_semi").select(*fields.columns)
    every = nodes.unionByName(opaque.withColumn("generated", F.lit(False)))
    return op.structural_classes(nodes, op.resolve_opaque(homes, every, opaque)).select("id", "rep")


_REPS = "WITH r AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents)"


def _text_classes(t):
    classes = equivalence_classes(t.documents, "doc_id", [F.col("text")])
    return classes.select(F.col("doc_id").alias("id"), "rep")


@query("d3_canonicalise", f"{_REPS} SELECT DISTINCT rep AS doc_id, quality FROM labels JOIN r USING (doc_id)")
def d3(t):
    return op.canonicalise(t.labels.select("doc_id", "quality"), _text_classes(t), ["doc_id"])


@query("d3_keep_representatives", f"{_REPS} SELECT doc_id, lang FROM r WHERE doc_id = rep")
def d3_keep(t):
    return op.canonicalise(t.documents.select("doc_id", "lang"), _text_classes(t), [], key="doc_id")
