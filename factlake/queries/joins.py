"""Queries for J1 and J3-J11 (J2 is with the graphs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import formats
from factlake.operators import joins as op
from factlake.queries.graph_data import WITH_LINES, lines
from factlake.queries.registry import query


@query(
    "j1_resolve_refs",
    """WITH cand AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS one
                     FROM supplier GROUP BY s_nationkey),
        hint AS (SELECT s_nationkey AS k, min(s_suppkey) AS h FROM supplier JOIN nation
                 ON s_nationkey = n_nationkey WHERE n_regionkey = 0 GROUP BY s_nationkey)
        SELECT c_custkey, c_nationkey::BIGINT AS nation, coalesce(h, CASE WHEN n = 1 THEN one END) AS target,
          CASE WHEN h IS NOT NULL THEN 'hint' WHEN n = 1 THEN 'unique'
               WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
        FROM customer c LEFT JOIN cand ON cand.k = c_nationkey LEFT JOIN hint ON hint.k = c_nationkey""",
)
def j1(t):
    nation = F.col("s_nationkey").cast("bigint").alias("nation")
    defs = t.supplier.select("s_suppkey", nation)
    africa = t.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").cast("bigint").alias("nation"))
    hints = defs.join(africa, "nation").groupBy("nation").agg(F.min("s_suppkey").alias("target"))
    refs = t.customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"))
    return op.resolve_refs(
        refs, defs, hints, ref_id="c_custkey", def_id="s_suppkey", match_cols=["nation"], hint_key="nation"
    )


@query(
    "j1_two_columns",
    """WITH s AS (SELECT s_suppkey, s_nationkey AS k, s_acctbal >= 5000 AS rich FROM supplier),
        cand AS (SELECT k, rich, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS one FROM s GROUP BY k, rich),
        hint AS (SELECT k, min(s_suppkey) AS h FROM s JOIN nation ON k = n_nationkey WHERE n_regionkey = 0 GROUP BY k)
        SELECT c_custkey, c_nationkey::BIGINT AS nation, c_acctbal >= 5000 AS rich,
          coalesce(h, CASE WHEN n = 1 THEN one END) AS target,
          CASE WHEN h IS NOT NULL THEN 'hint' WHEN n = 1 THEN 'unique'
               WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
        FROM customer c LEFT JOIN cand ON cand.k = c_nationkey AND cand.rich = (c_acctbal >= 5000)
        LEFT JOIN hint ON hint.k = c_nationkey""",
)
def j1_two_columns(t):
    nation = lambda c: F.col(c).cast("bigint").alias("nation")
    defs = t.supplier.select("s_suppkey", nation("s_nationkey"), (F.col("s_acctbal") >= 5000).alias("rich"))
    africa = t.nation.filter("n_regionkey = 0").select(nation("n_nationkey"))
    hints = defs.join(africa, "nation").groupBy("nation").agg(F.min("s_suppkey").alias("target"))
    refs = t.customer.select("c_custkey", nation("c_nationkey"), (F.col("c_acctbal") >= 5000).alias("rich"))
    return op.resolve_refs(
        refs, defs, hints, ref_id="c_custkey", def_id="s_suppkey", match_cols=["nation", "rich"], hint_key="nation"
    )


@query(
    "j3_retain_known",
    f"{WITH_LINES} SELECT src, dst FROM edges WHERE dst IN (SELECT id FROM nodes WHERE status = 'F')",
)
def j3(t):
    g = lines(t)
    return op.retain_known(g.edges, g.ids("status = 'F'"))


@query(
    "j4_range_lookup",
    """SELECT o_orderkey, s_suppkey * 150 AS root, o_orderkey - s_suppkey * 150 AS "offset" FROM orders
       LEFT JOIN supplier ON o_orderkey BETWEEN s_suppkey * 150 AND s_suppkey * 150 + 99""",
)
def j4(t):
    root = F.col("s_suppkey") * 150
    ranges = t.supplier.select(root.alias("root"), (root + 99).alias("end"))
    return op.range_lookup(t.orders.select("o_orderkey"), ranges, point="o_orderkey")


_BASKETS = """WITH m AS (SELECT DISTINCT s_nationkey::BIGINT AS grp, l_suppkey AS owner, l_partkey AS elem,
        CASE WHEN s_acctbal >= 1000 THEN floor(s_acctbal / 2500)::BIGINT END AS size
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL'))"""


def _baskets(t):
    size = F.when(F.col("s_acctbal") >= 1000, F.floor(F.col("s_acctbal") / 2500))
    members = (
        t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("elem"))
        .join(t.supplier, "s_suppkey")
        .select(
            F.col("s_nationkey").cast("bigint").alias("grp"),
            F.col("s_suppkey").alias("owner"),
            "elem",
            size.alias("size"),
        )
        .distinct()
    )
    small = t.part.filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("elem"))
    return members, small


@query(
    "j5_overlap_pairs",
    f"""{_BASKETS}, pairs AS (SELECT DISTINCT a.grp, a.owner AS i, b.owner AS j FROM m a JOIN m b
            ON a.grp = b.grp AND a.elem = b.elem AND a.owner < b.owner)
        SELECT grp, i AS owner FROM pairs UNION SELECT grp, j FROM pairs""",
)
def j5(t):
    members, small = _baskets(t)
    return op.overlapping_members(members, group="grp", owner="owner", element="elem", exclude=small)


@query(
    "j5_overlap_by_size",
    f"""{_BASKETS}, pairs AS (SELECT DISTINCT a.grp, a.owner AS i, b.owner AS j FROM m a JOIN m b
            ON a.grp = b.grp AND a.elem = b.elem AND a.owner < b.owner
            AND (a.size = b.size OR a.size IS NULL OR b.size IS NULL))
        SELECT grp, i AS owner FROM pairs UNION SELECT grp, j FROM pairs""",
)
def j5_sized(t):
    members, small = _baskets(t)
    return op.overlapping_members(
        members, group="grp", owner="owner", element="elem", exclude=small, size="size"
    )


@query(
    "j6_inverse_index",
    """SELECT DISTINCT l_partkey AS elem, l_suppkey AS owner FROM lineitem
       JOIN part ON p_partkey = l_partkey WHERE p_size > 25 AND p_type <> 'SMALL' AND l_quantity > 10""",
)
def j6(t):
    sets = t.lineitem.select(F.col("l_partkey").alias("elem"), F.col("l_suppkey").alias("owner"), "l_quantity")
    part = t.part.withColumnRenamed("p_partkey", "elem")
    return op.inverse_index(
        sets,
        owner="owner",
        element="elem",
        allowed=part.filter("p_size > 25").select("elem"),
        local=part.filter("p_type = 'SMALL'").select("elem"),
        pred=F.col("l_quantity") > 10,
    )


@query(
    "j7_asof_attribute",
    """SELECT event_id, user_id, source_id FROM (
         SELECT event_id, user_id, event_type, last_value(
             CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id
             ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source_id
         FROM events) WHERE event_type = 'error' AND source_id IS NOT NULL""",
)
def j7(t):
    kind = F.col("event_type")
    found = op.asof_attribute(
        t.events.select("event_id", "ts", "user_id", "event_type"),
        by=["user_id"],
        order=["ts", "event_id"],
        is_source=kind != "error",
        is_check=kind == "error",
        id="event_id",
    )
    return found.select("event_id", "user_id", "source_id")


@query(
    "j8_conflicts",
    """SELECT user_id AS point, strftime(ts, '%Y-%m-%d') AS label FROM events WHERE event_type = 'purchase'
       INTERSECT SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'error'""",
)
def j8(t):
    days = t.events.select(
        F.col("user_id").alias("point"), F.date_format("ts", "yyyy-MM-dd").alias("label"), "event_type"
    )
    live = days.filter("event_type = 'purchase'").drop("event_type")
    return op.conflicts(live, days.filter("event_type = 'error'").drop("event_type"))


@query(
    "j9_zip_positional",
    """WITH spec AS (SELECT o_orderkey, unnest(['d', lower(o_orderstatus), 's']) AS conversion,
                     unnest([0, 1, 2]) AS pos FROM orders),
        args AS (SELECT l_orderkey AS o_orderkey, l_linenumber - 1 AS pos, min(l_partkey) AS arg
                 FROM lineitem GROUP BY ALL)
        SELECT o_orderkey, pos::BIGINT AS pos, arg, conversion FROM args JOIN spec USING (o_orderkey, pos)
        WHERE conversion <> 'd'""",
)
def j9(t):
    pattern = F.concat(F.lit("%d %"), F.lower("o_orderstatus"), F.lit(" %s"))
    texts = t.orders.select("o_orderkey", pattern.alias("text"))
    specs = formats.placeholder_specs(texts, "text").select("o_orderkey", "pos", "conversion")
    args = t.lineitem.groupBy(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).cast("bigint").alias("pos")
    ).agg(F.min("l_partkey").alias("arg"))
    return op.zip_positional(args, specs, ["o_orderkey"], keep=F.col("conversion") != "d")


_LEVELS = [("1-URGENT", "high"), ("2-HIGH", "high"), ("5-LOW", "low")]
_LEVELS_SQL = "(VALUES ('1-URGENT', 'high'), ('2-HIGH', 'high'), ('5-LOW', 'low')) v(p, level)"


def _lookup(t, policy, default=None):
    dim = t.spark.createDataFrame(_LEVELS, "o_orderpriority string, level string")
    found = op.lookup_with_default(
        t.orders.select("o_orderkey", "o_orderpriority"),
        dim,
        key="o_orderpriority",
        value="level",
        policy=policy,
        default=default,
    )
    return found.select("o_orderkey", "level")


@query(
    "j10_lookup_conservative",
    f"SELECT o_orderkey, coalesce(level, 'any') AS level FROM orders LEFT JOIN {_LEVELS_SQL} ON o_orderpriority = p",
)
def j10(t):
    return _lookup(t, "conservative", "any")


@query(
    "j10_lookup_noop",
    f"SELECT o_orderkey, level FROM orders JOIN {_LEVELS_SQL} ON o_orderpriority = p",
)
def j10_noop(t):
    return _lookup(t, "noop")


@query(
    "j10_lookup_null",
    f"SELECT o_orderkey, level FROM orders LEFT JOIN {_LEVELS_SQL} ON o_orderpriority = p",
)
def j10_null(t):
    return _lookup(t, "null")


@query(
    "j11_neighbours",
    f"""{WITH_LINES}, target AS (SELECT id FROM nodes WHERE status = 'F'),
        up AS (SELECT dst AS id, src FROM edges JOIN nodes ON nodes.id = src WHERE flag = 'R'),
        own AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_partkey AS field FROM lineitem
                WHERE l_quantity > 25)
        SELECT t.id, 'parent' AS relation, src::VARCHAR AS other FROM target t LEFT JOIN up ON up.id = t.id
        UNION ALL SELECT t.id, 'field', field::VARCHAR FROM target t LEFT JOIN own ON own.id = t.id""",
)
def j11(t):
    g = lines(t)
    fields = t.lineitem.filter("l_quantity > 25").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("field")
    )
    kinds = g.nodes.select("id", F.col("flag").alias("kind"))
    return op.neighbours(g.ids("status = 'F'"), g.edges, fields, kinds=kinds, parent_kind="R")
