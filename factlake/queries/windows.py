"""Queries for N1-N6."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators import windows as op
from factlake.plans.skew import next_value
from factlake.queries.registry import query

_SIZED = """s AS (SELECT l_suppkey AS owner, l_orderkey * 8 + l_linenumber AS pos,
    CASE WHEN min(l_returnflag) = 'N' THEN 0 ELSE count(*) END AS width FROM lineitem GROUP BY 1, 2)"""


def _sized(t):
    pos = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")
    width = F.when(F.min("l_returnflag") == "N", 0).otherwise(F.count(F.lit(1)))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("owner"), pos).agg(
        width.cast("bigint").alias("width")
    )


@query(
    "n1_layout_ranges",
    f"""WITH {_SIZED}, r AS (SELECT *, (2 + sum(width) OVER (ORDER BY owner, pos) - width)::BIGINT AS start FROM s)
        SELECT owner, pos, width, start, start + width AS "end" FROM r""",
)
def n1(t):
    return op.layout_ranges(_sized(t), "owner", "pos", F.col("width"), initial=2)


_RECORDS = """c AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n, greatest(count(o_orderkey), 1) AS len
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
    n AS (SELECT n_nationkey, n_regionkey, greatest(coalesce(sum(len), 0), 1)::BIGINT AS len FROM nation
        LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT r_regionkey, greatest(coalesce(sum(len), 0), 1)::BIGINT AS len FROM region
        LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY ALL)"""
_FIELDS = """f AS (
    SELECT 'C' || o_custkey AS owner, o_orderkey AS pos, NULL AS child, 'field' AS kind, 1 AS length FROM orders
    UNION ALL SELECT 'N' || c_nationkey, c_custkey, 'C' || c_custkey, 'field', len FROM c
    UNION ALL SELECT 'R' || n_regionkey, n_nationkey, 'N' || n_nationkey, 'union', len FROM n),
    placed AS (SELECT owner, pos::BIGINT AS pos, child, kind, length::BIGINT AS length,
        (sum(length) OVER (PARTITION BY owner ORDER BY pos) - length)::BIGINT AS "offset" FROM f)"""


def _fields(t):
    """Regions hold nations, nations customers, customers orders; each level is a record."""
    none = F.lit(None)

    def level(df, owner, pos, child, kind):
        return df.select(
            owner.alias("owner"),
            pos.cast("bigint").alias("pos"),
            child.cast("string").alias("child"),
            F.lit(kind).alias("kind"),
        )

    def name(letter, col):
        return F.concat(F.lit(letter), F.col(col))

    def empty(df, owner, inner):
        """Records without a field: one row with a null position."""
        return level(df.join(inner, "_k", "left_anti"), owner, none, none, "field")

    key = lambda df, col: df.select(F.col(col).cast("bigint").alias("_k"))
    return reduce(
        DataFrame.unionByName,
        [
            level(t.orders, name("C", "o_custkey"), F.col("o_orderkey"), none, "field"),
            level(t.customer, name("N", "c_nationkey"), F.col("c_custkey"), name("C", "c_custkey"), "field"),
            level(t.nation, name("R", "n_regionkey"), F.col("n_nationkey"), name("N", "n_nationkey"), "union"),
            empty(key(t.customer, "c_custkey"), name("C", "_k"), key(t.orders, "o_custkey")),
            empty(key(t.nation, "n_nationkey"), name("N", "_k"), key(t.customer, "c_nationkey")),
            empty(key(t.region, "r_regionkey"), name("R", "_k"), key(t.nation, "n_regionkey")),
        ],
    )


@query(
    "n2_record_lengths",
    f"""WITH {_RECORDS} SELECT 'C' || c_custkey AS owner, len::BIGINT AS length FROM c
        UNION ALL SELECT 'N' || n_nationkey, len FROM n UNION ALL SELECT 'R' || r_regionkey, len FROM r""",
)
def n2_lengths(t):
    return op.flatten_offsets(_fields(t))[0]


@query(
    "n2_flatten_offsets",
    f"""WITH {_RECORDS}, {_FIELDS} SELECT owner, pos, child, kind, length, "offset" FROM placed""",
)
def n2(t):
    return op.flatten_offsets(_fields(t))[1]


@query(
    "n2_flatten_leaves",
    f"""WITH {_RECORDS}, {_FIELDS}
        SELECT a.owner AS root, a.pos || '/' || b.pos || CASE WHEN d.pos IS NULL THEN '' ELSE '/' || d.pos END
          AS path, a."offset" + b."offset" + coalesce(d."offset", 0) AS "offset"
        FROM placed a JOIN placed b ON b.owner = a.child LEFT JOIN placed d ON d.owner = b.child
        WHERE a.owner LIKE 'R%'
        UNION ALL SELECT a.owner, a.pos::VARCHAR, a."offset" FROM placed a
        WHERE a.owner LIKE 'R%' AND a.child NOT IN (SELECT owner FROM placed)""",
)
def n2_leaves(t):
    offsets = op.flatten_offsets(_fields(t))[1]
    roots = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("owner"))
    leaves = op.flatten_leaves(offsets, roots)
    path = F.array_join(F.col("path").cast("array<string>"), "/")
    return leaves.select("root", path.alias("path"), "offset")


@query(
    "n3_range_of",
    f"""WITH {_SIZED}, r AS (SELECT owner, pos, (sum(width) OVER (ORDER BY owner, pos) - width)::BIGINT AS start FROM s)
        SELECT owner, pos, start, lead(start) OVER (PARTITION BY owner ORDER BY pos) AS "end" FROM r
        QUALIFY "end" IS NOT NULL""",
)
def n3(t):
    placed = op.layout_ranges(_sized(t), "owner", "pos", F.col("width"))
    return op.range_of(placed.select("owner", "pos", "start"), "owner", "pos", "start")


@query(
    "n4_first_wins_propagation",
    # with one starting group a variable is reached at the least time of any path of rising times
    """WITH RECURSIVE kind(name, var) AS (VALUES ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3), ('error', 4)),
        log AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id
                ORDER BY ts, event_id) AS nxt FROM events),
        move AS (SELECT user_id AS scope, event_id AS t, a.var AS src, b.var AS dst FROM log
                 JOIN kind a ON a.name = event_type JOIN kind b ON b.name = nxt),
        hit AS (SELECT DISTINCT user_id AS scope, 2 AS var, -1::BIGINT AS t FROM events
                UNION SELECT m.scope, m.dst, m.t FROM hit h JOIN move m ON m.scope = h.scope AND m.src = h.var
                AND m.t > h.t WHERE m.dst NOT IN (0, 2, 4))
        SELECT scope, var::BIGINT AS var, 2::BIGINT AS grp, min(t) AS t FROM hit GROUP BY scope, var""",
)
def n4(t):
    copies, users = _moves(t)
    defs = users.select("scope", F.lit(2).cast("bigint").alias("var"))
    blocked = users.select("scope", F.lit(4).cast("bigint").alias("var"))
    return op.first_wins_propagation(defs, copies, blocked)


def _moves(t):
    """Copies between kinds of events that follow each other, and the users."""
    log = t.events.select("user_id", "ts", "event_id", "event_type")
    moves = next_value(log, ["user_id"], ["ts", "event_id"], F.col("event_type"), "next_type")
    kinds = ["view", "click", "signup", "purchase", "error"]
    number = lambda c: F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(c)) - 1
    copies = moves.filter("next_type IS NOT NULL").select(
        F.col("user_id").alias("scope"),
        F.col("event_id").alias("t"),
        number("next_type").alias("dst"),
        number("event_type").alias("src"),
    )
    return copies, t.events.select(F.col("user_id").alias("scope")).distinct()


@query(
    "n4_two_groups",
    # clicks and signups are groups of their own: the first of them that a purchase follows gives it its group
    """WITH log AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id
             ORDER BY ts, event_id) AS nxt FROM events),
        won AS (SELECT user_id AS scope, arg_min(CASE event_type WHEN 'click' THEN 1 ELSE 2 END, event_id) AS grp,
                min(event_id) AS t FROM log WHERE nxt = 'purchase' AND event_type IN ('click', 'signup') GROUP BY user_id)
        SELECT DISTINCT user_id AS scope, v::BIGINT AS var, v::BIGINT AS grp, -1::BIGINT AS t
        FROM events, (SELECT unnest([1, 2]) AS v)
        UNION ALL SELECT scope, 3::BIGINT, grp::BIGINT, t FROM won""",
)
def n4_two_groups(t):
    copies, users = _moves(t)
    defs = users.select("scope", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("var"))
    blocked = users.select("scope", F.lit(4).cast("bigint").alias("var"))
    return op.first_wins_propagation(defs, copies, blocked)


@query(
    "n5_dead_writes",
    """SELECT user_id, event_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id
           ORDER BY ts, event_id) AS nxt FROM events)
       WHERE event_type IN ('click', 'signup') AND (nxt IS NULL OR nxt IN ('click', 'signup'))""",
)
def n5(t):
    # views, purchases and errors read
    log = t.events.select("user_id", "ts", "event_id", "event_type")
    dead = op.dead_writes(
        log, ["user_id"], ["ts", "event_id"], is_write=F.col("event_type").isin("click", "signup")
    )
    return dead.select("user_id", "event_id", "event_type")


@query(
    "n6_rank_order",
    """SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events""",
)
def n6(t):
    return op.rank_order(t.events.select("event_id", "value"), "value", ["event_id"])
