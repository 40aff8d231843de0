"""Queries for A1-A8 and X1-X3."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import aggs as op
from factlake.operators import sets
from factlake.queries.registry import query

_FLAGGED = """f AS (SELECT l_orderkey AS ord, l_linenumber::BIGINT AS line, l_partkey AS part,
    CASE WHEN l_quantity > 25 THEN l_returnflag END AS grp, l_discount > 0.04 AS flag FROM lineitem)"""


def _flagged(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("grp"),
        (F.col("l_discount") > 0.04).alias("flag"),
    )


@query(
    "a1_all_of_group",
    f"""WITH {_FLAGGED} SELECT *, CASE WHEN count(grp) OVER (PARTITION BY ord) = 0 THEN flag
          WHEN grp IS NULL THEN false ELSE bool_and(flag) OVER (PARTITION BY ord, grp) END AS all_set FROM f""",
)
def a1(t):
    return op.all_of_group(_flagged(t), ["ord"], "grp", "flag")


@query(
    "a2_any_of_group",
    f"""WITH {_FLAGGED} SELECT *, CASE WHEN grp IS NULL THEN flag
          ELSE bool_or(flag) OVER (PARTITION BY ord, grp) END AS any_set FROM f""",
)
def a2(t):
    return op.any_of_group(_flagged(t), ["ord"], "grp", "flag")


@query(
    "a2_any_drop_empty",
    f"""WITH {_FLAGGED} SELECT *, CASE WHEN grp IS NULL THEN flag
          ELSE bool_or(flag) OVER (PARTITION BY ord, grp) END AS any_set FROM f
        WHERE ord IN (SELECT ord FROM f WHERE flag)""",
)
def a2_drop(t):
    return op.any_of_group(_flagged(t), ["ord"], "grp", "flag", drop_empty=True)


_LATTICE = """WITH f AS (SELECT l_orderkey AS ord, CASE WHEN l_quantity > 25 THEN l_returnflag END AS v,
        l_quantity >= 50 AS absorbing FROM lineitem),
    s AS (SELECT ord, count(DISTINCT v) FILTER (NOT absorbing) AS k,
          min(v) FILTER (NOT absorbing) AS v, bool_or(absorbing) AS hit FROM f GROUP BY ord)
    SELECT ord, CASE WHEN hit OR k > 1 THEN '{many}' WHEN k = 0 THEN '{none}' ELSE 'elem' END AS state,
           CASE WHEN NOT hit AND k = 1 THEN v END AS value FROM s"""


def _lattice(t, many, none):
    value = F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))
    state = F.when(F.col("l_quantity") >= 50, many).when(value.isNull(), none).otherwise("elem")
    return t.lineitem.select(F.col("l_orderkey").alias("ord"), value.alias("v"), state.alias("s"))


@query("a3_lattice_meet", _LATTICE.format(many="bottom", none="top"))
def a3_meet(t):
    return op.lattice_meet(_lattice(t, "bottom", "top"), ["ord"], "v", "s")


@query("a3_lattice_join", _LATTICE.format(many="top", none="bottom"))
def a3_join(t):
    return op.lattice_join(_lattice(t, "top", "bottom"), ["ord"], "v", "s")


_BITS = {"view": 0, "click": 1, "signup": 2, "purchase": 31, "error": 62}
_BIT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {1 << b}" for k, b in _BITS.items()) + " END"


@query(
    "a4_masks",
    f"""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, bit_or(({_BIT_SQL})::BIGINT) AS m
                   FROM events GROUP BY ALL),
        u AS (SELECT user_id, bit_or(m) AS mask_any, bit_and(m) AS mask_all FROM d GROUP BY user_id)
        SELECT user_id, mask_any, mask_all, mask_any & ~mask_all AS mask_some,
          bit_count(mask_any)::BIGINT AS n_any, (mask_any & {1 | 2 | 1 << 31}) = {1 | 2 | 1 << 31} AS is_buyer
        FROM u""",
)
def a4(t):
    index = F.lit(None).cast("int")
    for kind, b in _BITS.items():
        index = F.when(F.col("event_type") == kind, b).otherwise(index)
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    daily = t.events.groupBy("user_id", day).agg(op.mask_union(op.bit(index)).alias("m"))
    users = daily.groupBy("user_id").agg(
        op.mask_union("m").alias("mask_any"), op.mask_intersect("m").alias("mask_all")
    )
    any_, all_ = F.col("mask_any"), F.col("mask_all")
    buyer = F.lit(1 | 2 | 1 << 31).cast("bigint")
    return users.select(
        "user_id",
        "mask_any",
        "mask_all",
        op.mask_subtract(any_, all_).alias("mask_some"),
        op.mask_count(any_).alias("n_any"),
        op.mask_superset(any_, buyer).alias("is_buyer"),
    )


@query(
    "a5_single_def_single_use",
    """SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL
       HAVING count(*) = 2 AND count(*) FILTER (l_returnflag = 'A') = 1
       UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_tax = 0.08""",
)
def a5(t):
    extra = t.lineitem.filter("l_tax = 0.08D").select("l_suppkey", "l_partkey")
    return op.single_def_single_use(
        t.lineitem, ["l_suppkey", "l_partkey"], F.col("l_returnflag") == "A", extra
    )


@query(
    "a6_weighted_rank",
    """WITH s AS (SELECT c_custkey AS user_id, coalesce(sum(CASE event_type WHEN 'purchase' THEN 10
            WHEN 'click' THEN 1 ELSE 0 END), 0)::BIGINT AS score FROM customer
            LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey)
       SELECT user_id, score, row_number() OVER (ORDER BY score DESC, user_id) AS place FROM s""",
)
def a6(t):
    keys = t.customer.select(F.col("c_custkey").alias("user_id"))
    return op.weighted_rank(
        keys, t.events, key="user_id", kind="event_type", weights={"purchase": 10, "click": 1}
    )


@query(
    "a7_equivalence_classes",
    """WITH r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents)
       SELECT doc_id, rep, dense_rank() OVER (ORDER BY rep) - 1 AS class_id FROM r""",
)
def a7(t):
    return op.equivalence_classes(t.documents, "doc_id", [F.col("text")])


_MARK = "coalesce(min(epoch_us(ts) // 1000) FILTER (event_type = '{}'), 0)"


@query(
    "a8_duration_stages",
    f"""SELECT user_id, greatest({_MARK.format('purchase')} - {_MARK.format('signup')}, 0) AS to_purchase,
          greatest({_MARK.format('error')} - {_MARK.format('purchase')}, 0) AS to_error,
          {_MARK.format('view')} AS viewed FROM events GROUP BY user_id""",
)
def a8(t):
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    marks = t.events.select(
        "user_id", "event_type", F.timestamp_diff("MILLISECOND", epoch, F.col("ts")).alias("ms")
    )
    return op.duration_stages(
        marks,
        ["user_id"],
        label="event_type",
        mark="ms",
        stages=[("to_purchase", "signup", "purchase"), ("to_error", "purchase", "error")],
        totals=[("viewed", "view")],
    )


def _days(t):
    days = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    writes = days.filter("event_type IN ('click', 'signup')").drop("event_type")
    return writes, days.filter("event_type IN ('view', 'purchase')").drop("event_type")


_SETS = """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('click', 'signup')
    {} SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type IN ('view', 'purchase')"""


@query("x1_set_union", _SETS.format("UNION"))
def x1(t):
    return sets.set_union(*_days(t))


@query("x2_set_intersect", _SETS.format("INTERSECT"))
def x2(t):
    return sets.set_intersect(*_days(t))


@query("x3_set_subtract", _SETS.format("EXCEPT"))
def x3(t):
    return sets.set_subtract(*_days(t))
