"""Queries for P1-P11."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import inventory as op
from factlake.queries.registry import query


@query(
    "p1_group_by_child_count",
    """SELECT count(o_orderkey) AS n_children, c_custkey AS id
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def p1(t):
    return op.group_by_child_count(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")


@query(
    "p1_child_count_groups",
    """SELECT n_children, count(*) AS n_ids FROM (
         SELECT count(o_orderkey) AS n_children FROM customer LEFT JOIN orders
         ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY n_children""",
)
def p1_groups(t):
    return op.child_count_groups(p1(t))


@query(
    "p2_occurrences",
    """SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n_uses FROM customer
       LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment""",
)
def p2(t):
    defs = t.customer.select("c_custkey", "c_mktsegment")
    return op.occurrences(defs, t.orders, "c_custkey", "o_custkey")


@query(
    "p3_call_counts",
    """SELECT o_custkey, count(*) AS n_uses FROM orders WHERE o_custkey IN
       (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey""",
)
def p3(t):
    local = t.customer.filter("c_mktsegment = 'BUILDING'")
    return op.call_counts(t.orders, "o_custkey", local, "c_custkey")


@query(
    "p4_conditional_counts",
    """SELECT s_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS n_rows
       FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey""",
)
def p4(t):
    cond = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)
    return op.conditional_counts(
        t.supplier.select("s_suppkey"), t.lineitem, "s_suppkey", "l_suppkey", cond
    )


@query(
    "p5_distinct_tokens",
    """SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+(?:::[A-Za-z]+)*')) AS token
       FROM documents""",
)
def p5(t):
    return op.distinct_tokens(t.documents.select("text"), "text", op.path_pattern("[A-Za-z]+"))


@query(
    "p5_paths",
    r"""SELECT DISTINCT regexp_replace(token, '\s*::\s*', '::', 'g') AS token FROM (SELECT unnest(regexp_extract_all(
         replace(text, '. ', ' :: '), '[A-Za-z]+(?:\s*::\s*[A-Za-z]+)*')) AS token FROM documents)""",
)
def p5_paths(t):
    paths = t.documents.select(F.replace("text", F.lit(". "), F.lit(" :: ")).alias("text"))
    return op.distinct_tokens(paths, "text", op.path_pattern("[A-Za-z]+", blanks=True))


_CALLS = """SELECT event_id, event_type AS kind,
    CASE WHEN event_type = 'click' THEN 'u' || user_id END AS target FROM events"""


@query(
    "p6_flag_listing",
    f"""SELECT coalesce(target, kind) AS line, event_id FROM ({_CALLS})
        WHERE target IS NULL OR target NOT IN
          (SELECT 'u' || user_id FROM events WHERE event_type = 'signup')""",
)
def p6(t):
    name = F.concat(F.lit("u"), F.col("user_id"))
    rows = t.events.select(
        "event_id",
        F.col("event_type").alias("kind"),
        F.when(F.col("event_type") == "click", name).alias("target"),
    )
    local = t.events.filter("event_type = 'signup'").select(name.alias("target"))
    return op.flag_listing(rows, local, call_kind="click", position="event_id")


_WORD_KINDS = [
    ("the", "operation"),
    ("and", "operation"),
    ("of", "unsupported"),
    ("in", "unsupported"),
    ("les", "open"),
    ("que", "string_operation"),
    ("der", "file_descr_operation"),
    ("rename", "file_sys_operation"),
]
_FLAGS = """kind, n_tokens, n_names,
    coalesce(kind = 'operation', false) AS is_operation,
    coalesce(kind = 'unsupported', false) AS is_unsupported,
    coalesce(kind IN ('open', 'operation', 'stdio_operation', 'file_sys_operation', 'unsupported'),
             false) AS is_high_level"""


def _inline(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(str(r) for r in rows)}) v({names})"


@query(
    "p7_category_inventory",
    f"""WITH tok AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents),
        g AS (SELECT kind, count(*) AS n_tokens, count(DISTINCT token) AS n_names
              FROM tok LEFT JOIN {_inline(_WORD_KINDS, 'name, kind')} ON token = name GROUP BY kind)
        SELECT {_FLAGS} FROM g""",
)
def p7(t):
    lowered = t.documents.select(F.lower("text").alias("text"))
    dim = t.spark.createDataFrame(_WORD_KINDS, "name string, kind string")
    return op.category_inventory(op.tokens(lowered, "text", "[a-z]+"), "token", dim)


@query(
    "p7_normalised_inventory",
    f"""WITH g AS (SELECT CASE event_type WHEN 'view' THEN 'operation' WHEN 'click' THEN 'operation'
                   WHEN 'signup' THEN 'stdio_operation' WHEN 'purchase' THEN 'open' END AS kind,
                   count(*) AS n_tokens, count(DISTINCT event_type) AS n_names
                   FROM events GROUP BY 1) SELECT {_FLAGS} FROM g""",
)
def p7_normalised(t):
    spellings = {
        "view": "rpl_fread",
        "click": "rpl_fwrite_unlocked",
        "signup": "__printf__",
        "purchase": "fopen",
    }
    named = F.lit("no_such_name")
    for event, spelling in spellings.items():
        named = F.when(F.col("event_type") == event, spelling).otherwise(named)
    calls = t.events.select(named.alias("token"))
    return op.category_inventory(calls, "token", op.io_dimension(t.spark))


@query(
    "p8_exclude_prefixes",
    """SELECT p_partkey, replace(replace(p_type || '::r#' || p_name, '::', '_'), 'r#', '') AS name
       FROM part WHERE NOT starts_with(p_type || '::r#' || p_name, 'SMALL')
       AND NOT starts_with(p_type || '::r#' || p_name, 'ECONOMY::r#red')""",
)
def p8(t):
    path = F.concat("p_type", F.lit("::r#"), "p_name")
    parts = t.part.select("p_partkey", path.alias("path"))
    return op.binary_names(parts, "path", ["SMALL", "ECONOMY::r#red"]).select("p_partkey", "name")


@query(
    "p9_path_key",
    r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(rtrim(
            regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), '([^/])\.[^./]*$', '\1'), '/'),
            lambda x: x <> '') AS parts FROM pages),
        q AS (SELECT page_id, parts, coalesce(list_position(list_transform(parts,
            lambda x: x IN ('en', 'fr', 'de')), true), 0) AS first FROM p)
        SELECT page_id, array_to_string(list_concat(['src'],
            CASE WHEN first > 0 THEN parts[first:] ELSE []::VARCHAR[] END), '::') AS module FROM q""",
)
def p9(t):
    paths = t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    return op.path_key(paths, "path", ["en", "fr", "de"]).select("page_id", "module")


@query(
    "p10_classify_targets",
    """WITH tok AS (SELECT nullif(unnest(regexp_extract_all(lower(text), '[a-z]+')), 'in') AS token
                    FROM documents),
        own AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token
                FROM benchmark)
        SELECT CASE WHEN token IS NULL THEN 'indirect'
                    WHEN token IN ('the', 'and', 'les') THEN 'foreign'
                    WHEN token IN (SELECT token FROM own) THEN 'local'
                    WHEN token IN (SELECT lower(p_type) FROM part) THEN 'library'
                    ELSE 'dynamic' END AS target_class, count(*) AS n
        FROM tok GROUP BY 1""",
)
def p10(t):
    lowered = t.documents.select(F.lower("text").alias("text"))
    found = op.tokens(lowered, "text", "[a-z]+").select(F.nullif("token", F.lit("in")).alias("token"))
    own = op.distinct_tokens(t.benchmark.select(F.lower("text").alias("text")), "text", "[a-z]+")
    dims = [
        ("foreign", t.spark.createDataFrame([("the",), ("and",), ("les",)], "token string")),
        ("local", own),
        ("library", t.part.select(F.lower("p_type").alias("token"))),
    ]
    classes = op.classify_targets(found, "token", dims)
    return classes.groupBy("target_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p11_funnel_counts",
    """SELECT count(*) AS n_all, count(*) FILTER (event_type <> 'error') AS n_targets,
       count(*) FILTER (event_type <> 'error' AND value > 10) AS n_large,
       count(*) FILTER (event_type <> 'error' AND value > 10 AND event_type = 'purchase') AS n_accepted
       FROM events""",
)
def p11(t):
    kind = F.col("event_type")
    return op.funnel_counts(
        t.events,
        [("n_targets", kind != "error"), ("n_large", F.col("value") > 10), ("n_accepted", kind == "purchase")],
    )
