"""Queries for G1-G17, J2 and Q1."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import aggs, checks, flow, graph
from factlake.plans.scratch import Scratch
from factlake.queries.graph_data import (
    WITH_CLOSURE,
    WITH_COMP,
    WITH_LINES,
    copies,
    lines,
    supply,
)
from factlake.queries.registry import query
from factlake.queries.sources import MANIFEST_SQL, _manifest_table
from factlake.sources.manifest import manifest_tables


@query("g1_inverse", f"{WITH_LINES} SELECT id, src AS pred FROM nodes LEFT JOIN edges ON dst = id")
def g1(t):
    g = lines(t)
    return graph.inverse(g.edges, g.nodes)


_REACH = """{lines}, reach AS (SELECT id FROM nodes WHERE {seed}
    UNION SELECT {to} FROM reach JOIN edges ON id = {from_})"""


def _reach(seed: str, to: str = "dst", from_: str = "src") -> str:
    return _REACH.format(lines=WITH_LINES, seed=seed, to=to, from_=from_)


@query("g2_reachable", f"{_reach('''flag = 'R' ''')} SELECT id FROM reach")
def g2(t):
    g = lines(t)
    return graph.reachable(g.arcs, g.ids("flag = 'R'"))


@query(
    "j2_split_by_closure",
    f"""{_reach('''flag = 'A' AND status = 'F' ''')}
        SELECT id, id IN (SELECT id FROM reach) AS reached FROM nodes""",
)
def j2(t):
    g = lines(t)
    hit, rest = graph.split_by_closure(g.nodes, g.arcs, g.ids("flag = 'A' AND status = 'F'"))
    return hit.select("id", F.lit(True).alias("reached")).unionByName(
        rest.select("id", F.lit(False).alias("reached"))
    )


@query("g3_transitive_closure", f"{WITH_CLOSURE} SELECT src, dst FROM closure")
def g3(t):
    return graph.transitive_closure(lines(t).arcs)


@query(
    "g3_closure_from_sources",
    f"""{WITH_CLOSURE} SELECT src, dst FROM closure
        WHERE src IN (SELECT id FROM nodes WHERE flag = 'N' AND status = 'O')""",
)
def g3_sources(t):
    g = lines(t)
    return graph.transitive_closure(g.arcs, g.ids("flag = 'N' AND status = 'O'"))


@query(
    "g4_reflexive_closure",
    f"{WITH_CLOSURE} SELECT src, dst FROM closure UNION SELECT id AS src, id AS dst FROM nodes",
)
def g4(t):
    g = lines(t)
    return graph.reflexive_closure(g.arcs, g.nodes)


@query("g5_strong_components", f"{WITH_COMP} SELECT node, comp FROM comp")
def g5(t):
    g = lines(t)
    return graph.strong_components(g.arcs, g.nodes)


@query(
    "g6_condense",
    f"""{WITH_COMP} SELECT DISTINCT a.comp AS src, b.comp AS dst FROM edges
        JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.comp <> b.comp""",
)
def g6(t):
    g = lines(t)
    return graph.condense(g.arcs, graph.strong_components(g.arcs, g.nodes))


@query(
    "g7_post_order",
    f"""{WITH_COMP}, dag AS (SELECT DISTINCT a.comp AS src, b.comp AS dst FROM edges
            JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.comp <> b.comp),
        walk AS (SELECT DISTINCT comp AS id, 0::BIGINT AS level FROM comp
            UNION SELECT d.src, w.level + 1 FROM walk w JOIN dag d ON d.dst = w.id),
        levels AS (SELECT id, max(level) AS level FROM walk GROUP BY id)
        SELECT id, level, row_number() OVER (ORDER BY level, id) AS position FROM levels""",
)
def g7(t):
    g = lines(t)
    comp = graph.strong_components(g.arcs, g.nodes)
    ids = comp.select(F.col("comp").alias("id")).distinct()
    return graph.post_order(graph.condense(g.arcs, comp), ids)


@query("g8_connected_components", f"{WITH_LINES} SELECT id AS node, min(id) OVER (PARTITION BY ord) AS comp FROM nodes")
def g8(t):
    g = lines(t)
    return graph.connected_components(g.arcs, g.nodes)


@query(
    "g8_copy_groups",
    "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS comp FROM documents",
)
def g8_copies(t):
    g = copies(t)
    return graph.connected_components(g.edges, g.nodes)


_SUPPLY = """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, -1 - l_partkey AS b FROM lineitem),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    nodes AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT -1 - p_partkey FROM part),
    least_id AS (SELECT min(id) AS lo FROM nodes WHERE id IN (SELECT a FROM both_ways)),
    hit AS (SELECT lo AS id FROM least_id UNION SELECT b FROM hit JOIN both_ways ON a = id)"""


@query(
    "g8_supply_components",
    # the oracle walks from the smallest linked node and labels the rest as singletons: the whole
    # supply graph is one component, which the second column proves
    f"""{_SUPPLY} SELECT id AS node, CASE WHEN id IN (SELECT id FROM hit)
        THEN (SELECT lo FROM least_id) ELSE id END AS comp FROM nodes""",
)
def g8_supply(t):
    g = supply(t)
    return graph.connected_components(g.edges, g.nodes)


@query(
    "g9_component_members",
    f"""{WITH_LINES} SELECT min(id) OVER w AS comp, id AS member, count(*) OVER w AS size
        FROM nodes WINDOW w AS (PARTITION BY ord)""",
)
def g9(t):
    return graph.component_members(g8(t))


_LABELS = """{lines}, lab AS (SELECT id AS node, status AS label, 0 AS hop FROM nodes WHERE flag = 'R'
    UNION SELECT dst, label, {hop} FROM lab JOIN edges ON node = src {stop})"""


@query(
    "g10_propagate_labels",
    f"""{_LABELS.format(lines=WITH_LINES, hop='0', stop='')} SELECT DISTINCT node, label FROM lab""",
)
def g10(t):
    g = lines(t)
    seeds = g.nodes.filter("flag = 'R'").select(F.col("id").alias("node"), F.col("status").alias("label"))
    return graph.propagate_labels(g.arcs, seeds)


@query(
    "g10_one_hop",
    f"""{_LABELS.format(lines=WITH_LINES, hop='hop + 1', stop='WHERE hop < 1')}
        SELECT DISTINCT node, label FROM lab""",
)
def g10_one_hop(t):
    g = lines(t)
    seeds = g.nodes.filter("flag = 'R'").select(F.col("id").alias("node"), F.col("status").alias("label"))
    return graph.propagate_labels(g.arcs, seeds, max_hops=1)


def _label_tables(g):
    node = F.col("id").alias("node")
    gen = g.nodes.filter("flag = 'R'").select(node, (F.col("supp") % 3).alias("label"))
    kill = g.nodes.filter("status = 'F'").select(node, ((F.col("supp") + 1) % 3).alias("label"))
    need = g.nodes.select(node, F.explode(F.sequence(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("label"))
    more = g.nodes.filter("flag <> 'A'").select(node, F.lit(2).cast("bigint").alias("label"))
    return gen, kill, need.unionByName(more)


_FACTS = f"""{WITH_LINES}, gen AS (SELECT id AS node, supp % 3 AS label FROM nodes WHERE flag = 'R'),
    dead AS (SELECT id AS node, (supp + 1) % 3 AS label FROM nodes WHERE status = 'F'),
    need AS (SELECT id AS node, unnest([0::BIGINT, 1]) AS label FROM nodes
             UNION ALL SELECT id, 2 FROM nodes WHERE flag <> 'A')"""


@query(
    "g11_propagate_blocked",
    f"""{_FACTS}, fact AS (
        SELECT dst AS node, label FROM gen JOIN edges ON src = node
        UNION SELECT dst, f.label FROM fact f JOIN edges ON src = f.node
        WHERE EXISTS (SELECT 1 FROM need n WHERE n.node = f.node AND n.label = f.label)
          AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.node = f.node AND d.label = f.label))
        SELECT node, label FROM fact""",
)
def g11(t):
    g = lines(t)
    gen, kill, need = _label_tables(g)
    return graph.propagate_blocked(g.arcs, gen, kill, need)


@query(
    "g11_backward",
    f"""{_FACTS}, fact AS (
        SELECT src AS node, label FROM gen JOIN edges ON dst = node
        UNION SELECT src, f.label FROM fact f JOIN edges ON dst = f.node
        WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.node = f.node AND d.label = f.label))
        SELECT node, label FROM fact""",
)
def g11_backward(t):
    g = lines(t)
    gen, kill, _ = _label_tables(g)
    return graph.propagate_blocked(g.arcs, gen, kill, direction="backward")


@query(
    "g11_wide_masks",
    f"""{WITH_LINES}, gen AS (SELECT id AS node, supp % 200 AS label FROM nodes WHERE flag = 'R'),
        dead AS (SELECT id AS node, (supp + id) % 200 AS label FROM nodes
                 UNION SELECT id, supp % 200 FROM nodes WHERE status = 'F'),
        fact AS (SELECT dst AS node, label FROM gen JOIN edges ON src = node
        UNION SELECT dst, f.label FROM fact f JOIN edges ON src = f.node
        WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.node = f.node AND d.label = f.label))
        SELECT node, string_agg(label, ',' ORDER BY label) AS labels, count(*) AS n FROM fact GROUP BY node""",
)
def g11_wide_masks(t):
    g = lines(t)
    node = F.col("id").alias("node")
    gen = g.nodes.filter("flag = 'R'").select(node, (F.col("supp") % 200).alias("label"))
    kill = g.nodes.select(node, ((F.col("supp") + F.col("id")) % 200).alias("label"))
    kill = kill.unionByName(g.nodes.filter("status = 'F'").select(node, (F.col("supp") % 200).alias("label")))
    found = graph.propagate_blocked_masks(g.arcs, gen, kill, width=200)
    members = aggs.wide_members(F.col("mask")).cast("array<string>")
    return found.select("node", F.concat_ws(",", members).alias("labels"), aggs.wide_count(F.col("mask")).alias("n"))


@query(
    "n5_dead_writes_flow",
    # a line may read one of its order's variables, writes one and may write a second one
    f"""{WITH_LINES}, log AS (
          SELECT id AS block, 0 AS pos, supp % 3 AS var, false AS w FROM nodes WHERE supp % 2 = 0
          UNION ALL SELECT id, 1, (supp // 3) % 3, true FROM nodes
          UNION ALL SELECT id, 2, (supp // 5) % 3, true FROM nodes WHERE flag <> 'N'),
        heads AS (SELECT block, var, arg_min(w, pos) AS kills FROM log GROUP BY block, var),
        needed AS (SELECT block, var FROM heads WHERE NOT kills
          UNION SELECT e.src, n.var FROM needed n JOIN edges e ON e.dst = n.block
          WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.block = e.src AND h.var = n.var AND h.kills)),
        marked AS (SELECT *, lead(w) OVER (PARTITION BY block, var ORDER BY pos) AS nxt FROM log)
        SELECT block, pos, var FROM marked m WHERE w AND (nxt OR nxt IS NULL AND NOT EXISTS (
          SELECT 1 FROM edges e JOIN needed n ON n.block = e.dst WHERE e.src = m.block AND n.var = m.var))""",
)
def n5_flow(t):
    g = lines(t)
    row = lambda pos, div, write: [
        F.col("id").alias("block"), F.lit(pos).alias("pos"), (F.floor(F.col("supp") / div) % 3).alias("var"), F.lit(write).alias("w")
    ]
    log = g.nodes.filter("supp % 2 = 0").select(*row(0, 1, False)).unionByName(g.nodes.select(*row(1, 3, True)))
    log = log.unionByName(g.nodes.filter("flag <> 'N'").select(*row(2, 5, True)))
    dead = flow.dead_writes_flow(log, g.edges, block="block", key=["var"], order=["pos"], is_write=F.col("w"))
    return dead.select("block", "pos", "var")


@query(
    "j7_dominating_source",
    # each line may also go on to the next line with its flag; open lines are sources, returned lines checks
    f"""{WITH_LINES}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE dst < src),
        first AS (SELECT ord, min(id) AS entry FROM nodes GROUP BY ord),
        sources AS (SELECT id FROM nodes WHERE supp % 3 = 0),
        around AS (SELECT s.id AS dom, entry AS node FROM sources s JOIN nodes USING (id) JOIN first USING (ord) WHERE s.id <> entry
          UNION SELECT a.dom, w.dst FROM around a JOIN ways w ON w.src = a.node WHERE w.dst <> a.dom),
        doms AS (SELECT d.ord, d.id AS dom, n.id AS node FROM nodes d JOIN nodes n ON d.ord = n.ord AND d.id <> n.id
          WHERE d.id IN (SELECT id FROM sources) AND NOT EXISTS (SELECT 1 FROM around a WHERE a.dom = d.id AND a.node = n.id)),
        depth AS (SELECT node AS dom, count(*) AS k FROM doms GROUP BY node)
        SELECT entry, node AS id, arg_max(doms.dom, coalesce(k, 0)) AS source_id
        FROM doms JOIN first USING (ord) LEFT JOIN depth ON depth.dom = doms.dom
        WHERE node IN (SELECT id FROM nodes WHERE flag = 'R') GROUP BY entry, node""",
)
def j7_flow(t):
    g = lines(t)
    ways = g.edges.unionByName(graph.swap(g.edges.filter("dst < src")))
    entries = g.nodes.groupBy("ord").agg(F.min("id").alias("id"))
    here = F.col("id").alias("block")
    return flow.dominating_source(
        g.nodes.filter("flag = 'R'").select("id", here), g.nodes.filter("supp % 3 = 0").select("id", here), ways, entries
    )


@query(
    "g12_taint",
    f"{_reach('''status = 'F' AND flag = 'N' ''')} SELECT id, id NOT IN (SELECT id FROM reach) AS value FROM nodes",
)
def g12(t):
    g = lines(t)
    hidden = g.nodes.filter("flag = 'none'")
    return graph.taint(g.arcs, g.nodes, g.ids("status = 'F' AND flag = 'N'"), hidden)


@query("g12_taint_reaches_top", f"{WITH_LINES} SELECT id, false AS value FROM nodes")
def g12_top(t):
    g = lines(t)
    return graph.taint(g.arcs, g.nodes, g.ids("status = 'F'"), g.ids("flag = 'A'"))


@query("g13_reverse_taint", f"{_reach('''supp % 2 = 0 AND flag = 'A' ''', 'src', 'dst')} SELECT id FROM reach")
def g13(t):
    g = lines(t)
    return graph.reverse_taint(g.arcs, g.ids("supp % 2 = 0 AND flag = 'A'"))


@query(
    "g14_unreachable",
    f"{_reach('''status = 'O' AND flag = 'N' ''')} SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM reach)",
)
def g14(t):
    g = lines(t)
    return graph.unreachable(g.nodes, g.arcs, g.ids("status = 'O' AND flag = 'N'")).select("id")


@query(
    "g14_pruned_edges",
    f"""{_reach('''status = 'O' AND flag = 'N' ''')} SELECT src, dst FROM edges
        WHERE src IN (SELECT id FROM reach) AND dst IN (SELECT id FROM reach)""",
)
def g14_edges(t):
    g = lines(t)
    return graph.prune_unreachable(g.nodes, g.edges, g.ids("status = 'O' AND flag = 'N'"))[1]


@query(
    "g15_lineage_producers",
    f"""{WITH_LINES}, cut AS (SELECT ord AS owner, id % 8 AS local FROM nodes WHERE status = 'F' AND supp % 3 = 0),
        flows AS (
          SELECT ord AS owner, (id % 8) - 1 AS dst, ord AS from_owner, id % 8 AS src FROM nodes
          UNION SELECT ord, id % 8, supp, 0 FROM nodes WHERE flag = 'N'),
        live AS (SELECT * FROM flows f
                 WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.owner = f.owner AND c.local = f.dst)),
        fact AS (
          SELECT ord AS owner, id % 8 AS local FROM nodes n WHERE flag = 'R'
            AND NOT EXISTS (SELECT 1 FROM cut c WHERE c.owner = n.ord AND c.local = n.id % 8)
          UNION SELECT l.owner, l.dst FROM fact f JOIN live l ON f.owner = l.from_owner AND f.local = l.src)
        SELECT DISTINCT owner FROM fact WHERE local = 0""",
)
def g15(t):
    g = lines(t)
    local = F.col("id") % 8
    owner = F.col("ord").alias("owner")
    copies_ = g.nodes.select(owner, (local - 1).alias("dst"), local.alias("src"))
    calls = g.nodes.filter("flag = 'N'").select(owner, local.alias("dst"), F.col("supp").alias("callee"))
    seeds = g.nodes.filter("flag = 'R'").select(owner, local.alias("dst"))
    cut = g.nodes.filter("status = 'F' AND supp % 3 = 0").select(owner, local.alias("local"))
    return graph.lineage_producers(copies_, calls, seeds, cut)


@query(
    "g16_reach_summary",
    f"""{WITH_CLOSURE}, seen AS (
          SELECT id, supp AS label FROM nodes WHERE flag = 'R'
          UNION SELECT c.src, n.supp FROM closure c JOIN nodes n ON n.id = c.dst AND n.flag = 'R'),
        s AS (SELECT n.id, count(DISTINCT label) AS k, min(label) AS v FROM nodes n
              LEFT JOIN seen USING (id) GROUP BY n.id)
        SELECT id, CASE k WHEN 0 THEN 'top' WHEN 1 THEN 'elem' ELSE 'bottom' END AS state,
               CASE WHEN k = 1 THEN v END AS value FROM s""",
)
def g16(t):
    g = lines(t)
    labels = g.nodes.filter("flag = 'R'").select("id", F.col("supp").alias("label"))
    return graph.reach_summary(g.arcs, g.nodes, labels)


_EXPANDED = f"""{MANIFEST_SQL},
    visits AS (SELECT o, n, i, source, exe FROM t JOIN src USING (o, n)),
    numbered AS (SELECT 'o' || o AS folder, 'o' || o || '/' || source AS leaf,
        row_number() OVER (PARTITION BY o ORDER BY exe, n, i) - 1 AS number FROM visits)"""


@query("g17_expand_dependencies", f"{_EXPANDED} SELECT folder, leaf, number FROM numbered")
def g17(t):
    docs = _manifest_table(t)
    targets, deps = manifest_tables(docs.df)
    # the manifests are parsed and checked, and no longer read
    Scratch(t.spark, "docs").drop(docs.path)
    name = F.concat(F.col("folder"), F.lit("/"), F.col("artifact"))
    arcs = deps.select(
        name.alias("parent"), "pos", F.concat(F.col("folder"), F.lit("/"), F.col("dep")).alias("child")
    )
    roots = targets.filter("type = 'EXECUTABLE'").select(name.alias("node"))
    found = graph.expand_dependencies(arcs, roots, F.col("node").endswith(".c"))
    return found.select(F.regexp_extract("root", "^([^/]*)/", 1).alias("folder"), "leaf", "number")


@query(
    "g17_leaf_numbers",
    f"{_EXPANDED} SELECT folder, leaf, max(number) AS number FROM numbered GROUP BY folder, leaf",
)
def g17_last(t):
    found = g17(t).withColumnRenamed("folder", "root")
    return graph.leaf_numbers(found).withColumnRenamed("root", "folder")


@query(
    "g17_leaf_numbers_by_counts",
    # a line depends on the next line, on the next line with its flag and on its supplier, the leaf
    f"""{WITH_LINES}, deps AS (
          SELECT id AS parent, 0 AS pos, lead(id) OVER (PARTITION BY ord ORDER BY id) AS child FROM nodes QUALIFY child IS NOT NULL
          UNION ALL SELECT id, 1, lead(id) OVER (PARTITION BY ord, flag ORDER BY id) AS child FROM nodes QUALIFY child IS NOT NULL
          UNION ALL SELECT id, 2, -1 - supp FROM nodes),
        visits AS (SELECT min(id) AS root, min(id) AS node, []::INTEGER[] AS path FROM nodes GROUP BY ord
          UNION ALL SELECT root, child, list_append(path, pos) FROM visits JOIN deps ON parent = node),
        numbered AS (SELECT root, node AS leaf, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS number FROM visits WHERE node < 0)
        SELECT root, leaf, max(number) AS number FROM numbered GROUP BY root, leaf""",
)
def g17_counts(t):
    g = lines(t)
    arc = lambda pos, child: [F.col("id").alias("parent"), F.lit(pos).alias("pos"), child.alias("child")]
    deps = g.links.filter("_next IS NOT NULL").select(*arc(0, F.col("_next")))
    same = g.links.filter("_after IS NOT NULL").select(*arc(1, F.col("_after")))
    deps = deps.unionByName(same).unionByName(g.nodes.select(*arc(2, -1 - F.col("supp"))))
    roots = g.nodes.groupBy("ord").agg(F.min("id").alias("node"))
    return graph.leaf_numbers_by_counts(deps, roots, F.col("node") < 0)


@query(
    "q1_open_edges",
    f"""{WITH_LINES} SELECT src, dst FROM edges
        WHERE dst NOT IN (SELECT id FROM nodes WHERE status = 'F')""",
)
def q1(t):
    g = lines(t)
    return checks.open_edges(g.edges, g.nodes.filter("status = 'F'"))
