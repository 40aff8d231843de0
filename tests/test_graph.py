import random

import pytest

from factlake.operators import graph
from factlake.operators.checks import CheckFailed, assert_edges_closed
from factlake.plans.loop import NotConverged
from tests.helpers import closure, components, edges, nodes, reach, rows, strong, table

SHAPES = {
    "empty": ([], [1, 2]),
    "self loop": ([(1, 1)], [1, 2]),
    "two-node cycle": ([(1, 2), (2, 1)], [1, 2, 3]),
    "chain": ([(i, i + 1) for i in range(20)], list(range(22))),
    "cycle with tails": ([(1, 2), (2, 3), (3, 1), (0, 1), (3, 4), (4, 5), (6, 5)], list(range(8))),
}
for seed, (n, m) in enumerate([(12, 14), (15, 30), (25, 26)]):
    rnd = random.Random(seed)
    SHAPES[f"random {seed}"] = (
        sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}),
        list(range(n)),
    )


@pytest.fixture(scope="module")
def shape(spark):
    """All shapes side by side in one graph, so that each operator runs once."""
    pairs, ids = [], []
    for i, (some, names) in enumerate(SHAPES.values()):
        pairs += [(1000 * i + a, 1000 * i + b) for a, b in some]
        ids += [1000 * i + n for n in names]
    return pairs, ids, edges(spark, pairs).cache(), nodes(spark, ids).cache()


def test_empty_graph(spark):
    e, n = edges(spark, []), nodes(spark, [1, 2])
    assert rows(graph.transitive_closure(e)) == []
    assert rows(graph.strong_components(e, n)) == [(1, 1), (2, 2)]
    assert rows(graph.connected_components(e, n)) == [(1, 1), (2, 2)]
    assert rows(graph.reachable(e, nodes(spark, [1]))) == [(1,)]


def test_closures(shape):
    pairs, ids, e, n = shape
    full = closure(pairs, ids)
    assert rows(graph.transitive_closure(e)) == sorted(full)
    assert rows(graph.reflexive_closure(e, n)) == sorted(full | {(i, i) for i in ids})


def test_components(shape):
    pairs, ids, e, n = shape
    assert dict(rows(graph.connected_components(e, n))) == components(pairs, ids)


def test_strong_components_and_order(shape):
    pairs, ids, e, n = shape
    want = strong(pairs, ids)
    comp = graph.strong_components(e, n)
    assert dict(rows(comp)) == want
    dag = graph.condense(e, comp)
    arcs = sorted({(want[a], want[b]) for a, b in pairs if want[a] != want[b]})
    assert rows(dag) == arcs
    order = graph.post_order(dag, comp.selectExpr("comp AS id").distinct())
    place = {r["id"]: r["position"] for r in order.collect()}
    assert sorted(place.values()) == list(range(1, len(set(want.values())) + 1))
    assert all(place[b] < place[a] for a, b in arcs)


def test_reach_and_split(shape, spark):
    pairs, ids, e, n = shape
    start = ids[::9]
    seeds = nodes(spark, start)
    want = reach(pairs, start)
    assert rows(graph.reachable(e, seeds)) == [(i,) for i in sorted(want)]
    hit, rest = graph.split_by_closure(n, e, seeds)
    assert {i for (i,) in rows(hit)} == want & set(ids)
    assert {i for (i,) in rows(rest)} == set(ids) - want
    kept, arcs = graph.prune_unreachable(n, e, seeds)
    assert rows(arcs) == sorted((a, b) for a, b in pairs if a in want and b in want)


def test_reach_summary(shape, spark):
    pairs, ids, e, n = shape
    labels = {i: f"l{i % 3}" for i in ids if i % 2}
    found = rows(graph.reach_summary(e, n, table(spark, labels.items(), "id bigint, label string")))
    for i, state, value in found:
        seen = {labels[j] for j in reach(pairs, [i]) if j in labels}
        want = ("top", None) if not seen else ("elem", *seen) if len(seen) == 1 else ("bottom", None)
        assert (state, value) == want


def _flow(pairs, gen, kill, need):
    entry = set()
    while True:
        out = {(n, x) for n, x in entry if (need is None or (n, x) in need) and (n, x) not in kill} | gen
        new = {(b, x) for a, b in pairs for n, x in out if n == a}
        if new <= entry:
            return entry
        entry |= new


def test_propagate_blocked(shape, spark):
    pairs, ids, e, _ = shape
    rnd = random.Random(7)
    facts = [(i, x) for i in ids for x in "pq"]
    pick = lambda k: set(rnd.sample(facts, max(1, len(facts) // k)))
    gen, kill, need = pick(3), pick(4), pick(2)
    t = lambda s: table(spark, s, "node bigint, label string")
    assert rows(graph.propagate_blocked(e, t(gen), t(kill), t(need)), "node", "label") == sorted(
        _flow(pairs, gen, kill, need)
    )
    back = [(b, a) for a, b in pairs]
    got = graph.propagate_blocked(e, t(gen), t(kill), direction="backward")
    assert rows(got, "node", "label") == sorted(_flow(back, gen, kill, None))


def test_labels_and_hops(shape, spark):
    pairs, ids, e, _ = shape
    seeds = {(i, f"l{i % 2}") for i in ids[::7]}
    t = table(spark, seeds, "node bigint, label string")
    want = {(j, x) for i, x in seeds for j in reach(pairs, [i])}
    assert rows(graph.propagate_labels(e, t), "node", "label") == sorted(want)
    hop = seeds | {(b, x) for a, b in pairs for i, x in seeds if i == a}
    assert rows(graph.propagate_labels(e, t, max_hops=1), "node", "label") == sorted(hop)


def test_skewed_graphs(hot, spark):
    star = [(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 40)] + [(200, 201)]
    ids = sorted({x for p in star for x in p})
    e, n = edges(spark, star), nodes(spark, ids)
    comp = graph.connected_components(e, n)
    assert dict(rows(comp)) == components(star, ids)
    sizes = {r["comp"]: r["size"] for r in graph.component_members(comp).collect()}
    assert sizes == {0: 79, 200: 2}
    ring = [(i, (i + 1) % 30) for i in range(30)]
    got = graph.strong_components(edges(spark, ring), nodes(spark, range(31)))
    assert dict(rows(got)) == {**dict.fromkeys(range(30), 0), 30: 30}


def test_call_graph_case(spark):
    pairs = [("f", "cond"), ("f", "g"), ("g", "h"), ("h", "cond"), ("h", "f"), ("h", "g"), ("h", "l"), ("m", "g")]
    comp = graph.strong_components(
        edges(spark, pairs, "string"), nodes(spark, ["f", "g", "h", "m", "l", "cond"], "string")
    )
    groups = {}
    for node, c in rows(comp):
        groups.setdefault(c, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [["cond"], ["f", "g", "h"], ["l"], ["m"]]


@pytest.mark.parametrize(
    "pairs, seed, want",
    [
        ([("f1", "f0"), ("f2", "f1"), ("f3", "f2")], "f0", ["f0", "f1", "f2", "f3"]),
        ([("f1", "f0"), ("f1", "f3"), ("f2", "f1"), ("f3", "f2")], "f0", ["f0", "f1", "f2", "f3"]),
        ([("g0", "g2"), ("g1", "g0"), ("g2", "g1")], "f", ["f"]),
    ],
)
def test_callers_of_a_flagged_node(spark, pairs, seed, want):
    got = graph.reverse_taint(edges(spark, pairs, "string"), nodes(spark, [seed], "string"))
    assert [i for (i,) in rows(got)] == want


def test_unreachable_case(spark):
    n = nodes(spark, ["main", "f", "g"], "string")
    gone = graph.unreachable(n, edges(spark, [("f", "g")], "string"), nodes(spark, ["main"], "string"))
    assert rows(gone) == [("f",), ("g",)]


def test_greatest_model(spark):
    e, v = edges(spark, [(2, 3), (3, 4), (5, 6)]), nodes(spark, range(2, 8))
    value = lambda b, t: dict(rows(graph.taint(e, v, nodes(spark, b), nodes(spark, t))))
    assert value([2], [5]) == {2: False, 3: False, 4: False, 5: True, 6: True, 7: True}
    assert value([2], [4]) == dict.fromkeys(range(2, 8), False)
    assert value([], [4]) == dict.fromkeys(range(2, 8), True)


def test_producers(spark):
    # a: result <- 1 <- seed.  b: result <- a().  c and d call each other, d also has a seed.
    copies = table(spark, [("a", 0, 1), ("e", 0, 1), ("c", 0, 3)], "owner string, dst bigint, src bigint")
    calls = table(
        spark, [("b", 0, "a"), ("c", 3, "d"), ("d", 0, "c"), ("f", 0, "e")], "owner string, dst bigint, callee string"
    )
    seeds = table(spark, [("a", 1), ("e", 1), ("d", 0)], "owner string, dst bigint")
    cut = table(spark, [("e", 1)], "owner string, local bigint")
    assert rows(graph.lineage_producers(copies, calls, seeds, cut)) == [("a",), ("b",), ("c",), ("d",)]


def test_find_and_equiv(spark):
    comp = graph.connected_components(edges(spark, [(1, 2), (4, 3)]), nodes(spark, range(1, 6)))
    assert rows(graph.find(comp, nodes(spark, [2, 4, 9]))) == [(2, 1), (4, 3), (9, None)]
    asked = table(spark, [(1, 2), (1, 3), (1, 9)], "a bigint, b bigint")
    got = {(r["a"], r["b"]): r["equiv"] for r in graph.equiv(comp, asked).collect()}
    assert got == {(1, 2): True, (1, 3): False, (1, 9): None}


@pytest.mark.parametrize(
    "unions",
    [[], [(1, 2), (2, 3), (3, 4)], [(1, 2), (3, 4)], [(1, 2), (2, 1), (1, 2)], [(4, 1), (3, 2), (1, 2)], [(5, 1), (1, 2), (2, 3)]],
)
def test_union_order_does_not_matter(spark, unions):
    ids = range(1, 6)
    got = graph.connected_components(edges(spark, unions[::-1]), nodes(spark, ids))
    assert dict(rows(got)) == components(unions, ids)


def test_inverse_keeps_isolated_nodes(spark):
    got = graph.inverse(edges(spark, [(1, 2), (3, 2)]), nodes(spark, [1, 2, 3]))
    assert rows(got) == [(1, None), (2, 1), (2, 3), (3, None)]
    with pytest.raises(CheckFailed):
        graph.inverse(edges(spark, [(1, 9)]), nodes(spark, [1]))
    assert_edges_closed(edges(spark, [(9, 1)]), nodes(spark, [1]))


def test_expand_dependencies(spark):
    from pyspark.sql import functions as F

    deps = table(
        spark,
        [("exe", 0, "lib"), ("exe", 1, "x.c"), ("lib", 0, "y.c"), ("lib", 1, "x.c"), ("lib", 2, "sub"), ("sub", 0, "z.c")],
        "parent string, pos bigint, child string",
    )
    leaf = F.col("node").endswith(".c")
    roots = table(spark, [("exe",)], "node string")
    got = graph.expand_dependencies(deps, roots, leaf)
    visits = [r["leaf"] for r in got.orderBy("number").collect()]
    assert visits == ["y.c", "x.c", "z.c", "x.c"]
    assert rows(graph.leaf_numbers(got), "leaf", "number") == [("x.c", 3), ("y.c", 0), ("z.c", 2)]
    loop = table(spark, [("exe", 0, "exe")], "parent string, pos bigint, child string")
    with pytest.raises(NotConverged):
        graph.expand_dependencies(loop, roots, leaf, max_depth=4)
    with pytest.raises(ValueError):
        graph.expand_dependencies(deps.filter("parent <> 'sub'"), roots, leaf)


def test_expansion_keeps_only_what_is_read(spark, monkeypatch):
    from pathlib import Path

    from pyspark.sql import functions as F

    from factlake.plans.scratch import Scratch

    kept, place = [], Scratch.path
    monkeypatch.setattr(Scratch, "path", lambda self, label="t": kept.append(path := place(self, label)) or path)
    deps = table(spark, [("exe", 0, "lib"), ("exe", 1, "x.c"), ("lib", 0, "y.c"), ("lib", 1, "x.c")], "parent string, pos bigint, child string")
    got = graph.expand_dependencies(deps, table(spark, [("exe",)], "node string"), F.col("node").endswith(".c"))
    found = {Path(f.removeprefix("file:")).parent for f in got.inputFiles()}
    there = {Path(p) for p in kept if Path(p).exists() and not Path(p).name.startswith("x")}
    assert there == found and len(kept) > len(there) == 2
    assert rows(got, "leaf", "number") == [("x.c", 1), ("x.c", 2), ("y.c", 0)]
    # without roots there is nothing to expand
    none = table(spark, [], "node string")
    assert graph.expand_dependencies(deps, none, F.col("node").endswith(".c")).collect() == []


def test_writes_leave_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from factlake.plans.scratch import Scratch

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    held = lambda: {b for b in files().mkString(" ").split() if b.startswith("shuffle_")}
    scratch, before = Scratch(spark, "test"), held()
    sums = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    for made in (lambda: scratch.put(sums.orderBy("k")).df.collect(), lambda: scratch.some(sums)):
        assert made()
        until = time.time() + 10
        while held() - before and time.time() < until:
            time.sleep(0.2)
        assert not held() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_rounds_are_bounded_loudly(spark):
    chain = edges(spark, [(i, i + 1) for i in range(9)])
    with pytest.raises(NotConverged):
        graph.reachable(chain, nodes(spark, [0]), max_rounds=3)
