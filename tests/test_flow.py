import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import aggs, flow, graph, windows
from tests.helpers import edges, reach, rows, table

EMPTY = ([], [0])


def flow_graphs():
    """Graphs of disjoint ids, each entered at its first node; some nodes are out of reach."""
    out = [EMPTY, ([(100, 101), (100, 102), (101, 103), (102, 103), (103, 103)], [100, 101, 102, 103])]
    for seed in range(4):
        rnd, base = random.Random(seed), 1000 * (seed + 1)
        out.append((sorted({(base + rnd.randrange(9), base + rnd.randrange(9)) for _ in range(14)}), [base + i for i in range(9)]))
    return out


def strict_dominators(pairs, entry):
    seen = reach(pairs, [entry])
    around = {s: set() if s == entry else reach([(a, b) for a, b in pairs if s not in (a, b)], [entry]) for s in seen}
    return {v: {s for s in seen if s != v and v not in around[s]} for v in seen}


def test_dominators(spark):
    graphs = flow_graphs()
    pairs = [e for some, _ in graphs for e in some]
    entries = table(spark, [(ids[0],) for _, ids in graphs], "id bigint")
    want = {(ids[0], s, v) for some, ids in graphs for v, doms in strict_dominators(some, ids[0]).items() for s in doms}
    assert set(rows(flow.dominators(edges(spark, pairs), entries))) == want
    nearest = {}
    for some, ids in graphs:
        doms = strict_dominators(some, ids[0])
        nearest |= {(ids[0], v): max(found, key=lambda s: len(doms[s])) for v, found in doms.items() if found}
    got = rows(flow.immediate_dominators(edges(spark, pairs), entries), "entry", "node", "idom")
    assert len(got) == len(nearest) and {(e, v): s for e, v, s in got} == nearest
    # sources in some blocks, two in one; a check's own block does not count
    sources = [(v * 10 + j, v) for some, ids in graphs for v in ids[::2] for j in (1, 2)]
    checks = [(7_000_000 + v, v) for _, ids in graphs for v in ids]
    found = flow.dominating_source(
        table(spark, checks, "id bigint, block bigint"), table(spark, sources, "id bigint, block bigint"), edges(spark, pairs), entries
    )
    expected = []
    for some, ids in graphs:
        doms = strict_dominators(some, ids[0])
        for v, above in doms.items():
            if above := above & set(ids[::2]):
                expected.append((ids[0], 7_000_000 + v, max(above, key=lambda s: len(doms[s])) * 10 + 2))
    assert rows(found) == sorted(expected)


def brute_dead(log, pairs):
    """Every path by rows: a write is dead if no walk from it meets a read before a write."""
    by_block = {}
    for b, t, k, kind in sorted(log):
        by_block.setdefault(b, []).append((t, k, kind))
    dead = []
    for b, t, k, kind in log:
        if kind != "w":
            continue
        todo, seen, live = [(b, t)], set(), False
        while todo:
            block, after = todo.pop()
            following = [x for at, key, x in by_block.get(block, []) if key == k and at > after]
            if following:
                live |= following[0] == "r"
                continue
            for a, to in pairs:
                if a == block and to not in seen:
                    seen.add(to)
                    todo.append((to, -1))
        if not live:
            dead.append((b, t))
    return sorted(dead)


def test_dead_writes_over_branches(spark):
    rnd = random.Random(5)
    pairs = [e for some, _ in flow_graphs() for e in some]
    blocks = sorted({b for e in pairs for b in e})
    log = [(b, t, rnd.choice("xyz"), rnd.choice("wwr")) for b in blocks for t in range(rnd.randrange(5))]
    df = table(spark, [*log, (None, 0, "x", "w"), (blocks[0], 9, None, "w")], "b bigint, t int, k string, kind string")
    got = flow.dead_writes_flow(df, edges(spark, pairs), block="b", key=["k"], order=["t"], is_write=F.col("kind") == "w")
    assert rows(got, "b", "t") == brute_dead(log, pairs)


def test_one_block_is_the_linear_case(spark):
    log = [(b, t, "xy"[t % 2], "wwr"[(b * t + t) % 3]) for b in range(5) for t in range(12)]
    df = table(spark, log, "b bigint, t int, k string, kind string")
    args = {"order": ["t"], "is_write": F.col("kind") == "w", "excluded": table(spark, [(3,)], "b bigint"), "owner": "b"}
    got = flow.dead_writes_flow(df, edges(spark, []), block="b", key=["k"], **args)
    assert rows(got) == rows(windows.dead_writes(df, ["b", "k"], **args)) != []


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_blocked_masks_agree(spark, direction):
    rnd = random.Random(9)
    pairs = [e for some, _ in flow_graphs() for e in some]
    ids = sorted({b for e in pairs for b in e})
    facts = lambda n: table(spark, [(rnd.choice(ids), rnd.choice([0, 63, 64, 127, 128, 199])) for _ in range(n)], "node bigint, label int")
    gen, kill, need = facts(20), facts(30), facts(80) if direction == "forward" else None
    got = graph.propagate_blocked_masks(edges(spark, pairs), gen, kill, need, width=200, direction=direction)
    flat = got.select("node", F.explode(aggs.wide_members(F.col("mask"))).alias("label"))
    want = graph.propagate_blocked(edges(spark, pairs), gen, kill, need, direction=direction)
    assert rows(flat) == rows(want) != []
    assert got.count() == flat.select("node").distinct().count()


def test_label_outside_a_mask(spark):
    with pytest.raises(Exception, match="outside"):
        graph.propagate_blocked_masks(edges(spark, [(1, 2)]), table(spark, [(1, 64)], "node bigint, label int"), width=64).collect()


def test_leaf_numbers_by_counts(spark):
    rnd = random.Random(3)
    deps = [(i, p, rnd.choice([j for j in range(i + 1, 14)] + [None])) for i in range(10) for p in range(3)]
    df = table(spark, [*deps, deps[0], (40, 0, 41), (41, 0, 40)], "parent int, pos int, child int")
    starts = table(spark, [(0,), (2,), (12,), (0,)], "node int")
    leaf = F.col("node").between(10, 13)
    want = graph.leaf_numbers(graph.expand_dependencies(df, starts.distinct(), leaf))
    assert rows(graph.leaf_numbers_by_counts(df, starts, leaf)) == rows(want) != []
    with pytest.raises(ValueError, match="cycle"):
        graph.leaf_counts(df, table(spark, [(41,)], "node int"), leaf)
    with pytest.raises(ValueError, match="no dependencies"):
        graph.leaf_counts(df, table(spark, [(50,)], "node int"), leaf)


def test_a_deep_diamond_has_no_row_for_each_visit(spark):
    deep = 30
    deps = [(i, p, i + 1) for i in range(deep) for p in (0, 1)]
    got = graph.leaf_numbers_by_counts(table(spark, deps, "parent int, pos int, child int"), table(spark, [(0,)], "node int"), F.col("node") == deep)
    assert rows(got) == [(0, deep, 2**deep - 1)]
