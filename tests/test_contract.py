"""Chains and rings take few rounds; results are those of plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import graph
from factlake.operators.checks import CheckFailed
from factlake.plans.contract import contract_all, no_values
from factlake.plans.scratch import Scratch
from tests.helpers import closure, edges, nodes, reach, rows, strong


@pytest.fixture
def writes(monkeypatch):
    """Counts the tables that an operator writes."""
    count = []
    for name in ("save", "put"):
        plain = getattr(Scratch, name)
        monkeypatch.setattr(Scratch, name, lambda self, df, label="t", plain=plain: (count.append(label), plain(self, df, label))[1])
    return count


def rounds(writes):
    """Doublings of pointers, states of loops and new facts of closures."""
    return sum(label in ("p", "s", "d") for label in writes)


def chain(n, first=0):
    return [(first + i, first + i + 1) for i in range(n - 1)]


def test_long_chains_and_rings(spark, writes):
    ring = [*chain(1000, 5000), (5999, 5000)]
    pairs = [*chain(1000), *ring]
    e, n = edges(spark, pairs), nodes(spark, {i for p in pairs for i in p})
    comp = dict(rows(graph.strong_components(e, n)))
    assert all(comp[i] == i for i in range(1000)) and all(comp[i] == 5000 for i in range(5000, 6000))
    assert rounds(writes) <= 25
    writes.clear()
    levels = {r.id: r.level for r in graph.sink_levels(edges(spark, chain(1000)), nodes(spark, range(1000))).collect()}
    assert levels == {i: 999 - i for i in range(1000)}
    assert rounds(writes) <= 25
    writes.clear()
    labels = spark.createDataFrame([(700, 7), (5500, 1), (5501, 2)], "id bigint, label bigint")
    got = {r.id: (r.state, r.value) for r in graph.reach_summary(e, n, labels).collect()}
    assert all(got[i] == (("elem", 7) if i <= 700 else ("top", None)) for i in range(1000))
    assert all(got[i] == ("bottom", None) for i in range(5000, 6000))
    assert rounds(writes) <= 25


def test_closure_of_a_ring_from_one_source(spark, writes):
    ring = [*chain(1000), (999, 0), (999, 2000)]
    got = graph.transitive_closure(edges(spark, ring), nodes(spark, [17]))
    assert rows(got) == [(17, i) for i in [*range(1000), 2000]]
    assert rounds(writes) <= 35


def test_closed_edges(spark):
    e, n = edges(spark, [(1, 2), (2, 9)]), nodes(spark, [1, 2])
    with pytest.raises(CheckFailed):
        graph.transitive_closure(e, nodes=n)
    with pytest.raises(CheckFailed):
        graph.reflexive_closure(e, n)
    assert rows(graph.transitive_closure(e)) == [(1, 2), (1, 9), (2, 9)]


def test_random_graphs_with_chains(spark):
    pairs, ids, own = [], [], {}
    for seed in range(12):
        rnd = random.Random(seed)
        n, base = 14, 1000 * seed
        some = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(4, 18))}
        at = n
        for a, b in list(some):
            if rnd.random() < 0.6:  # the edge becomes a chain
                some.discard((a, b))
                more = [a, *range(at, at + rnd.randint(1, 6)), b]
                at += len(more) - 2
                some |= set(zip(more, more[1:]))
        ring = range(at, at + seed % 5)
        some |= set(zip(ring, [*ring[1:], *ring[:1]]))
        at += len(ring)
        pairs += [(base + a, base + b) for a, b in some]
        ids += range(base, base + at)
        own |= {base + i: rnd.randrange(3) for i in range(at) if rnd.random() < 0.15}
    e, n = edges(spark, pairs).cache(), nodes(spark, ids).cache()
    want = strong(pairs, ids)
    assert dict(rows(graph.strong_components(e, n))) == want
    assert rows(graph.transitive_closure(e, nodes=n)) == sorted(closure(pairs, ids))
    labels = spark.createDataFrame(list(own.items()), "id bigint, label bigint")
    got = {r.id: (r.state, r.value) for r in graph.reach_summary(e, n, labels).collect()}
    for i in ids:
        seen = {own[j] for j in reach(pairs, [i]) if j in own}
        assert got[i] == (("top", None) if not seen else ("elem", *seen) if len(seen) == 1 else ("bottom", None))
    dag = sorted({(want[a], want[b]) for a, b in pairs if want[a] != want[b]})
    comps = set(want.values())
    levels = {r.id: r.level for r in graph.sink_levels(edges(spark, dag), nodes(spark, comps)).collect()}
    depth = lambda i: max((1 + depth(b) for a, b in dag if a == i), default=0)
    assert levels == {i: depth(i) for i in comps}


def test_chains_of_diamonds_contract_again(spark):
    some = [p for i in range(40) for p in [(3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3)]]
    scratch = Scratch(spark, "test")
    arcs = scratch.save(edges(spark, some).withColumn("steps", F.lit(1).cast("bigint")), "e")
    left, _, passes = contract_all(scratch, arcs, no_values(nodes(spark, [1])))
    assert len(passes) == 2 and rows(left.df) == [(0, 120, 80)]


def test_levels_reject_a_ring(spark):
    with pytest.raises(ValueError, match="cycles"):
        graph.sink_levels(edges(spark, [(1, 2), (2, 3), (3, 1)]), nodes(spark, [1, 2, 3]))
