"""The structural-equality cases: the same names declared in two sources."""

import pytest

from factlake.operators import dedup
from tests.helpers import rows, table

NODE = "id string, name string, generated boolean"
FIELD = "id string, pos bigint, name string, type string, child string"


def source(tag, records):
    """``records`` maps a name to its fields; a field type ``*x`` points to x and ``=x`` holds it."""
    nodes, fields = [], []
    for name, body in records.items():
        nodes.append((f"{tag}.{name}", name.split("#")[0], "#" in name))
        for pos, (field, kind) in enumerate(body or []):
            child = f"{tag}.{kind[1:]}" if kind[0] in "*=" else None
            fields.append((f"{tag}.{name}", pos, field, kind[0] if child else kind, child))
    return nodes, fields


I, U = ("y", "i32"), ("y", "u32")
CASES = {
    "simple": ({"s": [("x", "i32")]}, {"s": [("x", "i32")]}, True),
    "simple, other type": ({"s": [("x", "i32")]}, {"s": [("x", "u32")]}, False),
    "unnamed": ({"t#": [("x", "i32")], "s": [("x", "=t#"), I]}, {"t#0": [("x", "i32")], "s": [("x", "=t#0"), I]}, True),
    "unnamed, outer differs": ({"t#": [("x", "i32")], "s": [("x", "=t#"), I]}, {"t#0": [("x", "i32")], "s": [("x", "=t#0"), U]}, False),
    "recursion": ({"s": [("x", "*s"), I]}, {"s": [("x", "*s"), I]}, True),
    "recursion, other type": ({"s": [("x", "*s"), I]}, {"s": [("x", "*s"), U]}, False),
    "mutual": ({"s": [("x", "*t"), I], "t": [("x", "*s"), I]}, {"s": [("x", "*t"), I], "t": [("x", "*s"), I]}, True),
    "mutual, one leaf differs": ({"s": [("x", "*t"), I], "t": [("x", "*s"), I]}, {"s": [("x", "*t"), I], "t": [("x", "*s"), U]}, False),
    "unnamed recursion": ({"t#": [("x", "*s")], "s": [("x", "=t#"), I]}, {"t#0": [("x", "*s")], "s": [("x", "=t#0"), I]}, True),
    "unnamed recursion, leaf differs": ({"t#": [("x", "*s"), I], "s": [("x", "=t#"), I]}, {"t#0": [("x", "*s"), U], "s": [("x", "=t#0"), I]}, False),
    "opaque": ({"s": None, "t": [("x", "*s"), I]}, {"s": [I], "t": [("x", "*s"), I]}, True),
    "opaque, outer differs": ({"s": None, "t": [("x", "*s"), I]}, {"s": [I], "t": [("x", "*s"), U]}, False),
    "opaque recursion": ({"s": None, "t": [("x", "*s"), I]}, {"s": [("x", "*t"), I], "t": [("x", "*s"), I]}, True),
    "opaque recursion, leaf differs": ({"s": None, "t": [("x", "*s"), I]}, {"s": [("x", "*t"), I], "t": [("x", "*s"), U]}, False),
}


def classes(spark, a, b):
    (n1, f1), (n2, f2) = source("a", a), source("b", b)
    opaque = {f"{t}.{n}" for t, recs in (("a", a), ("b", b)) for n, body in recs.items() if body is None}
    nodes = table(spark, n1 + n2, NODE)
    hidden = nodes.filter(nodes["id"].isin(*opaque)) if opaque else nodes.limit(0)
    fields = dedup.resolve_opaque(table(spark, f1 + f2, FIELD), nodes, hidden.select("id", "name"))
    return dict(rows(dedup.structural_classes(nodes.join(hidden, "id", "left_anti"), fields), "id", "rep"))


@pytest.mark.parametrize("case", sorted(CASES))
def test_case(spark, case):
    a, b, same = CASES[case]
    rep = classes(spark, a, b)
    for name in a:
        if "#" in name or f"a.{name}" not in rep or f"b.{name}" not in rep:
            continue
        assert (rep[f"a.{name}"] == rep[f"b.{name}"]) is same, name


def test_field_names_and_order_count(spark):
    for other in ([("x", "i32"), ("z", "i32")], [("y", "i32"), ("x", "i32")], [("x", "i32")]):
        rep = classes(spark, {"s": [("x", "i32"), ("y", "i32")]}, {"s": other})
        assert rep["a.s"] != rep["b.s"]


def test_canonicalise(spark):
    refs = table(spark, [(1, 2), (3, 2), (3, 4), (9, 3)], "a bigint, b bigint")
    cls = table(spark, [(1, 1), (2, 2), (3, 1), (4, 2)], "id bigint, rep bigint")
    assert rows(dedup.canonicalise(refs, cls, ["a", "b"])) == [(1, 2), (9, 1)]
    assert rows(dedup.canonicalise(refs, cls, ["b"], key="a")) == [(1, 2)]
