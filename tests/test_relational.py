import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import aggs, checks, inventory, joins, sets, windows
from tests.helpers import rows, table


def test_io_dimension(spark):
    dim = inventory.io_dimension(spark)
    assert dim.count() == dim.select("name").distinct().count() == 102
    got = {r["name"]: (r["kind"], r["detail"], r["is_byte"]) for r in dim.collect()}
    assert got["popen"] == ("open", "pipe", True)
    assert got["fileno"] == ("operation", "as_raw_fd", True)
    assert got["feof"] == ("operation", None, True)
    assert got["vfwscanf"] == ("unsupported", None, False)


def test_names_are_normalised_once(spark):
    names = ["__printf__", "putc_unlocked", "rpl_fopen", "rpl_getc_unlocked", "rpl_rpl_fopen", "x"]
    df = table(spark, [(n,) for n in names], "s string").select(inventory.normalise_name(F.col("s")).alias("n"))
    assert sorted(r["n"] for r in df.collect()) == sorted(["printf", "putc", "fopen", "getc", "rpl_fopen", "x"])


def test_arity_groups(spark):
    parents = table(spark, [("f",), ("g",), ("h",)], "fn string")
    children = table(spark, [("g", "a"), ("h", "b")], "owner string, param string")
    got = inventory.group_by_child_count(parents, children, "fn", "owner")
    assert rows(got) == [(0, "f"), (1, "g"), (1, "h")]
    assert rows(inventory.child_count_groups(got)) == [(0, 1), (1, 2)]


def test_call_counts(spark):
    calls = table(spark, [("f",), ("g",), ("g",), ("printf",)], "fn string")
    own = table(spark, [("f",), ("g",), ("main",)], "name string")
    assert rows(inventory.call_counts(calls, "fn", own, "name")) == [("f", 1), ("g", 2)]


def test_flag_listing(spark, hot):
    data = [("call", "own", 1), ("call", "puts", 2), ("call", None, 3), ("deref", "own", 4)]
    data += [("call", "own", i) for i in range(10, 30)] + [("call", "puts", 2)]
    found = inventory.flag_listing(
        table(spark, data, "kind string, target string, at int"), table(spark, [("own",)], "target string"), position="at"
    )
    assert rows(found) == [("call", 3), ("deref", 4), ("puts", 2), ("puts", 2)]


def test_binary_names(spark):
    df = table(spark, [("a::main",), ("b::r#mod::main",), ("test::main",)], "path string")
    assert rows(inventory.binary_names(df, "path", ["test"], "app"), "name") == [("a_main",), ("b_mod_main",)]
    assert rows(inventory.binary_names(df, "path", ["test", "a"], "app"), "name") == [("app",)]
    assert inventory.exclude_prefixes(df, "path", []).count() == 3


def test_path_key(spark):
    cases = [("build/src/lib/a.c", "src::lib::a"), ("lib/x.tar.c/", "src::lib::x.tar"), ("other/b.c", "src"), ("a/.lib", "src"), ("lib/.rc", "src::lib::.rc")]
    df = table(spark, [(c,) for c, _ in cases], "p string")
    got = {r["p"]: r["module"] for r in inventory.path_key(df, "p", ["lib"]).collect()}
    assert got == dict(cases)


def test_classes_follow_precedence(spark):
    df = table(spark, [("a",), ("b",), ("c",), (None,)], "t string")
    dims = [("local", table(spark, [("a",)], "n string")), ("library", table(spark, [("a",), ("b",)], "n string"))]
    got = rows(inventory.classify_targets(df, "t", dims))
    assert got == [("a", "local"), ("b", "library"), ("c", "dynamic"), (None, "indirect")]


def test_empty_funnel(spark):
    df = table(spark, [(1,), (2,)], "x int")
    got = inventory.funnel_counts(df, [("t", F.col("x") > 5), ("a", F.col("x") > 0)])
    assert rows(got) == [(2, 0, 0)]


def test_resolve_refs(spark):
    refs = table(spark, [(1, "bar", "i"), (2, "baz", "i"), (3, "qux", "i"), (4, "bar", "f"), (5, "hid", "i")], "ref int, name string, sig string")
    defs = table(spark, [("b.bar", "bar", "i"), ("c.baz", "baz", "i"), ("d.baz", "baz", "i"), ("h1", "hid", "i"), ("h2", "hid", "i")], "def string, name string, sig string")
    hints = table(spark, [("hid", "h2")], "name string, target string")
    kw = dict(ref_id="ref", def_id="def", hint_key="name")
    strict = joins.resolve_refs(refs, defs, hints, match_cols=["name", "sig"], **kw)
    assert rows(strict, "ref", "target", "status") == [
        (1, "b.bar", "unique"), (2, None, "ambiguous"), (3, None, "missing"), (4, None, "missing"), (5, "h2", "hint")
    ]
    loose = joins.resolve_refs(refs, defs, hints, match_cols=["name"], **kw)
    assert (4, "b.bar", "unique") in rows(loose, "ref", "target", "status")


def test_range_lookup(spark):
    ranges = table(spark, [(0, 4), (10, 10), (11, 35)], "root bigint, end bigint")
    points = table(spark, [(i,) for i in range(-2, 40)], "p bigint")
    got = {r["p"]: (r["root"], r["offset"]) for r in joins.range_lookup(points, ranges, point="p").collect()}
    want = {p: next(((a, p - a) for a, b in [(0, 4), (10, 10), (11, 35)] if a <= p <= b), (None, None)) for p in range(-2, 40)}
    assert got == want
    with pytest.raises(checks.CheckFailed):
        joins.range_lookup(points, table(spark, [(0, 5), (5, 9)], "root bigint, end bigint"), point="p")


def test_range_lookup_of_long_ranges_and_nulls(spark, hot):
    ranges = table(spark, [(0, 10**15), (None, 5), (10**15 + 1, None), (10**16, 10**16 + 2)], "root bigint, end bigint")
    points = spark.range(0, 10**16, 10**13).selectExpr("id AS p", "'x' AS root_", "id % 7 AS _at").unionByName(
        table(spark, [(None, "n", 1), (10**16 + 2, "l", 1), (10**16 + 3, "b", 1)], "p bigint, root_ string, _at bigint")
    )
    got = joins.range_lookup(points, ranges, point="p").collect()
    assert len(got) == 1003
    for r in got:
        want = None if r.p is None else 0 if r.p <= 10**15 else 10**16 if 10**16 <= r.p <= 10**16 + 2 else None
        assert (r.root, r.offset) == (want, None if want is None else r.p - want)


@pytest.mark.parametrize("sized", [False, True])
def test_overlaps_match_brute_force(spark, hot, sized):
    rnd = random.Random(3)
    size = {(g, o): rnd.choice([None, 1, 2]) for g in range(3) for o in range(6)}
    facts = {(g, o, rnd.randrange(12)) for g in range(3) for o in range(6) for _ in range(3)}
    want = {
        (g, o)
        for g, o, e in facts
        for h, q, f in facts
        if g == h and o != q and e == f and e != 5
        and (not sized or None in (size[g, o], size[h, q]) or size[g, o] == size[h, q])
    }
    df = table(spark, [(*f, size[f[0], f[1]]) for f in facts], "g int, o int, e int, size int")
    got = joins.overlapping_members(
        df, group="g", owner="o", element="e", exclude=table(spark, [(5,)], "e int"), size="size" if sized else None
    )
    assert rows(got) == sorted(want)


def test_asof_is_strict(spark, hot):
    log = [(1, 1, "s"), (1, 2, "c"), (1, 3, "c"), (2, 1, "c"), (1, 4, "b"), (1, 5, "b")] + [(3, i, "s" if i % 4 == 0 else "c") for i in range(20)]
    df = table(spark, log, "k int, t int, kind string")
    got = joins.asof_attribute(
        df, by=["k"], order=["t"], is_source=F.col("kind").isin("s", "b"), is_check=F.col("kind").isin("c", "b"), id="t"
    )
    want = [(1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 4)] + [(3, i, i - i % 4) for i in range(20) if i % 4]
    assert rows(got, "k", "t", "source_id") == want


def test_lookup_policies(spark):
    df, dim = table(spark, [("a",), ("z",)], "f string"), table(spark, [("a", 1)], "f string, v int")
    look = lambda **kw: rows(joins.lookup_with_default(df, dim, key="f", value="v", **kw))
    assert look() == [("a", 1), ("z", None)]
    assert look(policy="noop") == [("a", 1)]
    assert look(policy="conservative", default=9) == [("a", 1), ("z", 9)]
    with pytest.raises(ValueError):
        look(policy="guess")
    with pytest.raises(ValueError):
        look(policy="conservative")


def test_group_flags(spark, hot):
    data = [(1, "a", True), (1, "a", False), (1, "b", True), (1, None, True), (2, None, True), (2, None, False)]
    data += [(3, "h", i != 7) for i in range(20)]
    df = table(spark, data, "o int, g string, f boolean")
    every = {(o, g): v for o, g, _, v in rows(aggs.all_of_group(df, ["o"], "g", "f"))}
    assert every[1, "a"] is False and every[1, "b"] is True and every[1, None] is False and every[3, "h"] is False
    assert [v for o, _, _, v in rows(aggs.all_of_group(df, ["o"], "g", "f")) if o == 2] == [False, True]
    some = rows(aggs.any_of_group(df, ["o"], "g", "f"))
    assert all(v or not f for _, _, f, v in some)
    assert {v for o, g, _, v in some if (o, g) == (1, "a")} == {True}
    off = table(spark, [(1, "a", False), (2, "b", True)], "o int, g string, f boolean")
    assert rows(aggs.any_of_group(off, ["o"], "g", "f", drop_empty=True), "o") == [(2,)]


def test_lattice(spark):
    data = [(1, None), (2, "x"), (2, "x"), (2, None), (3, "x"), (3, "y")]
    df = table(spark, data, "k int, v string")
    assert rows(aggs.lattice_meet(df, ["k"], "v")) == [(1, "top", None), (2, "elem", "x"), (3, "bottom", None)]
    assert rows(aggs.lattice_join(df, ["k"], "v")) == [(1, "bottom", None), (2, "elem", "x"), (3, "top", None)]


def test_masks(spark):
    df = table(spark, [(0,), (62,), (63,), (-1,)], "i int").select("i", aggs.bit(F.col("i")).alias("m"))
    assert dict(rows(df)) == {0: 1, 62: 1 << 62, 63: None, -1: None}
    full = spark.range(1).select(aggs.full_mask(63).alias("f"), aggs.full_mask(0).alias("z")).first()
    assert (full["f"], full["z"]) == ((1 << 63) - 1, 0)
    with pytest.raises(ValueError):
        aggs.full_mask(-1)


def test_wide_masks(spark):
    sets = {1: [{0, 63, 64, 199}, {63, 64}], 2: [{5}, set()], 3: [set(range(200))], 4: []}
    data = [(k, j, i) for k, some in sets.items() for j, members in enumerate(some) for i in [*members, 200, -1]] + [(4, 0, None)]
    single = table(spark, data, "k int, j int, i int").select("k", "j", aggs.wide_bit(F.col("i"), 200).alias("m"))
    m = F.coalesce("m", aggs.zero_mask(200))
    per = single.groupBy("k", "j").agg(aggs.wide_union(m, 200).alias("m"), aggs.wide_union(F.col("m"), 200).alias("raw"))
    both = per.groupBy("k").agg(aggs.wide_union(F.col("m"), 200).alias("u"), aggs.wide_intersect(F.col("m"), 200).alias("x"), F.max("raw").alias("raw"))
    got = {
        r.k: r
        for r in both.select(
            "k", "raw", aggs.wide_members(F.col("u")).alias("u"), aggs.wide_members(F.col("x")).alias("x"),
            aggs.wide_count(F.col("u")).alias("n"), aggs.wide_members(aggs.wide_subtract(F.col("u"), F.col("x"))).alias("d"),
            aggs.wide_superset(F.col("u"), aggs.full_mask(200)).alias("all"), aggs.wide_superset(F.col("u"), F.col("x")).alias("sup"),
        ).collect()
    }
    for k, some in sets.items():
        u, x = set().union(*some), set.intersection(*some) if some else set()
        assert (got[k].u, got[k].x, got[k].n, got[k].d) == (sorted(u), sorted(x), len(u), sorted(u - x))
        assert got[k]["all"] == (k == 3) and got[k].sup
    assert got[4].raw is None
    assert spark.range(1).select(aggs.wide_members(aggs.full_mask(64)).alias("m")).first().m == list(range(64))


def test_stages_saturate(spark):
    df = table(spark, [(1, "a", 5), (1, "b", 9), (1, "b", 20), (2, "a", 7)], "k int, l string, m bigint")
    got = aggs.duration_stages(df, ["k"], label="l", mark="m", stages=[("ab", "a", "b"), ("ba", "b", "a")])
    assert rows(got) == [(1, 4, 0), (2, 0, 7)]


def test_union_reports_change(spark):
    a, b = table(spark, [(1,), (2,)], "x int"), table(spark, [(2,), (2,)], "x int")
    assert not sets.union_changes(a, b)
    assert sets.union_changes(b, a)
    assert rows(sets.set_union(a, b)) == [(1,), (2,)]


def test_layout_across_owners(spark):
    df = table(spark, [("b", 0, 2), ("a", 1, 0), ("a", 0, 3), ("b", 1, 1)], "o string, p int, w int")
    got = windows.layout_ranges(df, "o", "p", F.col("w"), initial=2)
    assert rows(got, "o", "p", "start", "end") == [("a", 0, 2, 5), ("a", 1, 5, 5), ("b", 0, 5, 7), ("b", 1, 7, 8)]
    assert rows(windows.range_of(got.select("o", "p", "start"), "o", "p", "start"), "o", "start", "end") == [("a", 2, 5), ("b", 5, 7)]


def test_nested_offsets(spark):
    fields = [
        ("outer", 0, None, "field"), ("outer", 1, "inner", "field"), ("outer", 2, "arr", "union"), ("outer", 3, "void", "field"),
        ("inner", 0, None, "field"), ("inner", 1, None, "field"), ("arr", 0, "inner", "array"), ("void", None, None, "field"),
    ]
    lengths, offsets = windows.flatten_offsets(table(spark, fields, "owner string, pos bigint, child string, kind string"))
    assert rows(lengths) == [("arr", 2), ("inner", 2), ("outer", 6), ("void", 1)]
    assert [r[1:] for r in rows(offsets, "owner", "pos", "offset", "length") if r[0] == "outer"] == [(0, 0, 1), (1, 1, 2), (2, 3, 2), (3, 5, 1)]
    leaves = windows.flatten_leaves(offsets, table(spark, [("outer",)], "owner string"))
    assert sorted(r["offset"] for r in leaves.collect()) == [0, 1, 2, 3, 4, 5]
    loop = table(spark, [("s", 0, "s", "field")], "owner string, pos bigint, child string, kind string")
    with pytest.raises(ValueError):
        windows.flatten_offsets(loop)


def _first_wins(defs, copies, blocked):
    group = {(s, v): (v, -1) for s, v in defs}
    for s, t, dst, src in sorted(copies):
        if dst != 0 and (s, src) in group and (s, dst) not in group and (s, dst) not in blocked:
            group[s, dst] = (group[s, src][0], t)
    return sorted((s, v, g, t) for (s, v), (g, t) in group.items())


def test_leaves_without_child_do_not_meet_in_one_task(spark, hot):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        inner = [("outer", i, f"r{i}", i * 10) for i in range(40)] + [(f"r{i}", j, None, j) for i in range(40) for j in range(10)]
        offsets = table(spark, inner, "owner string, pos bigint, child string, offset bigint")
        leaves = windows.flatten_leaves(offsets, table(spark, [("outer",)], "owner string"))
        assert rows(leaves.select("offset")) == [(i,) for i in range(400)]
        assert leaves.select(F.input_file_name().alias("f")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_wins_matches_replay(spark):
    rnd = random.Random(5)
    defs = {(s, v) for s in range(6) for v in rnd.sample(range(1, 12), 3)}
    copies = [(s, t, rnd.randrange(12), rnd.randrange(12)) for s in range(6) for t in range(25)]
    blocked = {(s, rnd.randrange(1, 12)) for s in range(6)} - defs
    got = windows.first_wins_propagation(
        table(spark, defs, "scope bigint, var bigint"),
        table(spark, copies, "scope bigint, t bigint, dst bigint, src bigint"),
        table(spark, blocked, "scope bigint, var bigint"),
    )
    assert rows(got, "scope", "var", "grp", "t") == _first_wins(defs, copies, blocked)


def test_dead_writes(spark, hot):
    log = [("f", "x", i, k) for i, k in enumerate("wwrw")] + [("main", "x", 0, "w")] + [("g", "y", i, "wr"[i % 3 == 2]) for i in range(12)]
    df = table(spark, log, "o string, k string, t int, kind string")
    got = windows.dead_writes(
        df, ["o", "k"], ["t"], is_write=F.col("kind") == "w", excluded=table(spark, [("main",)], "o string"), owner="o"
    )
    assert rows(got, "o", "t") == [("f", 0), ("f", 3), ("g", 0), ("g", 3), ("g", 6), ("g", 9)]


def test_checks(spark):
    df = table(spark, [(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    checks.assert_single(df.filter("k = 1"), ["k"])
    checks.assert_single(df.filter("k = 1"))
    for bad in (df, df.limit(0)):
        with pytest.raises(checks.CheckFailed):
            checks.assert_single(bad)
    with pytest.raises(checks.CheckFailed):
        checks.assert_single(df, ["k"])
    a = table(spark, [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "k int, p int, n string")
    b = table(spark, [(1, 0, "x"), (1, 1, "y"), (2, 0, "z"), (2, 1, "z")], "k int, p int, n string")
    checks.assert_same_names(a, a, ["k"], "p", "n")
    assert rows(checks.different_names(a, b, ["k"], "p", "n")) == [(2,)]


def test_distinct_tokens_of_very_long_paths(spark):
    long = "::".join(["part"] * 100_000)
    df = spark.createDataFrame([(f"{long} a::b x",), ("a :: b,c::",)], "text string")
    got = inventory.distinct_tokens(df, "text", inventory.path_pattern("[A-Za-z]+", blanks=True))
    assert {r.token for r in got.collect()} == {long, "a::b", "x", "c"}
