"""Small tables and brute-force answers for the tests."""

from __future__ import annotations

from collections import defaultdict


def table(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def edges(spark, pairs, kind="bigint"):
    return table(spark, pairs, f"src {kind}, dst {kind}")


def nodes(spark, ids, kind="bigint"):
    return table(spark, [(i,) for i in ids], f"id {kind}")


def rows(df, *cols):
    """All rows as sorted tuples, nulls last."""
    found = [tuple(r[c] for c in cols or df.columns) for r in df.collect()]
    return sorted(found, key=lambda row: [(v is None, 0 if v is None else v) for v in row])


def adjacency(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    return out


def reach(pairs, seeds):
    out, seen, todo = adjacency(pairs), set(seeds), list(seeds)
    while todo:
        for b in out[todo.pop()]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def closure(pairs, ids):
    out = adjacency(pairs)
    return {(a, b) for a in ids for b in reach(pairs, out[a])}


def components(pairs, ids):
    both = list(pairs) + [(b, a) for a, b in pairs]
    return {i: min(reach(both, [i])) for i in ids}


def strong(pairs, ids):
    full = closure(pairs, ids) | {(i, i) for i in ids}
    return {i: min(j for j in ids if (i, j) in full and (j, i) in full) for i in ids}
