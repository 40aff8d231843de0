import re
from collections import defaultdict

import pytest

from factlake.llm import source_mix
from tests.llm.data import EDGES, documents, prose


def water(sizes, weights=(3, 1, 2), ratio=1.5, cap=2.0):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), ratio * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def run(spark, rows, **options):
    docs = documents(spark, rows)
    mixed, names = source_mix.mix(docs, **options)
    assert mixed.columns == [*docs.columns, *names]
    return mixed.select("doc_id", "source", *names).collect()


ROWS = [(i, prose(i, 5 + i * 7 % 200), "en", s) for i in range(240) for s in [["a", "b", "ü", None, "B", "tiny"][0 if i < 120 else i % 6]]]


@pytest.mark.parametrize("rows", [ROWS, [(i, t, "en", "xy"[i % 2] if i else None) for i, t in EDGES if i is not None] + [(5, "Two  WORDS\n", "en", "y")] * 4])
def test_mix(spark, rows):
    got = run(spark, rows)
    assert sorted(str((r.doc_id, r[2])) for r in got) == sorted(str((i, words(t))) for i, t, *_ in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r[2]
        taken[r.source] += r[5]
        assert 0 <= r[5] <= 2 * r[2]
    target = water(sizes)
    for r in got:
        assert r[3] == sizes[r.source] and r[4] == pytest.approx(target[r.source])
    for s in sizes:
        assert taken[s] == round(target[s])
        # complete epochs first: no document is an epoch ahead of another by more than one
        counts = [r[5] / r[2] for r in got if r.source == s and r[2]]
        assert not counts or max(counts) - min(counts) <= 1


def test_whole_documents_and_reruns(spark):
    first, again = (sorted(map(str, run(spark, ROWS, cut=False))) for _ in range(2))
    assert first == again
    docs = documents(spark, ROWS)
    out = source_mix.mixed(docs)
    assert out.columns == docs.columns
    copies, per_source = defaultdict(int), defaultdict(int)
    for r in out.collect():
        copies[r.doc_id] += 1
        per_source[r.source] += words(r.text)
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += words(t)
    assert max(copies.values()) <= 2
    for s, t in water(sizes).items():
        assert abs(per_source[s] - t) <= max(words(x) for _, x, _, y in ROWS if y == s) / 2 + 1


def test_better_quality_is_taken_more(spark):
    rows = [(i, "word " * 10 if i % 2 else "abcdefghijklmnopqr " * 10, "en", "abc"[i % 3]) for i in range(3000)]
    got = run(spark, rows)
    share = [sum(r[5] % r[2] == 0 and r[5] > r[4] / r[3] * r[2] for r in got if r.doc_id % 2 == odd) for odd in (0, 1)]
    assert share[1] > 1.5 * share[0]


def test_edges(spark):
    assert run(spark, []) == []
    got = run(spark, EDGES)
    assert len(got) == len(EDGES)
    assert [r[5] for r in run(spark, [(1, None), (2, "")])] == [0, 0]
