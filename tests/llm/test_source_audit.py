import re
from collections import Counter, defaultdict

import pytest

from factlake.llm import source_audit
from tests.llm.data import EDGES, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        whole = sum((Counter({t: n for t, n in counts[lang, s].items() if t in kept}) for s in sources), Counter())

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        excess = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(excess(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-excess(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(tuple(r) for r in source_audit.divergence(documents(spark, rows), **options).collect())


def table():
    rows = [(i, prose(i, 120, size=200), ("en", "fr")[i % 2], f"s{i % 5}") for i in range(30)]
    rows += [(100 + i, "Foo foo, (foo) bar-foo2bar É é É", "en", "s1" if i else None) for i in range(2)]
    rows += [(110, "only twice", "de", "x"), (111, "only twice twice", "de", "y"), (112, None, "de", "z"), (113, "ein", None, None)]
    rows += [(120 + i, f"w{chr(97 + j)} common", "nl", f"s{i}") for i in range(3) for j in range(4)]
    return rows + [(i, t, "en", "s9") for i, t in EDGES]


def test_by_brute_force(spark):
    rows = table()
    want = brute(rows)
    assert {w[2] for w in want} == {"pair", "term"} and any(w[0] == "de" and w[4] == 0 for w in want)
    assert run(spark, rows) == want


def test_blocks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "_PAIRS", 5)
    assert run(spark, table(), top=3) == brute(table(), top=3)


@pytest.mark.parametrize("min_docs", [1, 2])
def test_fewer_documents(spark, min_docs):
    assert run(spark, table(), min_docs=min_docs) == brute(table(), min_docs)


def test_documents_of_a_term_over_several_chunks(spark):
    # three documents, but each chunk of the term stands in one or two
    rows = [(1, "term, term.", "en", "a"), (2, "(term) term.", "en", "b"), (3, "-term-", "en", "a"), (4, "two", "en", "a"), (4, "two;", "en", "b")]
    got = run(spark, rows)
    assert got == brute(rows) and {g[3] for g in got if g[2] == "term"} <= {"term"}


def test_a_term_twice_in_a_chunk(spark):
    # counted twice, but its document once
    rows = [(1, "foo-foo bar", "en", "a"), (2, "foo-FOO", "en", "b"), (3, "bar, bar", "en", "a"), (4, "bar", "en", "b")]
    got = run(spark, rows)
    assert got == brute(rows) and {g[3] for g in got if g[2] == "term"} <= {"bar"}


def test_chunks_are_cut_where_they_are_added_up(spark):
    docs = documents(spark, [(1, "foo-foo bar", "en", "a")]).selectExpr("doc_id AS row", "lang", "source", "cast(text AS binary) AS text")
    found = source_audit.chunk_terms(source_audit.chunk_counts(docs))
    # no further shuffle, no join
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.term, r.n) for r in found.collect()) == [("bar", 1), ("foo", 1), ("foo", 1)]


def test_empty_table_and_limits(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None)]) == []
    with pytest.raises(ValueError, match="min_docs"):
        run(spark, [], min_docs=4)
