import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from factlake.plans.scratch import Scratch  # noqa: E402
from tests.llm import test_line_templates, test_packing, test_simhash  # noqa: E402
from tests.llm.data import documents, prose  # noqa: E402

COMMON = "this passage of many words stands in a number of documents and is the same in all of them by and large"


def corpus():
    rows = [(i, f"{prose(i, 80)}\n{COMMON}\n{prose(500 + i, 80)}", "en", "ab"[i % 2]) for i in range(30)]
    rows += [(100 + i, prose(i // 3 + 40, 150), "en", "c") for i in range(9)]
    return rows + [(200, None, "en", "a"), (201, "", "en", "a"), (202, "12 34", None, None), (203, "solo", None, None)]


def test_stages(spark):
    docs, rows = documents(spark, corpus()), corpus()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        out = stage(spark, docs, "")
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            after = [(r.doc_id, r.text, r.lang, r.source) for r in got]
        if name == "language_id":
            assert sorted(set(before) - set(after), key=str) == sorted([r for r in rows if r[0] in (200, 201, 202)], key=str)
        elif name == "line_dedup":
            want = test_line_templates.expected([(i, t) for i, t, *_ in before])
            assert sorted((str(i), t) for i, t, *_ in after) == [w[:2] for w in want]
            assert all(r.n_chars == len(r.text) for r in got)
        elif name == "simhash_dedup":
            comp = test_simhash.components([test_simhash.brute_print(t) for _, t, *_ in before])
            first = {c: min(before[k][0] for k in range(len(before)) if comp[k] == c) for c in comp}
            assert sorted(i for i, *_ in after) == sorted(first.values())
        elif name == "source_mix":
            assert {r[0] for r in after} <= {r[0] for r in before} and max(after.count(r) for r in after) <= 2
            assert set(after) <= set(before)
        else:
            test_packing.check([(i, t) for i, t, *_ in before], got)
            total = sum(len(test_packing.ids(t)) + 1 for _, t, *_ in before)
            assert np.isclose(sum(r.length for r in got), total)
        docs = Scratch(spark, "test").save(out).df
