import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factlake.llm import collocations
from factlake.llm.collocations import Words, count_open, phrase_rows
from tests.llm.data import EDGES, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=5):
    found = {}
    for _, text, lang in rows:
        own = found.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return found


def brute(rows, least, top=2000, share=100):
    out = []
    for lang, f in counted(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        held = {}
        for p, v in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(v, held.get(p[i : i + k], 0))
        own = []
        for p, a in candidates.items():
            if 100 * held.get(p, -1) >= share * a:
                continue
            score, cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def run(spark, rows, **options):
    return sorted(tuple(r) for r in collocations.collocations(documents(spark, rows), **options).collect())


def table(n=40):
    rows = [(i, prose(i, 150, size=30) + " The New York Times, of the new york times of.", ("en", "fr", None)[i % 3]) for i in range(n)]
    return rows + [(i, t, "en") for i, t in EDGES] + [(900, "a b a b a b a b\ta b! a b", "xx")] * 9 + [(901, "é Ñ ñ;É É\x0bé Ñ", "")] * 4


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 3, "slot_bits": 5}])
def test_by_brute_force(spark, options):
    rows = table()
    want = brute(rows, 6)
    assert len(want) > 100 and any(" " in w[2] and len(w[2].split()) > 3 for w in want)
    assert run(spark, rows, least=6, **options) == want


def test_limits_and_share(spark):
    rows = table()
    assert run(spark, rows, least=6, top=7, share=60) == brute(rows, 6, top=7, share=60)
    assert run(spark, rows, least=10_000) == []


def test_rare_words_begin_late_and_are_counted_whole(spark):
    # each word is found in the last rows only, so longer phrases begin in later cycles
    rows = [(i, prose(i, 20), "en") for i in range(400)] + [(1000 + i, "zeta eta theta iota kappa", "en") for i in range(6)]
    assert ("en", "zeta eta theta iota kappa") in {(r[0], r[2]) for r in run(spark, rows, least=6)}
    assert run(spark, rows, least=6) == brute(rows, 6)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, "en"), (2, "", None), (3, " .. ", "en")], least=1) == []
    with pytest.raises(ValueError, match="steps"):
        run(spark, [], shards=60)


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**15, 10**18, 10**15, 10**16)], "a bigint, n bigint, l bigint, r bigint")
    exact = {c: df[c].cast("decimal(19,0)") for c in "alrn"}
    from pyspark.sql import functions as F

    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"], exact["l"] * exact["r"])
    assert df.select(score.alias("s")).first().s == 1000 * 10**15 * 10**18 // 10**31


def test_equal_hashes_are_told_apart():
    word, words = np.array([0, 1, 0, 1]), pa.array([b"a", b"b"], pa.large_binary())
    at, key, zero = np.arange(4), np.zeros(4, np.uint64), np.zeros(4, np.int64)
    rows = phrase_rows(at, 1, key, word, words, zero, pa.array(["en"]))  # all four have one hash
    assert sorted(zip(rows["phrase"].to_pylist(), rows["f"].to_pylist())) == [("a", 2), ("b", 2)]


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_a_task_adds_up_its_phrases(held):
    def batches():
        for i in range(50):
            yield pa.RecordBatch.from_pydict({"lang": ["en", "en", "fr"], "k": pa.array([1, 1, 1], pa.int32()), "phrase": ["a", "b", "a"], "f": [1, 2, i]})

    found, made = Counter(), 0
    for batch in collocations.added_up(batches(), held):
        made += batch.num_rows
        for row in batch.to_pylist():
            found[row["lang"], row["k"], row["phrase"]] += row["f"]
    assert found == {("en", 1, "a"): 50, ("en", 1, "b"): 100, ("fr", 1, "a"): 1225}
    # one row for each phrase, not one for each slice of text
    assert made == (3 if held == 1000 else 150)


def test_phrases_begin_after_their_parts():
    words = Words(pa.array([b"a b a b. b"]), pa.array(["en"]))

    def lengths(since, step):
        found = Counter()
        for batch in count_open(words, np.full(1 << 4, since, np.uint8), step, 2, 3):
            for about, n in zip(batch["about"].to_pylist(), batch["n"].to_pylist()):
                found[about >> 8, about & 255] += n
        return dict(found)

    assert lengths(255, 0) == {(0, 1): 5} and lengths(255, 2) == {}
    # both parts known since step 1: pairs and triples within pieces, for two steps
    assert lengths(1, 1) == lengths(1, 1) | {(1, 2): 3, (1, 3): 2} and lengths(1, 2) == {(1, 2): 3, (1, 3): 2}
    assert lengths(1, 3) == {}
