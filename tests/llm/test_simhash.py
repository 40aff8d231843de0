import re

import numpy as np
import xxhash

from factlake.llm import simhash
from tests.llm.data import EDGES, documents, prose


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    out = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = out[i], out[j]
                out = [min(a, b) if c in (a, b) else c for c in out]
    return out


def test_fingerprints_by_brute_force():
    texts = [None, "", "One", "one two", "A b C", "a  b\tc d\x0b", "Ünï a b c d", prose(1, 700), prose(2, 3000), " x" * 400_000]
    for text in texts[:-1]:
        assert simhash.fingerprint(text.encode() if text is not None else None) == brute_print(text)
    # as much as three blocks: every shingle is the same
    assert simhash.fingerprint((texts[-1] * 4).encode()) == xxhash.xxh64_intdigest(b"x x x", 42)
    long = prose(3, 250_000).encode()
    whole = long.lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(w), 42) for w in zip(whole, whole[1:], whole[2:])], np.uint64)
    assert 2 * simhash._counts(hashes)[5] > len(hashes) or not simhash.fingerprint(long) >> 5 & 1
    assert simhash.fingerprint(long) == int(np.packbits(2 * simhash._counts(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def test_edges_and_repeated_rows(spark):
    got = simhash.near_duplicates(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    zero = {r.id: r.component_id for r in got if r.fp == 0}
    assert zero == {1: 1, 2: 1, 3: 1, None: 1}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            v = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    # every bucket hot, some, none
    for limit in (1, 8, 512):
        assert {(r.src, r.dst) for r in simhash.links(fps, limit).collect()} == want


def test_lookups_are_not_broadcast(spark, tmp_path):
    # a table of a few KB, which Spark would take the lookups made of it for, too
    values = [(i << 40 | i % 7,) for i in range(300)]
    spark.createDataFrame(values, "fp bigint").write.parquet(str(tmp_path / "fps"))
    fps = spark.read.parquet(str(tmp_path / "fps"))
    for hot_bucket, joins in ((512, 1), (20, 2)):
        plan = simhash.links(fps, hot_bucket)._jdf.queryExecution().executedPlan().toString()
        inner = [line for line in plan.split("\n") if "Join" in line and "Inner" in line]
        assert len(inner) == joins and all("SortMergeJoin" in line for line in inner)


def test_components_follow_links(spark):
    base = prose(11, 4000)
    rows = [(i, base.replace(w, w + "x", 1)) for i, w in enumerate(base.split()[100:112])] + [(50, base), (51, base), (60, prose(12, 300))]
    got = {r.id: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    ids = [i for i, _ in rows]
    values = [got[i].fp & (1 << 64) - 1 for i in ids]
    comp = components(values)
    want = {i: min(ids[j] for j in range(len(ids)) if comp[j] == comp[k]) for k, i in enumerate(ids)}
    assert {i: got[i].component_id for i in ids} == want


def test_keep_one(spark):
    base = prose(21, 500)
    docs = documents(spark, [(3, base), (4, base), (5, prose(22, 80)), (5, prose(22, 80)), (None, base), (7, None), (8, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect())) == [(False, 3), (False, 5), (False, 7), (True, 0)]
