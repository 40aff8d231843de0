import random
import zlib

import numpy as np

from factlake.llm import language_id
from tests.llm.data import EDGES, documents

SOUNDS = {"aa": "mela vira sota nuri kela", "bb": "stropf gracht wulm knesk zweft", "cc": "ñotá çuré lémi àvu ôsi"}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts)[: rng.randint(2, 5)] for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    return [(i, text(lang, i), lang) for i in range(150) for lang in [list(SOUNDS)[i % 3]]]



def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    extra = [(1000 + (i or 0), t, None) if i is not None else (None, t, None) for i, t in EDGES]
    docs = documents(spark, rows + extra)
    model = language_id.fit(docs)
    assert model.langs == sorted(SOUNDS)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, _, lang in rows:
        r = by_id[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.lang_pred == lang and 0 <= r.score <= 1
    for i, t in EDGES:
        if i is not None:
            letters = any(c.isalpha() for c in t or "")
            assert (by_id[1000 + i].lang_pred == "und") == (not letters)
            assert letters or by_id[1000 + i].score == 0


def test_learns_from_the_right_rows_only(spark):
    rows = corpus()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    spoiled = [(i, t, "zz") if (i, t, lang) in held else (i, t, lang) for i, t, lang in rows]
    assert language_id.fit(documents(spark, spoiled)).langs == sorted(SOUNDS)


def test_nothing_to_learn(spark):
    for rows in ([], [(1, "abc def", None)], [(1, None, "aa")]):
        docs = documents(spark, rows)
        model = language_id.fit(docs)
        assert model.langs == [] and {r.lang_pred for r in language_id.identify(docs, model).collect()} <= {"und"}


def test_code_lengths_are_a_code():
    """In every context the probabilities of all classes sum to one, and lengths add up to the text's."""
    rng = np.random.default_rng(1)
    grams = np.unique(rng.choice(np.frombuffer(b"abcde ", np.uint8), (400, 4)), axis=0).astype(np.int64)
    code = (grams[:, 0] << 24) | (grams[:, 1] << 16) | (grams[:, 2] << 8) | grams[:, 3]
    which = np.sort(rng.integers(0, 2, len(code)))
    model = language_id.build(["x", "y"], which, code, rng.integers(1, 9, len(code)), 64)
    p = np.exp2(-model.cost.astype(np.float64)).reshape(-1, language_id.CLASSES, 2)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    data = b"abc ed ba"
    total, history = np.zeros(2), [int(model.classes[10])] * 3
    for byte in data:
        c = int(model.classes[byte])
        context = history[-3] << 12 | history[-2] << 6 | history[-1]
        total += model.cost[int(model.node[context]) << 6 | c]
        history.append(c)
    assert np.allclose(model.bits(data), total, atol=1e-3)
    assert np.allclose(model.bits(data, size=2), total, atol=1e-3)


def test_probabilities_by_hand():
    """One language, text 'aab' with contexts: method C at order 0 gives a 2/(3+2), b 1/(3+2), the rest 2/5 evenly."""
    code = np.array([0x0A0A0A61, 0x0A0A6161, 0x0A616162])
    model = language_id.build(["x"], np.zeros(3, np.int64), code, np.ones(3, np.int64), 64)
    a, b, other = (int(model.classes[ord(c)]) for c in "abz")
    unseen = 3 << 12 | 3 << 6 | 3  # a context of a class that does not occur
    p = lambda c: 2.0 ** -float(model.cost[int(model.node[unseen]) << 6 | c, 0])
    assert np.isclose(p(a), 2 / 5, atol=1e-5) and np.isclose(p(b), 1 / 5, atol=1e-5)
    assert np.isclose(p(other), 2 / 5 / 62, atol=1e-6)


def test_keep_known(spark):
    docs = documents(spark, corpus()[:90] + [(900, None, None), (901, "12 !!", None), (902, "", None), (903, text("bb", 5), None), (904, "q", None), (905, "QX7ZJ KQXW VJQZ XKCDQ WQJXZ PQXZV " * 20, None)])
    kept = language_id.keep_known(docs, language_id.fit(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(90), 903, 904]


ALPHABETS = [(0x61, 26), (0x3B1, 24), (0x430, 32), (0x561, 38), (0x5D0, 27), (0x627, 36), (0x905, 50), (0x995, 30), (0xE01, 46), (0x10D0, 33), (0x3041, 80), (0x4E00, 400), (0xAC00, 400)]


def neighbours(alphabet, lang, seed, n):
    """``n`` letters of one of two languages that share an alphabet and how frequent its letters are, not their order."""
    start, size = ALPHABETS[alphabet]
    rng, out = random.Random(f"{alphabet} {lang} {seed}"), []
    letter = rng.randrange(size)
    for _ in range(n):
        letter = (letter * (5 if lang else 7) + rng.randrange(1, 4)) % size
        out.append(chr(start + letter) + (" " if rng.random() < 0.15 else ""))
    return "".join(out)


def test_neighbours_in_several_scripts(spark):
    sides = [(a, b) for a in range(len(ALPHABETS)) for b in range(2)]
    docs = documents(spark, [(k * 100 + i, neighbours(a, b, i, 300), f"{a:02}{b}") for k, (a, b) in enumerate(sides) for i in range(40)])
    model = language_id.fit(docs)
    right = {a: [model.predict(neighbours(a, b, 1000 + i, 40).encode())[0] == f"{a:02}{b}" for b in range(2) for i in range(30)] for a, _ in sides}
    assert min(np.mean(r) for r in right.values()) >= 0.9, {a: np.mean(r) for a, r in right.items()}


def test_many_languages_keep_their_contexts(monkeypatch):
    """The sparse tables give the same code lengths as the one for all languages."""
    raw = np.frombuffer(b"\n\n\n" + "".join(neighbours(a, 0, 1, 400) for a in (0, 2, 6, 11)).encode(), np.uint8).astype(np.int64)
    grams, n = np.unique((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:], return_counts=True)
    build = lambda: language_id.build(["x"], np.zeros(len(grams), np.int64), grams, n, 16_384)
    data = "".join(neighbours(a, 0, 2, 200) for a in (0, 2, 6, 11)).encode()
    want = build()
    monkeypatch.setattr(language_id, "_CELLS", 8)
    got = build()
    assert len(got.cost) < len(want.cost) and np.allclose(got.bits(data), want.bits(data), rtol=1e-4)
    # the codes of all bytes in one context are a code
    each = [got.bits(b"abc" + bytes([b])) - got.bits(b"abc") for b in np.unique(language_id._FOLD)]
    assert np.isclose(np.exp2(-np.array(each)).sum(), 1, atol=1e-3)
