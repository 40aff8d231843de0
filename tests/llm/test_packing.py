import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factlake.llm import packing
from tests.llm.data import EDGES, documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
CACHED = packing.CachedTokenizer(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def check(rows, pieces):
    """Every id of every row in one piece, sequences gapless and full."""
    want = defaultdict(int)
    for doc_id, text in rows:
        want[doc_id, tuple([*ids(text), 0])] += 1
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    for doc_id, own in docs.items():
        texts = [(list(t), n) for (i, t), n in want.items() if i == doc_id]
        for text, n in texts:
            data = np.array(text, "<u4")
            found = defaultdict(int)
            for r in own:
                if r.doc_tokens == len(text) and r.ids_crc32 == zlib.crc32(data[r.start : r.start + r.length].tobytes()):
                    found[r.start] += 1
                    for i in range(r.start, r.start + r.length):
                        assert i < len(text)
            assert sum(r.length for r in own if r.doc_tokens == len(text)) >= n * len(text)
    assert sum(r.length for r in pieces) == sum(n * len(t) for (_, t), n in want.items())


def test_whole_texts(spark):
    rows = [*((i, t) for i, t in EDGES if t is None or len(t) < 1_000_000), *((100 + i, prose(i, 7 * i)) for i in range(120))]
    check(rows, packing.pack(documents(spark, rows)).collect())
    assert packing.pack(documents(spark, [])).count() == 0


def test_pieces_rebuild_each_document(spark):
    rows = [(i, prose(i, 13 * i)) for i in range(150)]
    got = defaultdict(list)
    for r in packing.pack(documents(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, text in rows:
        data, at = np.array([*ids(text), 0], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(data))
            assert r.ids_crc32 == zlib.crc32(data[at : at + r.length].tobytes())
            at += r.length
        assert at == len(data)


def test_steps_have_one_tier(spark):
    rows = packing.pack(documents(spark, [(i, prose(i, 90)) for i in range(300)])).collect()
    steps = defaultdict(set)
    for r in rows:
        steps[r.step_id].add((r.tier, r.sequence_id))
    for found in steps.values():
        assert len({t for t, _ in found}) == 1 and sum(t for t, _ in found) <= 1 << 14


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab  \n\t'sé.1<|endoftext> \x1c 漢")), max_size=25), max_size=4))
def test_cached_ids_are_the_tokenizers(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in CACHED.encode(texts)] == [ids(t) for t in texts]


def test_special_token_as_text():
    assert np.frombuffer(CACHED.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == ids("a <|endoftext|> b")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60), st.integers(1, 20))
def test_packer_fills_windows(sizes, every):
    packer, out = packing.Packer((1024, 512, 256)), []
    for i, n in enumerate(sizes):
        out += packer.add(i, n)
        if i % every == 0:
            full = list(packer.windows())
            assert all(sum(n for *_, n in w) in (1024, 512, 256) for w in full)
            out += full
    out += [*packer.windows(), *packer.finish()]
    for w in out:
        n = sum(n for *_, n in w)
        assert n <= 1024 and n & (n - 1) == 0
    for i, n in enumerate(sizes):
        spans = sorted((first, k) for w in out for doc, first, k in w if doc == i)
        assert [f for f, _ in spans] == [sum(k for _, k in spans[:j]) for j in range(len(spans))] and sum(k for _, k in spans) == n


def test_special_tokens_have_their_ids():
    texts = ["<|endoftext|>", "a <|endoftext|> b", "plain text", "", "x<|endoftext|>\n\n y  z", "<|endoftex|>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in CACHED.encode(texts)]
    assert got == [ids(t) for t in texts]
    assert got[0] == [TOKENIZER.token_to_id("<|endoftext|>")]
    spelled = packing.CachedTokenizer(PATH, spelled=True).encode(texts)
    assert len(spelled[0]) > 4 and spelled[2] == CACHED.encode(texts)[2]
