import re

from hypothesis import given, settings
from hypothesis import strategies as st

from factlake.llm.license_scan import PHRASES, TEMPLATES, Automaton, Scanner, license_scan
from tests.llm.data import EDGES, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCANNER = Scanner(PHRASES, TEMPLATES, 4, 8, 0.5)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p for _, p in places}))


def test_edges(spark):
    rows = [*EDGES, (20, "CC BY-NC, cc-by; All Rights\nReserved GNU General Public  License"), (21, "all rights all rights reserved cc" + " filler" * 300_000 + " by cc by")]
    got = {(r.doc_id, r.n_words): r for r in license_scan(documents(spark, rows)).collect()}
    assert len(got) == len({(i, brute(t)[0]) for i, t, *_ in rows})
    for i, text in rows:
        r = got[i, brute(text)[0]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_empty_table(spark):
    assert license_scan(documents(spark, [])).count() == 0


def test_repeated_rows_stay(spark):
    assert license_scan(documents(spark, [(1, "cc by")] * 3)).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("cc by CC general public license all rights reserved gnu x - the".split()), max_size=40))
def test_phrases_by_brute_force(words):
    assert SCANNER.scan(" ".join(words).encode())[:5] == brute(" ".join(words))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=20))
def test_matching_statistics(sequences, stream):
    subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    automaton = Automaton(sequences)
    for i, (state, length) in enumerate(automaton.walk(stream)):
        assert length == max((n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in subs), default=0)
        match = stream[i + 1 - length : i + 1]
        ends = {(k, p) for k, s in enumerate(sequences) for p in range(length - 1, len(s)) if s[p + 1 - length : p + 1] == match}
        assert not length or automaton.ends[state] == ends


def test_spans_of_templates():
    mit = dict(TEMPLATES[:1])["mit"]
    changed = mit.replace("free of charge", "gratis").replace("EXPRESS OR IMPLIED", "of any sort")
    for text in (mit, "intro words " + changed + " and more"):
        _, n_base, *_, labels, score, spans = SCANNER.scan(text.encode())
        assert (n_base, labels) == (0, "mit") and score > 0.9 and len(spans.split(",")) == 1
    assert len(SCANNER.scan((mit + " between " + mit).encode())[-1].split(",")) == 2
    assert SCANNER.scan(b"permission is hereby granted to leave")[-3:] == ("", 0.0, "")


def scanner(template, min_match=2, max_gap=2):
    return Scanner({"zz zz": "z"}, [("t", template)], min_match, max_gap, 0.0)


def test_a_repeated_passage_counts_once():
    passage = "a b c d e f g "
    both = scanner(passage + "h i " + passage + "j k", 4, 8)
    assert both.scan(passage.encode())[-2] == 7 / 18
    assert both.scan((passage + "x " + passage).encode())[-2] == 14 / 18


def best_chain(text, template, min_match, max_gap):
    """Every way to put maximal matches at places of the template, one after the other."""
    size, found = len(template), []
    for end in range(len(text)):
        lengths = []
        for e in (end, end + 1):
            options = [n for n in range(1, e + 2) if e < len(text) and any(template[p : p + n] == text[e + 1 - n : e + 1] for p in range(size - n + 1))]
            lengths.append(max(options, default=0))
        if lengths[0] >= min_match and lengths[1] <= lengths[0]:
            n = lengths[0]
            found.append((end + 1 - n, end, [p + n - 1 for p in range(size - n + 1) if template[p : p + n] == text[end + 1 - n : end + 1]]))

    def extend(i, end, place, covered):
        best = covered
        for j in range(i, len(found)):
            begin, last, places = found[j]
            for p in places:
                fresh = last - begin + 1 if end is None else min(p - place, last - end, last - begin + 1)
                if fresh > 0 and (end is None or begin - end - 1 <= max_gap):
                    best = max(best, extend(j + 1, last, p, covered + fresh))
        return best

    return extend(0, None, -1, 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=2, max_size=9), st.lists(st.sampled_from("abcdx"), max_size=10))
def test_chains_by_brute_force(template, text):
    score = scanner(" ".join(template)).scan(" ".join(text).encode())[-2]
    assert abs(score - best_chain(text, template, 2, 2) / len(template)) < 1e-9


def test_spans_of_a_template_lie_apart():
    mit = dict(TEMPLATES[:1])["mit"]
    spans = SCANNER.scan((mit + " between " + mit + mit + " filler" * 50 + mit[:600]).encode())[-1].split(",")
    places = [tuple(map(int, s.split(":")[1:3])) for s in spans if s.startswith("mit:")]
    assert len(places) >= 3 and all(a[1] < b[0] for a, b in zip(places, places[1:]))


def test_parts_of_a_licence():
    for label in ("isc", "bsd", "lgpl", "unlicense"):
        parts = [text for name, text in TEMPLATES if name == label]
        assert len(parts) > 1
        for part in parts:
            *_, labels, score, _ = SCANNER.scan(part.encode())
            assert label in labels.split(",") and score == 1.0
        whole = SCANNER.scan("\n\n".join(parts).encode())
        assert [s.split(":")[0] for s in whole[-1].split(",")].count(label) >= len(parts)
