import base64
import hashlib
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factlake.llm import warc
from factlake.plans.scratch import scratch_root

FIELDS = "page_id bigint, url string, html string, id string, sha string, value string, offset string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], FIELDS)


def brute(rows, least=0):
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data, last = (html or "").encode(), best.get(html or "")
        again = last is not None and last != i and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://www.a.example/x", "<p>same</p>"), (2, "https://a.example/x#top", "<p>same</p>"), (3, None, None), (4, "", ""),
    (5, "http://b.example:8080/?q=\r\nX: 1", "WARC/1.0\r\n\r\n\r\nWARC-Type: response\r\n"), (6, "no url", "é 漢\U0001f600\n\r\n\r\n"),
    (7, "http://[bad", "<p>same</p>"), (7, "http://[bad", "<p>same</p>"), (None, "http://c.example", "<p>same</p>"), (None, None, "only here"),
    (-5, "http://a.example/x", "x" * 3_000_000), (9, "http://a.example/x", "line\n" * 300_000), (10, "http://a.example/", "\x00\x01"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = warc.capture_history(pages(spark, ROWS), revisit_bytes=least)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(found, key=str) == brute(ROWS, least)


def test_global_order(spark):
    rows = [(i * 37 % 1009, f"http://h{i % 5}.example/p", f"page {i % 400}") for i in range(1000)]
    table = pages(spark, rows).repartition(7)
    got = [(r.place, (r.url_key, r.captured, r.page_id)) for r in warc.merge_index(read_back(spark, table), 150).collect()]
    assert len({p for p, _ in got}) == 1000 and len({p >> 33 for p, _ in got}) > 1
    keys = [k for _, k in sorted(got)]
    assert keys == sorted(keys)


def read_back(spark, table):
    folder = f"{scratch_root(spark)}/warc-test-{uuid.uuid4().hex}"
    return warc.read_archives(spark, folder, warc.write_archives(table, folder))


def test_offsets_point_at_records(spark, tmp_path):
    folder = str(tmp_path / "w")
    mark = warc.write_archives(pages(spark, ROWS).coalesce(1), folder)
    for r in warc.read_archives(spark, folder, mark).collect():
        data = (tmp_path / "w" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert data.startswith(mark) and warc.parse(data.removeprefix(mark))["page_id"] == r.page_id


def test_empty_table(spark):
    assert warc.capture_history(pages(spark, [])).count() == 0


def test_damaged_record():
    good = warc.record(1, "http://x", None, b"abc", None, 0)
    assert warc.parse(good)["payload_bytes"] == 3
    for bad in (good[:-1], good[:-1] + b"d"):
        with pytest.raises(ValueError):
            warc.parse(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), min_size=1, max_size=9))
def test_loser_tree(runs):
    tagged = [sorted([((x,), (n, i)) for i, x in enumerate(run)]) for n, run in enumerate(runs)]
    got = list(warc.LoserTree(tagged))
    assert [k for k, _ in got] == sorted((x,) for run in runs for x in run)
    # equal keys by run, and in a run in its order
    assert got == sorted((e for t in tagged for e in t), key=lambda e: (e[0], e[1][0]))


def test_url_keys():
    assert warc.url_key("HTTPS://www.Blog.Example.com/A/?b=1#c") == "com,example,blog)/a?b=1"
    assert warc.url_key("http://h.example:8080") == "example,h:8080)/"
    assert warc.url_key(None) == ")/"


def test_query_is_in_merged_order(spark):
    """The whole table: places are distinct and put all captures in order; offsets lead to the record in its file."""
    got = warc.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count() == len({r.place for r in got})
    keys = [(r.url_key, r.captured, r.page_id) for r in sorted(got, key=lambda r: r.place)]
    assert keys == sorted(keys)
    by_file = {}
    for r in got:
        by_file.setdefault(r.file, []).append((r.offset, r.length))
    for spans in by_file.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
