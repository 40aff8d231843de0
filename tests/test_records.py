"""Records of files, read by split, are those of the whole text."""

import random

import pytest

from factlake.sources import corpus


def by_text(text, delim):
    parts = text.split(delim)
    return [p + delim for p in parts[:-1]] + [p for p in parts[-1:] if p]


@pytest.mark.parametrize("delim", ["\n", ";", "é", "€"])
def test_positions_and_delimiters(spark, tmp_path, delim):
    rnd = random.Random(4)
    texts = {
        "empty.txt": "", "one.txt": "abc", "closed.txt": f"abc{delim}", "only.txt": delim, "blank.txt": f"{delim}{delim}x{delim}",
        "big.txt": delim.join("".join(rnd.choice("ab c\r\nü") for _ in range(rnd.randrange(60))) for _ in range(3000)),
        "sub/closed.txt": delim.join(str(i) for i in range(500)) + delim,
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "other.log").write_text("not read")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {}
        for r in corpus.read_records(spark, str(tmp_path), delim, "*.txt").collect():
            got.setdefault(r.path.split(f"{tmp_path.name}/")[-1], []).append((r.pos, r.record))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {n: list(enumerate(by_text(t, delim))) for n, t in texts.items() if t}
    assert {n: sorted(v) for n, v in got.items()} == want


def test_byte_order_mark(spark, tmp_path):
    for name, text in (("a.txt", "x\ny"), ("b.txt", "x\ny\n")):
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf" + text.encode())
    got = corpus.read_records(spark, str(tmp_path))
    assert sorted((r.path[-5:], r.pos, r.record) for r in got.collect()) == [
        ("a.txt", 0, "x\n"), ("a.txt", 1, "y"), ("b.txt", 0, "x\n"), ("b.txt", 1, "y\n"),
    ]


def test_one_character(spark, tmp_path):
    with pytest.raises(ValueError):
        corpus.read_records(spark, str(tmp_path), "ab")
