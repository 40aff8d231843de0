import pytest
from pyspark.sql import functions as F

from factlake.functions import formats, strings
from factlake.sources import corpus
from tests.helpers import rows, table


def one(spark, text, expr):
    return table(spark, [(text,)], "s string").select(expr(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a{b}\n\t\r\\\"", 'a{{b}}\\n\\t\\r\\\\\\"'),
        ("a\0b", "ab"),
        ("é😀\x07", "\\u{e9}\\u{1f600}\\u{7}"),
        ("plain ~", "plain ~"),
        ("", ""),
    ],
)
def test_escape(spark, text, want):
    assert one(spark, text, strings.escape_text) == want
    assert one(spark, want, strings.unescape_text) == text.replace("\0", "")


def test_c_strings(spark):
    text = "né,w\0old"
    assert one(spark, text, strings.c_length) == 5
    assert one(spark, text, lambda c: strings.free_length(c, ",;")) == 3
    assert one(spark, text, lambda c: strings.free_length(c, "^]-\\")) == 5
    assert one(spark, text, lambda c: strings.free_length(c, "\0x")) == 5
    assert one(spark, "abcdef", lambda c: strings.fill_bytes(c, "*", 3)) == b"***def"
    assert one(spark, "ab", lambda c: strings.fill_bytes(c, "*", 3)) == b"**"
    assert one(spark, "abcdef", lambda c: strings.copy_bytes(c, F.lit("XY"), 2)) == b"XYcdef"
    with pytest.raises(ValueError):
        strings.free_length(F.col("s"), "é")


def test_records_and_chunks(spark):
    df = table(spark, [(1, "ab\ncdefg\n\nx"), (2, ""), (3, "\n"), (4, "é\n")], "id int, s string")
    got = rows(corpus.split_records(df, "s"))
    assert got == [(1, 0, "ab\n"), (1, 1, "cdefg\n"), (1, 2, "\n"), (1, 3, "x"), (3, 0, "\n"), (4, 0, "é\n")]
    chunks = rows(corpus.chunk_records(df, "s", 4))
    assert [(i, bytes(c)) for i, _, _, c in chunks] == [
        (1, b"ab\n"), (1, b"cde"), (1, b"fg\n"), (1, b"\n"), (1, b"x"), (3, b"\n"), (4, "é\n".encode())
    ]
    assert rows(corpus.split_records(df.filter("id = 1"), "s", "."), "record") == [("ab\ncdefg\n\nx",)]
    with pytest.raises(ValueError):
        corpus.chunk_records(df, "s", 1)


def specs(spark, text, style):
    df = formats.placeholder_specs(table(spark, [(text,)], "s string"), "s", style)
    return df.orderBy("pos").collect()


@pytest.mark.parametrize(
    "text, flags, width, length, conversion, kind",
    [
        ("%d", "", "", "", "d", "i32"),
        ("%ld", "", "", "l", "d", "i64"),
        ("%hhd", "", "", "hh", "d", "i8"),
        ("%10s", "", "10", "", "s", "str"),
        ("%*s", "*", "", "", "s", "str"),
        ("%[abcd]", "", "", "", "[abcd]", "str"),
        ("%[^\n]", "", "", "", "[^\n]", "str"),
        ("%lf", "", "", "l", "g", "f64"),
        ("%f", "", "", "", "g", "f32"),
        ("%[^]", "", "", "", "[^]", "str"),
        ("%tu", "", "", "t", "u", "u64"),
    ],
)
def test_scan_specs(spark, text, flags, width, length, conversion, kind):
    (r,) = specs(spark, text, "scanf")
    assert (r["flags"], r["width"], r["length"], r["conversion"], r["value_type"], r["status"]) == (
        flags, width, length, conversion, kind, "ok"
    )


def test_print_specs(spark):
    got = specs(spark, "%-+5.3ld|%%|%*.*Lf|%F|%lls|%y|%.d %05i%", "printf")
    assert [(r["canonical"], r["value_type"], r["status"]) for r in got] == [
        ("%-+5.3ld", "i64", "ok"),
        ("%%", None, "ok"),
        ("%*.*Lf", "f128", "ok"),
        ("%f", "f64", "ok"),
        ("%lls", None, "untyped"),
        (None, None, "bad"),
        ("%d", "i32", "ok"),
        ("%05d", "i32", "ok"),
        (None, None, "bad"),
    ]
    bad = specs(spark, "%*5d %[] %E", "scanf")
    assert [r["status"] for r in bad] == ["bad"] * 3
    with pytest.raises(ValueError):
        formats.placeholder_specs(spark.range(1), "id", "regex")


def test_extract(spark):
    lines = ["k= 7  v=-1.5e2 [a-b]", "k=99999999999 v=1 [a]", "k=x v=1 [a]", "k=1 v=.5 [-]tail", None]
    df = table(spark, list(enumerate(lines)), "i int, s string")
    good, bad = formats.extract_by_pattern(df, "s", "k=%d v=%lf [%[ab-]]", ["k", "v", "w"])
    assert rows(good, "i", "k", "v", "w") == [(0, 7, -150.0, "a-b"), (3, 1, 0.5, "-")]
    assert rows(bad, "i") == [(1,), (2,), (4,)]
    assert dict(good.dtypes)["k"] == "int"
    good, _ = formats.extract_by_pattern(
        table(spark, [("0x1f,ab,12345",)], "s string"), "s", "%i,%*[a-z],%3d%u", ["a", "b", "c"]
    )
    assert rows(good, "a", "b", "c") == []
    good, _ = formats.extract_by_pattern(
        table(spark, [("0x1f,az,12345",)], "s string"), "s", "%i,%*[a-z],%3d%u", ["a", "b", "c"]
    )
    assert rows(good, "a", "b", "c") == [(31, 123, 45)]
    with pytest.raises(ValueError):
        formats.compile_scan("%y")
    with pytest.raises(ValueError):
        formats.extract_by_pattern(df, "s", "%d", [])


def test_render_like_c(spark):
    values = [0.0, 1.0, 0.125, 2.675, 1e-5, 123456789.0, 100000.0, 0.0001, -3.5, 1e300]
    for spec in ["%g", "%.3g", "%10.2f|", "%-12e|", "%+.0f", "%G", "%#g", "%08.1f"]:
        df = table(spark, [(i, v) for i, v in enumerate(values)], "i int, v double")
        got = formats.render_by_pattern(df, "<" + spec + ">", ["v"]).orderBy("i").collect()
        assert [r["line"] for r in got] == ["<" + spec % v + ">" for v in values], spec
    ints = [0, 1, -1, 255, -(1 << 31), 123456]
    for spec in ["%d", "%5d|", "%-8d|", "%05d", "%+d", "% d", "%.4d", "%8.3d"]:
        df = table(spark, [(i, v) for i, v in enumerate(ints)], "i int, v bigint")
        got = formats.render_by_pattern(df, spec, ["v"]).orderBy("i").collect()
        assert [r["line"] for r in got] == [spec % v for v in ints], spec
    df = table(spark, [(-1, "abc", 65)], "n bigint, s string, c int")
    got = formats.render_by_pattern(df, "%u %x %#X %o %hhd|%5s|%-5s|%.2s|%c%%", ["n", "n", "n", "n", "n", "s", "s", "s", "c"])
    assert got.first()["line"] == "4294967295 ffffffff 0XFFFFFFFF 37777777777 -1|  abc|abc  |ab|A%"
    for bad in ["%n", "%p", "%C", "%*d", "%Lf", "%q", "%d %d"]:
        with pytest.raises(ValueError):
            formats.render_by_pattern(df, bad, ["n"])


def test_render_keeps_nulls(spark):
    df = table(spark, [(None,), (1.0,)], "v double")
    assert rows(formats.render_by_pattern(df, "%f", ["v"]), "line") == [("1.000000",), (None,)]
