import math

import pytest

from factlake.functions import numbers
from tests.helpers import table

I64, U64 = numbers.I64_MAX, numbers.U64_MAX
INTS = [
    # text, base, signed, value, status, rest
    ("", 10, True, 0, "no_number", ""),
    ("  +12x", 10, True, 12, "ok", "x"),
    ("\t\n\f\r 7", 10, True, 7, "ok", ""),
    ("\x0b12", 10, True, 0, "no_number", "\x0b12"),
    ("-", 10, True, 0, "no_number", ""),
    ("+-5", 10, True, 0, "no_number", "-5"),
    ("0x", 16, True, 0, "no_number", ""),
    ("0xg", 16, True, 0, "no_number", "g"),
    ("0g", 16, True, 0, "ok", "g"),
    ("0x1F", 0, True, 31, "ok", ""),
    ("0X1Fz", 0, True, 31, "ok", "z"),
    ("0x", 0, True, 0, "no_number", ""),
    ("017", 0, True, 15, "ok", ""),
    ("08", 0, True, 0, "ok", "8"),
    ("19a", 0, True, 19, "ok", "a"),
    ("-5", 10, False, 5, "ok", ""),
    ("-5", 10, True, -5, "ok", ""),
    ("9223372036854775807", 10, True, I64, "ok", ""),
    ("9223372036854775808", 10, True, I64, "out_of_range", ""),
    ("-9223372036854775808", 10, True, -I64 - 1, "ok", ""),
    ("-9223372036854775809", 10, True, -I64 - 1, "out_of_range", ""),
    ("18446744073709551615", 10, False, U64, "ok", ""),
    ("18446744073709551616", 10, False, U64, "out_of_range", ""),
    ("99999999999999999999", 10, False, U64, "out_of_range", ""),
    ("000000000000000000000000000000000000000000012", 10, True, 12, "ok", ""),
    ("9" * 60 + "q", 10, True, I64, "out_of_range", "q"),
    ("zZ9!", 36, True, 35 * 1296 + 35 * 36 + 9, "ok", "!"),
    ("1012", 2, True, 5, "ok", "2"),
    ("f" * 16, 16, False, U64, "ok", ""),
    ("1" + "0" * 16, 16, False, U64, "out_of_range", ""),
    ("1777777777777777777777", 8, False, U64, "ok", ""),
    ("2000000000000000000000", 8, False, U64, "out_of_range", ""),
    ("12", 1, True, 0, "bad_base", "12"),
    ("12", 37, True, 0, "bad_base", "12"),
]


def test_integers(spark):
    for base, signed in sorted({(c[1], c[2]) for c in INTS}):
        cases = [c for c in INTS if c[1:3] == (base, signed)]
        df = table(spark, [(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
        got = numbers.parse_int_prefix(df, "s", base, signed).orderBy("i").collect()
        for case, r in zip(cases, got):
            assert (int(r["value"]), r["status"], r["rest"]) == case[3:], case


FLOATS = [
    ("inf", math.inf, "ok", ""),
    ("-INFINITY!", -math.inf, "ok", "!"),
    ("infi", 0.0, "no_number", ""),
    ("infinit9", 0.0, "no_number", "9"),
    ("i", 0.0, "no_number", ""),
    ("na", 0.0, "no_number", ""),
    ("NaNa", math.nan, "ok", "a"),
    ("1e", 1.0, "ok", ""),
    ("1e+x", 1.0, "ok", "x"),
    ("1e2", 100.0, "ok", ""),
    (" -2.5E-1z", -0.25, "ok", "z"),
    ("1.2.3", 1.2, "ok", ".3"),
    ("1.", 1.0, "ok", ""),
    (".5", 0.5, "ok", ""),
    (".", 0.0, "no_number", ""),
    (".e5", 0.0, "no_number", "e5"),
    ("", 0.0, "no_number", ""),
    ("1e400", math.inf, "out_of_range", ""),
    ("-1e400", -math.inf, "out_of_range", ""),
    ("1e-400", 0.0, "out_of_range", ""),
    ("0e-400", 0.0, "ok", ""),
    ("0x1p3", 0.0, "no_number", "0x1p3"),
    ("İnf", 0.0, "no_number", "İnf"),
]


def test_floats(spark):
    df = table(spark, [(i, c[0]) for i, c in enumerate(FLOATS)], "i int, s string")
    for case, r in zip(FLOATS, numbers.parse_float_prefix(df, "s").orderBy("i").collect()):
        same = r["value"] == case[1] or (math.isnan(case[1]) and math.isnan(r["value"]))
        assert same and (r["status"], r["rest"]) == case[2:], (case, r)


def test_null_and_quality(spark):
    df = table(spark, [(None,), ("5 ",), ("x",), ("9" * 30,)], "s string")
    parsed = numbers.parse_int_prefix(df, "s")
    assert parsed.filter("s IS NULL").first()["status"] is None
    q = numbers.parse_quality(parsed).first().asDict()
    assert q == {"n_rows": 4, "n_ok": 1, "n_no_number": 1, "n_out_of_range": 1, "n_trailing": 1}


@pytest.mark.parametrize(
    "text, want",
    [("42x", 42), ("-1", -1), ("2147483648", -(1 << 31)), ("4294967297", 1), ("9" * 30, -1), ("x", 0)],
)
def test_atoi_keeps_the_low_bits(spark, text, want):
    assert numbers.with_atoi(table(spark, [(text,)], "s string"), "s", "v").first()["v"] == want


def test_integers_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        test_integers(spark)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
