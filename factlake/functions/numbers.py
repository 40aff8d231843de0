"""Numbers at the start of a text, as the C library reads them.

All expressions are built in, so they run inside the scan stage.  Blanks are space, tab, newline,
form feed and carriage return; a vertical tab is not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\f\r"
_BLANK = r"[ \t\n\f\r]*"

U64_MAX = (1 << 64) - 1
I64_MAX = (1 << 63) - 1
I64_MIN = -(1 << 63)
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def wide(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _in_base(value: int, base: int) -> str:
    text = ""
    while value:
        value, digit = divmod(value, base)
        text = _DIGITS[digit] + text
    return text


def _digit_class(base: int) -> str:
    if base <= 10:
        return f"0-{base - 1}"
    last = _DIGITS[base - 1]
    return f"0-9a-{last}A-{last.upper()}"


def _unsigned(digits: Column, base: int) -> Column:
    """The value of a digit string as decimal(20,0); null when it does not fit 64 bits."""
    bare = F.lower(F.ltrim(digits, F.lit("0")))
    top = _in_base(U64_MAX, base)
    fits = (F.length(bare) < len(top)) | ((F.length(bare) == len(top)) & (bare <= top))
    # conv raises on overflow under ANSI, so it only sees strings that fit
    number = bare if base == 10 else F.conv(bare, base, 10)
    return F.when(bare == "", wide(0)).when(fits, number.cast("decimal(20,0)"))


def _staged(df: DataFrame, text: str, out: str, stages: list[dict[str, Column]]) -> DataFrame:
    """Add ``out`` (a struct of value, status and rest) by way of the helper columns in ``stages``.

    Each stage is a projection of its own: what a later stage uses more than once is then computed
    once for each row instead of being copied into every use.
    """
    for stage in stages:
        df = df.withColumns({f"{out}_{name}": column for name, column in stage.items()})
    made = {f"{out}_{name}" for stage in stages for name in stage}
    parts = [F.col(f"{out}_{name}").alias(name) for name in ("value", "status", "rest")]
    result = F.when(F.col(text).isNotNull(), F.struct(*parts)).alias(out)
    return df.select(*[F.col(c) for c in df.columns if c not in made], result)


def with_int_prefix(
    df: DataFrame, text: str, out: str, base: int = 10, signed: bool = True
) -> DataFrame:
    """Add ``out``: ``struct(value, status, rest)`` of the integer at the start of column ``text``.

    ``status`` is ``ok``, ``no_number``, ``out_of_range`` (the value is clamped) or ``bad_base``.
    ``rest`` is what is left after the blanks, sign, prefix and digits that were taken.  Base 0 reads
    the base from the number.  The unsigned form ignores a minus sign, and ``0x`` without a digit is
    no number.
    """
    kind = "bigint" if signed else "decimal(20,0)"
    s, c = F.col(text), lambda name: F.col(f"{out}_{name}")
    if base != 0 and not 2 <= base <= 36:
        fail = {"value": F.lit(0).cast(kind), "status": F.lit("bad_base"), "rest": s}
        return _staged(df, text, out, [fail])
    if base == 0:
        body = "(?:0[xX][0-9a-fA-F]*|0[0-7]*|[1-9][0-9]*|)"
    elif base == 16:
        body = "(?:0[xX])?[0-9a-fA-F]*"
    else:
        body = f"[{_digit_class(base)}]*"
    hexed = F.lower(F.left(c("number"), F.lit(2))) == "0x"
    digits = c("number")
    value = _unsigned(c("digits"), base or 10)
    if base in (0, 16):
        digits = F.when(hexed, F.substring(c("number"), F.lit(3), F.length(c("number")))).otherwise(digits)
    if base == 0:
        value = (
            F.when(hexed, _unsigned(c("digits"), 16))
            .when(c("digits").startswith("0"), _unsigned(c("digits"), 8))
            .otherwise(value)
        )
    if signed:
        limit = F.when(c("negative"), wide(-I64_MIN)).otherwise(wide(I64_MAX))
        clamped = F.when(c("negative"), wide(I64_MIN)).otherwise(wide(I64_MAX))
        over = c("exact").isNull() | (c("exact") > limit)
        exact = F.when(c("negative"), -c("exact")).otherwise(c("exact"))
    else:
        clamped, over, exact = wide(U64_MAX), c("exact").isNull(), c("exact")
    none = c("digits") == ""
    return _staged(
        df,
        text,
        out,
        [
            {"taken": F.regexp_extract(s, f"^{_BLANK}[+-]?{body}", 0)},
            {"token": F.ltrim(c("taken"), F.lit(BLANKS))},
            {"number": F.ltrim(c("token"), F.lit("+-")), "negative": c("token").startswith("-")},
            {"digits": digits},
            {"exact": value},
            {
                "value": F.when(none, wide(0)).when(over, clamped).otherwise(exact).cast(kind),
                "status": F.when(none, "no_number").when(over, "out_of_range").otherwise("ok"),
                "rest": F.substring(s, F.length(c("taken")) + 1, F.length(s)),
            },
        ],
    )


def with_float_prefix(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: ``struct(value, status, rest)`` of the number at the start of column ``text``.

    ``inf``, ``infinity`` and ``nan`` count in any case, but no other beginning of them does.  An
    exponent without digits is taken from the text and does not count.  Hexadecimal is no number.
    Out of range: an infinite result, or zero although a digit is not.
    """
    s, c = F.col(text), lambda name: F.col(f"{out}_{name}")
    word = "(?i)^(?:i(?:n(?:f(?:i(?:n(?:i(?:ty?)?)?)?)?)?)?|n(?:an?)?)"
    infinite, nan = F.lit(float("inf")), F.lit(float("nan"))
    exponent = F.substring(c("number"), F.length(c("plain")) + 1, F.length(c("number")))
    counted = F.when(c("exponent").rlike("[0-9]"), c("number")).otherwise(c("plain"))
    sign = F.when(c("lead").endswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    is_inf, is_nan = c("word").isin("inf", "infinity"), c("word") == "nan"
    none = (c("word") != "") | c("hex") | ~c("digit")
    lost = (c("size") == infinite) | ((c("size") == 0) & c("plain").rlike("[1-9]"))
    used = (
        F.when(c("word") != "", F.length(c("word")))
        .when(c("hex"), F.lit(0))
        .when(c("digit"), F.length(c("number")))
        .otherwise(F.length(c("plain")))
    )
    return _staged(
        df,
        text,
        out,
        [
            {"lead": F.regexp_extract(s, f"^{_BLANK}[+-]?", 0)},
            {"body": F.substring(s, F.length(c("lead")) + 1, F.length(s))},
            {
                "word": F.lower(F.regexp_extract(c("body"), word, 0)),
                "number": F.regexp_extract(c("body"), r"^[0-9]*\.?[0-9]*(?:[eE][+-]?[0-9]*)?", 0),
                "hex": c("body").rlike("^0[xX]"),
            },
            {"plain": F.regexp_extract(c("number"), r"^[0-9.]*", 0)},
            {"exponent": exponent, "digit": c("plain").rlike("[0-9]")},
            {"size": counted.try_cast("double")},
            {
                "value": F.when(is_inf, sign * infinite)
                .when(is_nan, nan)
                .when(none, F.lit(0.0))
                .otherwise(sign * c("size")),
                "status": F.when(is_inf | is_nan, "ok")
                .when(none, "no_number")
                .when(lost, "out_of_range")
                .otherwise("ok"),
                "rest": F.substring(c("body"), used + 1, F.length(c("body"))),
            },
        ],
    )


def with_atoi(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the low 32 bits, as a signed number, of the value clamped to 64 bits."""
    parsed = with_int_prefix(df, text, "_atoi")
    low = F.col("_atoi.value").bitwiseAND(F.lit(0xFFFFFFFF))
    wrapped = F.when(low >= 1 << 31, low - F.lit(1 << 32)).otherwise(low)
    return parsed.withColumn(out, wrapped.cast("int")).drop("_atoi")


def _unpacked(df: DataFrame, packed: str) -> DataFrame:
    rest = [F.col(c) for c in df.columns if c != packed]
    return df.select(*rest, *[F.col(f"{packed}.{n}").alias(n) for n in ("value", "status", "rest")])


def parse_int_prefix(df: DataFrame, col: str, base: int = 10, signed: bool = True) -> DataFrame:
    """Adds ``value``, ``status`` and ``rest``."""
    return _unpacked(with_int_prefix(df, col, "_p", base, signed), "_p")


def parse_float_prefix(df: DataFrame, col: str) -> DataFrame:
    """Adds ``value``, ``status`` and ``rest``."""
    return _unpacked(with_float_prefix(df, col, "_p"), "_p")


def parse_quality(parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How the parsing of a column went, for the table or for each group."""
    status = F.col("status")
    return parsed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(status == "ok").alias("n_ok"),
        F.count_if(status == "no_number").alias("n_no_number"),
        F.count_if(status == "out_of_range").alias("n_out_of_range"),
        F.count_if((status != "no_number") & (F.col("rest") != "")).alias("n_trailing"),
    )
