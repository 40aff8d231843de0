"""Format strings: inventory of conversion specs, extraction and rendering by pattern."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.numbers import wide, with_int_prefix

# The grammar of a conversion spec, in groups.
# printf: flags, width, .precision, precision, length, conversion
PRINTF_SPEC = (
    r"%(['\-+ #0]*)(\*|[1-9][0-9]*)?(\.(\*|[0-9]*))?(hh|h|ll|l|j|z|t|L)?([diouxXfFeEgGaAcspnCS%])"
)
# scanf: suppression, width, length, conversion or set
SCANF_SPEC = (
    r"%(?:(\*)|([0-9]+))?(hh|h|ll|l|j|z|t|L)?"
    r"([diouxaefgscpnCS%]|\[(?:\^[^\]^]*|[^\]^][^\]^]*)\])"
)
_SPECS = {"printf": PRINTF_SPEC, "scanf": SCANF_SPEC}

# Value type by conversion and length ("" is no length).  A pair that is not listed
# has no type; %n and %% take no value.
_SIGNED = {"": "i32", "hh": "i8", "h": "i16", "l": "i64", "ll": "i64", "j": "i64", "z": "i64", "t": "u64"}
_UNSIGNED = {"": "u32", "hh": "u8", "h": "u16", "l": "u64", "ll": "u64", "j": "u64", "z": "u64", "t": "u64"}
_ANY_LENGTH = ["", "hh", "h", "l", "ll", "j", "z", "t", "L"]
PRINTF_TYPES = {
    "d": _SIGNED,
    "o": _UNSIGNED,
    "u": _UNSIGNED,
    "x": _UNSIGNED,
    "X": _UNSIGNED,
    "f": {"": "f64", "l": "f64", "L": "f128"},
    "e": {"": "f64", "l": "f64", "L": "f128"},
    "g": {"": "f64", "l": "f64"},
    "a": {"": "f64", "l": "f64"},
    "c": dict.fromkeys(_ANY_LENGTH, "char"),
    "s": {"": "str", "l": "str"},
    "p": dict.fromkeys(_ANY_LENGTH, "usize"),
}
SCANF_TYPES = {
    "d": _SIGNED,
    "i": _SIGNED,
    "o": _UNSIGNED,
    "u": _UNSIGNED,
    "x": _UNSIGNED,
    "g": {"": "f32", "l": "f64", "L": "f128"},
    "s": dict.fromkeys(_ANY_LENGTH, "str"),
    "[": dict.fromkeys(_ANY_LENGTH, "str"),
    "c": {"": "i8"},
}
# Conversions that are written another way in the canonical text.
PRINTF_FOLDS = {"i": "d", "F": "f", "E": "e", "G": "g", "A": "a"}
SCANF_FOLDS = {"a": "g", "e": "g", "f": "g"}


def _folded(conversion: Column, folds: dict[str, str]) -> Column:
    result = conversion
    for old, new in folds.items():
        result = F.when(conversion == old, new).otherwise(result)
    return result


def _typed(letter: Column, length: Column, types: dict[str, dict[str, str]]) -> Column:
    pairs = [(f"{c}{n}", t) for c, lengths in types.items() for n, t in lengths.items()]
    table = F.map_from_arrays(
        F.array(*[F.lit(p) for p, _ in pairs]), F.array(*[F.lit(t) for _, t in pairs])
    )
    return F.try_element_at(table, F.concat(letter, length))


def placeholder_specs(df: DataFrame, col: str, style: str = "printf") -> DataFrame:
    """T5: one row for each ``%`` spec of ``col`` in order.

    Adds ``pos``, ``spec`` (as written), ``flags`` (``*`` for a suppressed scanf value), ``width``,
    ``precision``, ``length``, ``conversion``, ``canonical``, ``value_type`` and ``status``: ``ok``,
    ``untyped`` (no value type for this length) or ``bad`` (a percent sign that starts no spec).
    """
    if style not in _SPECS:
        raise ValueError(f"unknown style {style!r}")
    pattern = _SPECS[style]
    keep = [c for c in df.columns if c != col]
    found = F.regexp_extract_all(F.col(col), F.lit(f"{pattern}|%"), F.lit(0))
    specs = df.filter(F.col(col).contains("%")).select(*keep, F.posexplode(found).alias("pos", "spec"))

    def group(i: int) -> Column:
        return F.regexp_extract("spec", f"^{pattern}$", i)

    none = F.lit("")
    if style == "printf":
        folds, types = PRINTF_FOLDS, PRINTF_TYPES
        parts = {"flags": group(1), "width": group(2), "precision": group(4), "length": group(5)}
        raw = group(6)
    else:
        folds, types = SCANF_FOLDS, SCANF_TYPES
        parts = {"flags": group(1), "width": group(2), "precision": none, "length": group(3)}
        raw = group(4)
    split = specs.withColumns({**parts, "conversion": _folded(raw, folds)})

    def decimal(name: str) -> Column:
        """A number without leading zeros; an empty precision counts as none."""
        return F.regexp_replace(name, "^0+(?=[0-9])", "")

    split = split.withColumns({"width": decimal("width"), "precision": decimal("precision")})
    bad = F.col("conversion") == ""
    letter = F.left("conversion", F.lit(1))
    dot = F.when(F.col("precision") != "", F.concat(F.lit("."), "precision")).otherwise("")
    shown = F.col("conversion")
    if style == "scanf":
        for ch, to in {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "'": "\\'", '"': '\\"', "\0": "\\0"}.items():
            shown = F.replace(shown, F.lit(ch), F.lit(to))
    canonical = F.concat(F.lit("%"), "flags", "width", dot, "length", shown)
    free = letter.isin("n", "%") if style == "printf" else F.lit(False)
    kind = _typed(letter, F.col("length"), types)
    status = F.when(bad, "bad").when(kind.isNotNull() | free, "ok").otherwise("untyped")
    return split.select(
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        "spec",
        *[F.when(~bad, F.col(c)).alias(c) for c in ("flags", "width", "precision", "length", "conversion")],
        F.when(~bad, canonical).alias("canonical"),
        F.when(~bad, kind).alias("value_type"),
        status.alias("status"),
    )


def placeholder_inventory(df: DataFrame, col: str, style: str = "printf") -> DataFrame:
    """T5 in short: how often each canonical spec occurs."""
    specs = placeholder_specs(df, col, style)
    return specs.groupBy("canonical", "value_type", "status").agg(F.count(F.lit(1)).alias("n"))


_BLANK = r"[ \t\n\f\r]*"
_WORD = r"[^ \t\n\x0B\f\r]"
_RANGES = {
    "i8": (-(1 << 7), (1 << 7) - 1),
    "i16": (-(1 << 15), (1 << 15) - 1),
    "i32": (-(1 << 31), (1 << 31) - 1),
    "i64": (-(1 << 63), (1 << 63) - 1),
    "u8": (0, (1 << 8) - 1),
    "u16": (0, (1 << 16) - 1),
    "u32": (0, (1 << 32) - 1),
    "u64": (0, (1 << 64) - 1),
}

_SPARK_TYPES = {
    "i8": "tinyint",
    "i16": "smallint",
    "i32": "int",
    "i64": "bigint",
    "u8": "smallint",
    "u16": "int",
    "u32": "bigint",
}


def _count(width: str) -> str:
    return f"{{1,{int(width)}}}" if width else "+"


def _scan_regex(conversion: str, width: str) -> str:
    """The text one spec takes, without the blanks before it."""
    if width and int(width) == 0:
        raise ValueError("a width of 0 takes nothing")
    if conversion in ("d", "u", "i", "o", "x"):
        digits = {"d": "[0-9]", "u": "[0-9]", "o": "[0-7]"}.get(conversion)
        if digits:
            signed = f"[+-]{digits}{{1,{int(width) - 1}}}|" if width and int(width) > 1 else ""
            plain = f"{digits}{_count(width)}"
            return f"(?:{signed}{plain})" if width else f"[+-]?{digits}+"
        if width:
            raise ValueError(f"%{width}{conversion}: a width is supported for d, u, o, s, c and sets")
        if conversion == "x":
            return "[+-]?(?:0[xX])?[0-9a-fA-F]+"
        return "[+-]?(?:0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)"
    if conversion == "g":
        if width:
            raise ValueError("a width is not supported for floating-point conversions")
        return r"[+-]?(?:(?i:infinity|inf|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    if conversion == "s":
        return f"{_WORD}{_count(width)}"
    if conversion == "c":
        return f"(?s:.){{{int(width or 1)}}}"
    inner = conversion[1:-1]
    negative = inner.startswith("^")
    chars = inner[1:] if negative else inner
    if not chars:
        return f"(?s:.){_count(width)}"
    # every character of the set is literal: a hyphen makes no range
    listed = "".join(re.escape(ch) for ch in dict.fromkeys(chars))
    return f"[{'^' if negative else ''}{listed}]{_count(width)}"


def compile_scan(pattern: str) -> tuple[str, list[tuple[str, str]]]:
    """One literal scanf pattern as a regular expression and the ``(conversion, type)`` it keeps."""
    regex, kept, at = "^", [], 0
    for m in re.finditer(f"{SCANF_SPEC}|%", pattern):
        regex += _literal(pattern[at : m.start()])
        at = m.end()
        if m.group(0) == "%":
            raise ValueError(f"malformed conversion at {pattern[m.start():]!r}")
        suppressed, width, length, conversion = (g or "" for g in m.groups())
        if conversion == "%":
            regex += _BLANK + "%"
            continue
        folded = SCANF_FOLDS.get(conversion, conversion)
        value_type = SCANF_TYPES.get(folded[0], {}).get(length)
        if value_type is None or value_type == "f128":
            raise ValueError(f"{m.group(0)} has no value type here")
        blank = "" if folded[0] in ("c", "[") else _BLANK
        body = _scan_regex(folded, width)
        if suppressed:
            regex += f"{blank}(?:{body})"
        else:
            regex += f"{blank}({body})"
            kept.append((folded, value_type))
    return regex + _literal(pattern[at:]), kept


def _literal(text: str) -> str:
    """Blanks in a pattern match any blanks; everything else stands for itself."""
    pieces = re.split(r"[ \t\n\f\r]+", text)
    return _BLANK.join(re.escape(p) for p in pieces)


def _with_value(df: DataFrame, text: str, out: str, conversion: str, value_type: str) -> DataFrame:
    """Add ``struct(value, ok)`` for the text one spec took; the pattern has settled its syntax."""
    taken = F.col(text)
    if conversion == "c" or value_type == "str":
        return df.withColumn(out, F.struct(taken.alias("value"), F.lit(True).alias("ok")))
    if conversion == "g":
        number = taken.try_cast("float" if value_type == "f32" else "double")
        huge = (F.abs(number) == float("inf")) & ~taken.rlike("[iI]")
        lost = (number == 0) & taken.rlike(r"^[+-]?[0-9.]*[1-9]")
        return df.withColumn(out, F.struct(number.alias("value"), (~(huge | lost)).alias("ok")))
    if conversion in ("d", "u"):
        number = taken.try_cast("decimal(38,0)")
        number = number if value_type.startswith("i") else F.abs(number)
        exact = number.isNotNull()
    else:
        base = {"i": 0, "o": 8, "x": 16}[conversion]
        df = with_int_prefix(df, text, f"{out}_p", base, signed=value_type.startswith("i"))
        number, exact = F.col(f"{out}_p.value"), F.col(f"{out}_p.status") == "ok"
    low, high = _RANGES[value_type]
    inside = exact & number.between(wide(low), wide(high))
    small = F.when(inside, number).cast(_SPARK_TYPES.get(value_type, "decimal(20,0)"))
    return df.withColumn(out, F.struct(small.alias("value"), inside.alias("ok")))


def extract_by_pattern(
    df: DataFrame, col: str, pattern: str, names: list[str]
) -> tuple[DataFrame, DataFrame]:
    """``(matched, quarantine)`` — columns read from ``col`` by one scanf pattern.

    ``names`` are the columns for the specs that are kept, in order.  ``%*`` matches without
    keeping.  Rows that do not match, and rows whose number does not fit its type, are quarantined.
    """
    regex, kept = compile_scan(pattern)
    if len(kept) != len(names):
        raise ValueError(f"the pattern keeps {len(kept)} values, not {len(names)}")
    text = F.col(col)
    matches = F.coalesce(text.rlike(regex), F.lit(False))
    texts = {f"_t{i}": F.regexp_extract(text, regex, i + 1) for i in range(len(kept))}
    rows = df.withColumns(texts)
    for i, spec in enumerate(kept):
        rows = _with_value(rows, f"_t{i}", f"_v{i}", *spec)
    good = matches
    for i in range(len(kept)):
        good = good & F.col(f"_v{i}.ok")
    # a row number is no pure function of the row, so Catalyst leaves the filter above it: pushed
    # below, the filter would take a second copy of every expression in the columns it looks at
    rows = rows.withColumns({"_good": good, "_row": F.monotonically_increasing_id()})
    values = [F.col(f"_v{i}.value").alias(n) for i, n in enumerate(names)]
    rest = [F.col(c) for c in df.columns]
    return (
        rows.filter("_good AND _row >= 0").select(*rest, *values),
        rows.filter("NOT _good AND _row >= 0").select(*rest),
    )


def _float_text(spec: str) -> Callable[[Column], Column]:
    """Floating-point conversion with the rounding of C.

    Java rounds the shortest decimal form half up, C the exact binary value, and no built-in
    expression gives the latter.  One Arrow batch is formatted at a time.
    """

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        # a missing double and a NaN look alike here: the caller restores the nulls
        return pd.Series([spec % v for v in values.to_numpy(dtype="float64")], dtype="object")

    return convert


def _padded(text: Column, flags: str, width: str) -> Column:
    if not width:
        return text
    size = F.greatest(F.lit(int(width)), F.length(text))
    if "-" in flags:
        return F.rpad(text, size, F.lit(" "))
    if "0" in flags:
        sign = F.regexp_extract(text, "^[+ -]?(?:0[xX])?", 0)
        digits = F.substring(text, F.length(sign) + 1, F.length(text))
        return F.concat(sign, F.lpad(digits, size - F.length(sign), F.lit("0")))
    return F.lpad(text, size, F.lit(" "))


def render_by_pattern(df: DataFrame, pattern: str, cols: list[str], out: str = "line") -> DataFrame:
    """``out`` is ``pattern`` with its specs filled from ``cols``, as printf would.

    ``%n``, ``%p``, ``%a``, ``%C``, ``%S``, star widths and long doubles are rejected.
    """
    pieces, at, used = [], 0, 0
    for m in re.finditer(f"{PRINTF_SPEC}|%", pattern):
        if m.start() > at:
            pieces.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m.group(0) == "%":
            raise ValueError(f"malformed conversion at {pattern[m.start():]!r}")
        flags, width, dotted, precision, length, conversion = (g or "" for g in m.groups())
        if conversion == "%":
            pieces.append(F.lit("%"))
            continue
        folded = PRINTF_FOLDS.get(conversion, conversion)
        value_type = PRINTF_TYPES.get(folded, {}).get(length)
        if value_type in (None, "f128", "usize") or folded == "a" or "*" in (width, precision):
            raise ValueError(f"{m.group(0)} cannot be rendered")
        if used == len(cols):
            raise ValueError("more conversions than columns")
        value = F.col(cols[used])
        used += 1
        pieces.append(_rendered(value, flags, width, dotted, precision, conversion, value_type))
    if used != len(cols):
        raise ValueError(f"{len(cols)} columns for {used} conversions")
    if at < len(pattern):
        pieces.append(F.lit(pattern[at:]))
    return df.withColumn(out, F.concat(*pieces) if pieces else F.lit(""))


def _rendered(
    value: Column, flags: str, width: str, dotted: str, precision: str, conversion: str, value_type: str
) -> Column:
    flags = "".join(dict.fromkeys(flags))
    folded = PRINTF_FOLDS.get(conversion, conversion)
    if "'" in flags:
        raise ValueError("the ' flag depends on a locale")
    if folded == "s":
        text = value.cast("string")
        return _padded(F.left(text, F.lit(int(precision or 0))) if dotted else text, flags.replace("0", ""), width)
    if folded == "c":
        return _padded(F.chr(value), flags.replace("0", ""), width)
    if folded in ("f", "e", "g"):
        number = value.cast("double")
        spec = f"%{flags}{width}{'.' + precision if dotted else ''}{conversion}"
        return F.when(number.isNotNull(), _float_text(spec)(number))
    return _integer(value, flags, width, dotted, precision, folded, value_type)


def _integer(
    value: Column, flags: str, width: str, dotted: str, precision: str, folded: str, value_type: str
) -> Column:
    number = value.cast("decimal(20,0)")
    low, high = _RANGES[value_type]
    span = F.lit(str(high - low + 1)).cast("decimal(21,0)")
    # the argument is cut to its type, as the callee reads it
    wrapped = F.pmod(number - F.lit(str(low)).cast("decimal(21,0)"), span) + F.lit(str(low)).cast("decimal(21,0)")
    if folded in ("d", "u"):
        digits = F.abs(wrapped).cast("decimal(20,0)").cast("string")
    else:
        digits = F.conv(wrapped.cast("decimal(20,0)").cast("string"), 10, 8 if folded == "o" else 16)
    if dotted:
        least = int(precision or 0)
        digits = F.when((number == 0) & F.lit(least == 0), F.lit("")).otherwise(
            F.lpad(digits, F.greatest(F.length(digits), F.lit(least)), F.lit("0"))
        )
    if folded == "x":
        digits = F.lower(digits)
    if "#" in flags and folded in ("x", "X"):
        digits = F.when(wrapped == 0, digits).otherwise(F.concat(F.lit("0" + folded), digits))
    if "#" in flags and folded == "o":
        digits = F.when(digits.startswith("0"), digits).otherwise(F.concat(F.lit("0"), digits))
    sign = F.lit("")
    if folded == "d":
        plus = "+" if "+" in flags else (" " if " " in flags else "")
        sign = F.when(wrapped < 0, "-").otherwise(F.lit(plus))
    text = F.concat(sign, digits)
    return _padded(text, flags.replace("0", "") if dotted else flags, width)
