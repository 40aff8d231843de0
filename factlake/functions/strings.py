"""NUL-terminated texts, byte copies and escapes (T3, T4).  Lengths are in bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c_text(text: Column) -> Column:
    """The text before its first NUL."""
    return F.substring_index(text, "\0", 1)


def c_length(text: Column) -> Column:
    return F.octet_length(c_text(text)).cast("bigint")


def free_length(text: Column, stop: str) -> Column:
    """Bytes before the first character of ``stop`` or the NUL."""
    stops = stop.split("\0", 1)[0]
    if not stops.isascii():
        raise ValueError("stop characters are ASCII")
    if not stops:
        return c_length(text)
    inside = "".join(re.escape(ch) for ch in stops)
    return F.octet_length(F.regexp_extract(c_text(text), f"^[^{inside}]*", 0)).cast("bigint")


def copy_bytes(dest: Column, source: Column, n: int) -> Column:
    """``dest`` with its first ``n`` bytes taken from ``source``, as binary."""
    head = F.substring(F.encode(source, "utf-8"), F.lit(1), F.lit(n))
    return F.concat(head, _from_byte(dest, n))


def fill_bytes(dest: Column, ch: str, n: int) -> Column:
    """``dest`` with its first ``n`` bytes (all, if it has fewer) set to ``ch``, as binary."""
    if len(ch.encode()) != 1:
        raise ValueError("the fill is one byte")
    count = F.least(F.octet_length(dest), F.lit(n))
    return F.concat(F.encode(F.repeat(F.lit(ch), count), "utf-8"), _from_byte(dest, n))


def _from_byte(text: Column, n: int) -> Column:
    return F.substring(F.encode(text, "utf-8"), F.lit(n + 1), F.octet_length(text))


def clean_cstrings(df: DataFrame, col: str, n: int, stop: str, fill: str = "*") -> DataFrame:
    """``c_len``, ``head`` (first ``n`` bytes), ``free_len`` and ``masked`` for a text column."""
    text = F.col(col)
    return df.withColumns(
        {
            "c_len": c_length(text),
            "head": F.substring(F.encode(text, "utf-8"), F.lit(1), F.lit(n)),
            "free_len": free_length(text, stop),
            "masked": fill_bytes(text, fill, n),
        }
    )


# Characters with an escape of their own.
ESCAPES = {"\\": "\\\\", "{": "{{", "}": "}}", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"'}


def escape_text(text: Column) -> Column:
    """T4: escapes for a format string: doubled braces, C escapes, NUL dropped, ``\\u{hex}``."""
    plain = F.replace(text, F.lit("\0"), F.lit(""))
    for ch, to in ESCAPES.items():
        plain = F.replace(plain, F.lit(ch), F.lit(to))
    runs = F.regexp_extract_all(plain, F.lit("[ -~]+|[^ -~]"), F.lit(0))
    coded = F.transform(
        runs,
        lambda run: F.when(run.between(" ", "~"), run).otherwise(
            F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(run))), F.lit("}"))
        ),
    )
    return F.when(plain.rlike("[^ -~]"), F.array_join(coded, "")).otherwise(plain)


def unescape_text(text: Column) -> Column:
    """T4: the inverse of ``escape_text``, apart from NULs."""
    back = {to: ch for ch, to in ESCAPES.items()}
    runs = F.regexp_extract_all(
        text, F.lit(r"\\u\{[0-9a-f]+\}|\\.|\{\{|\}\}|[^\\{}]+|[{}]"), F.lit(0)
    )

    def one(run: Column) -> Column:
        code = F.lpad(F.regexp_extract(run, "^..\\{([0-9a-f]+)\\}$", 1), 8, "0")
        coded = F.decode(F.unhex(code), "UTF-32")
        result = F.when(run.startswith("\\u{"), coded)
        for to, ch in back.items():
            result = result.when(run == to, F.lit(ch))
        return result.otherwise(run)

    return F.array_join(F.transform(runs, one), "")


def escape_column(df: DataFrame, col: str) -> DataFrame:
    """T4 on a column: replaces it by its escaped form."""
    return df.withColumn(col, escape_text(F.col(col)))
