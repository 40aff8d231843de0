"""Operator 8: secret scans by patterns and sliding-window entropy, in built-in expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind, pattern, group whose length counts, least length; kinds in the order of equal starts.  Runs that are
#: as long as can be match with their least length in the pattern just where they match without it.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are runs of at least ``window`` characters of ``chars``; bits are for ``window`` characters."""

    kind: str
    chars: str
    alphabet: str
    window: int
    bits: float
    fold: bool = False


CLASSES = [
    EntropyClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdef", 20, 3.0, fold=True),
    EntropyClass(
        "entropy_base64", "A-Za-z0-9+/=_-",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 24, 4.0,
    ),
]

#: Candidates that are no secrets: numbers, words joined by dashes or slashes, placeholders.  No group is repeated:
#: Java runs such a pattern by recursion, and a long run overflows its stack.
ALLOW = [
    r"^[0-9]+$",
    r"^[A-Za-z/_-]*$",
    r"(?i)example|placeholder|changeme|x{8,}",
]

_UNIT = 1 << 20
_BLOCK = 256
_BITS = 5
_SPANS = "array<struct<start:bigint,stop:bigint,hit:string>>"


def weight(n: int) -> int:
    """n log2 n in fixed point, so that sums do not depend on their order."""
    return round(n * math.log2(n) * _UNIT) if n else 0


def heaviest(c: EntropyClass) -> int:
    """A window has at least ``bits`` of entropy if its weights sum to this or less."""
    return math.floor(c.window * (math.log2(c.window) - c.bits) * _UNIT)


def _matches(text: Column, pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
    """Leftmost matches that do not overlap and whose ``group`` passes ``keep``, with their places.

    The text between matches and the matches are read in turn and their lengths added up.  Spans are
    gathered in blocks, so that a text with very many is not copied once for each.
    """
    none = F.array().cast(_SPANS)
    between = F.split(text, pattern, -1)
    hits, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    parts = F.arrays_zip(between.alias("gap"), hits.alias("hit"), values.alias("value"))

    def add(acc: Column, part: Column) -> Column:
        start = acc["pos"] + F.length(part["gap"])
        stop = start + F.length(part["hit"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), part["hit"].alias("hit"))).cast(_SPANS)
        open_ = F.when(part["hit"].isNotNull() & keep(part["value"]), F.concat(acc["open"], span)).otherwise(acc["open"])
        full = F.size(acc["open"]) >= _BLOCK
        return F.struct(
            stop.alias("pos"),
            F.when(full, F.concat(acc["done"], F.array(open_))).otherwise(acc["done"]).alias("done"),
            F.when(full, none).otherwise(open_).alias("open"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(f"array<{_SPANS}>").alias("done"), none.alias("open"))
    spans = F.aggregate(parts, start, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _hot_part(c: EntropyClass) -> Callable[[Column], Column]:
    return lambda span: _hot_windows(span, c)


def _packed(c: EntropyClass) -> tuple[Column, Column, list[Column]]:
    """By the code of a symbol: the word that has its count, the bit at which it begins, and what one adds to each word.

    Counts are at most the window's length, which ``_BITS`` hold; code 0 is no symbol and adds nothing.
    """
    each = 63 // _BITS
    codes = range(len(c.alphabet) + 1)
    words = -(-len(c.alphabet) // each)
    adds = [[1 << _BITS * (k - 1 - each * j) if 0 <= k - 1 - each * j < each else 0 for k in codes] for j in range(words)]
    word, shift = [max(k - 1, 0) // each for k in codes], [_BITS * (max(k - 1, 0) % each) for k in codes]
    return F.lit(word), F.lit(shift), [F.array(*[F.lit(n).cast("bigint") for n in a]) for a in adds]


def _hot_windows(span: Column, c: EntropyClass) -> Column:
    """``span`` cut down to its windows of high entropy: from the first one's start to the last one's end.

    One pass: each character enters the counts, the one that leaves the window is taken off, and the
    sum of n log2 n follows by differences.  Both places are null if there is no such window.  Counts are
    packed into a few longs, so a step changes these and not a counter for each symbol.
    """
    if c.window >= 1 << _BITS:
        raise ValueError(f"{c.kind}: windows have at most {(1 << _BITS) - 1} characters")
    text = F.lower(span["hit"]) if c.fold else span["hit"]
    codes = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(c.alphabet), ch))
    leaving = F.concat(F.array_repeat(F.lit(0), c.window), codes)
    steps = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    word, shift, adds = _packed(c)
    # what the sum gains when a count n becomes n + 1
    gains = F.array(*[F.lit(weight(n + 1) - weight(n)).cast("bigint") for n in range(c.window + 2)])

    def count(acc: Column, code: Column) -> Column:
        own = F.get(acc["n"], F.get(word, code))
        return F.call_function("shiftright", own, F.get(shift, code)).bitwiseAND((1 << _BITS) - 1).cast("int")

    def slide(acc: Column, step: Column) -> Column:
        new, old = step["new"], step["old"]
        loss = F.when(old > 0, F.get(gains, count(acc, old) - 1)).otherwise(0)
        change = F.when(new == old, 0).otherwise(F.get(gains, count(acc, new)) - loss)
        total, i = acc["sum"] + change, acc["i"] + 1
        hot = (i >= c.window) & (total <= heaviest(c))
        counts = F.array(*[F.get(acc["n"], F.lit(j)) + F.get(a, new) - F.get(a, old) for j, a in enumerate(adds)])
        moved = F.struct(
            i.alias("i"), counts.alias("n"), total.alias("sum"),
            F.coalesce(acc["first"], F.when(hot, i - c.window)).alias("first"),
            F.when(hot, i).otherwise(acc["last"]).alias("last"),
        )
        return F.when(new.isNull(), acc).otherwise(moved)

    start = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("bigint"), len(adds)).alias("n"), F.lit(0).cast("bigint").alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    part = F.aggregate(steps, start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    # as an array of one, so that the pass is made once and not for each of its fields
    both = F.transform(
        F.array(part),
        lambda p: F.struct((span["start"] + p["first"]).alias("start"), (span["start"] + p["last"]).alias("stop")),
    )
    return F.element_at(both, 1)


def _long(least: int) -> Callable[[Column], Column]:
    return lambda value: F.length(value) >= least


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    base: list[tuple[str, str, int, int]] = BASE,
    classes: list[EntropyClass] = CLASSES,
    allow: list[str] = ALLOW,
) -> DataFrame:
    """``(doc_id, <kind> …)``: for each row of ``docs`` and each kind the spans ``(start, stop)`` in its whole text.

    ``base`` patterns give their leftmost matches that do not overlap, those with too short a group
    dropped.  ``classes`` add, for each maximal run of their characters, the part between the first and
    the last window of high Shannon entropy, unless the run matches a pattern of ``allow``, which
    suppresses no base span.  Places count code points from 0, ends are exclusive.  Null and empty texts
    have no spans; repeated rows stay repeated; other columns are not read.  Texts and runs of any length are
    read whole, in one pass of a few changed words a character; a pattern of ``allow`` is searched in the whole run,
    so one that any part of it matches suppresses all of it.  One scan, no shuffle.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    spans = {k: _matches(text, pattern, group, _long(least)) for k, pattern, group, least in base}

    def wanted(value: Column) -> Column:
        suppressed = F.lit(False)
        for pattern in allow:
            suppressed = suppressed | value.rlike(pattern)
        return ~suppressed

    for c in classes:
        runs = _matches(text, f"[{c.chars}]{{{c.window},}}", 0, wanted)
        parts = F.transform(runs, _hot_part(c))
        spans[c.kind] = F.filter(parts, lambda p: p["start"].isNotNull())
    return out.select("doc_id", *[s.alias(k) for k, s in spans.items()])


def _joined(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind."""

    def tag(i: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), s["stop"].alias("stop"))

    tagged = [F.transform(F.col(kind), tag(i)) for i, kind in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.concat(*tagged))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["stop"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_secret_scan``: counts, digest of the base spans and all spans of every document."""
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = [k for k, *_ in BASE]
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(kinds), 256).alias("base_sha256"),
        _joined([*kinds, *[c.kind for c in CLASSES]]).alias("spans"),
    )


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    every = [(kind, p, g, f"length(s.val) >= {n}") for kind, p, g, n in BASE]
    allowed = " AND ".join(f"NOT regexp_matches(s.val, {quoted(p)})" for p in ALLOW)
    every += [(c.kind, f"[{c.chars}]{{{c.window},}}", 0, allowed) for c in CLASSES]
    found = [
        f"string_split_regex(t, {quoted(p)}) AS g_{k}, regexp_extract_all(t, {quoted(p)}) AS h_{k}, "
        f"regexp_extract_all(t, {quoted(p)}, {g}) AS v_{k}"
        for k, p, g, _ in every
    ]
    cols = [
        f"""list_filter(list_transform(range(1, len(h_{k}) + 1), lambda i: {{
            'a': list_sum(list_transform(g_{k}[1:i], lambda x: length(x)))::BIGINT
                 + coalesce(list_sum(list_transform(h_{k}[1:i - 1], lambda x: length(x))), 0)::BIGINT,
            'hit': h_{k}[i], 'val': v_{k}[i]}}), lambda s: {test}) AS m_{k}"""
        for k, _, _, test in every
    ]
    spans = [f"list_transform(m_{k}, lambda s: {{'a': s.a, 'k': {i}, 'b': s.a + length(s.hit), 'n': '{k}'}}) AS s_{k}" for i, (k, *_) in enumerate(BASE)]
    for i, c in enumerate(CLASSES, len(BASE)):
        table = "[" + ", ".join(str(weight(n)) for n in range(1, c.window + 1)) + "]"
        hit = "lower(s.hit)" if c.fold else "s.hit"
        total = f"list_sum(list_transform(map_values(list_histogram(string_split(substr({hit}, j::INT, {c.window}), ''))), lambda n: {table}[n::BIGINT]))"
        hot = f"list_filter(range(1, length(s.hit) - {c.window} + 2), lambda j: {total} <= {heaviest(c)})"
        parts = f"list_transform(m_{c.kind}, lambda s: {{'a': s.a + list_min({hot}) - 1, 'k': {i}, 'b': s.a + list_max({hot}) - 1 + {c.window}, 'n': '{c.kind}'}})"
        spans.append(f"list_filter({parts}, lambda s: s.a IS NOT NULL) AS s_{c.kind}")

    def joined(kinds: list[str]) -> str:
        every = "flatten([" + ", ".join(f"s_{k}" for k in kinds) + "])"
        return f"array_to_string(list_transform(list_sort({every}), lambda s: s.n || ':' || s.a || ':' || s.b), ',')"

    base = [k for k, *_ in BASE]
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, {", ".join(found)} FROM d),
    m AS (SELECT doc_id, {", ".join(cols)} FROM f),
    s AS (SELECT doc_id, {", ".join(spans)} FROM m)
    SELECT doc_id, {", ".join(f"len(s_{k})::BIGINT AS n_{k}" for k in base)},
           sha256({joined(base)}) AS base_sha256, {joined([*base, *[c.kind for c in CLASSES]])} AS spans FROM s"""


ORACLE = _sql()
