"""Small tables for the tests of the llm operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

#: Extra columns whose names operators might use themselves.
CLASHES = ["size", "Target", "taken", "_key", "_bucket", "dropped", "n_lines", "_Version", "fp", "component_id", "id", "held_out", "start"]
_FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in _FIELDS] + [T.StructField(c, T.StringType()) for c in CLASHES])


def documents(spark, rows):
    """``(doc_id, text[, lang[, source]])`` as a documents table with clashing extra columns."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *("en", "s0")[len(row) - 2 :])
        full.append((doc_id, text, lang, source, len(text or ""), *("x" for _ in CLASHES)))
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int, size: int = 400) -> str:
    """``n`` words over ``size`` invented ones, in sentences on lines."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(1 + i % 4)) for i in range(size)]
    out = []
    while n > 0:
        k = min(n, rng.randint(8, 30))
        out.append(" ".join(rng.choice(words) for _ in range(k)).capitalize() + ".")
        n -= k
    return "\n".join(out)


#: Null, empty, blank, one word, repeated rows, no id, no letters, a very long text and one very long word.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t \r\n"),
    (4, "Word"),
    (5, "Two  WORDS\n"),
    (5, "Two  WORDS\n"),
    (None, "A row without id"),
    (None, None),
    (6, "12 34 !!"),
    (7, prose(7, 60_000)),
    (8, "x" * 2_500_000),
    (9, "Ünïcödé \U0001f600 текст 汉字  x"),
]
