"""Queries for T1-T7."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import formats, numbers, strings
from factlake.queries.registry import query

_NUMBER_TEXTS = """CASE o_orderstatus WHEN 'F' THEN ' +' || o_orderkey || 'F' WHEN 'O' THEN
    chr(9) || '-' || o_orderkey || '7777777777777777' ELSE o_orderstatus || o_orderkey END"""
_DECIMAL = rf"""WITH t AS (SELECT o_orderkey, {_NUMBER_TEXTS} AS s FROM orders),
    m AS (SELECT *, regexp_extract(s, '^[ \t\n\f\r]*[+-]?[0-9]*') AS m FROM t),
    d AS (SELECT *, ltrim(m, ' ' || chr(9)) AS tok, ltrim(m, ' +-' || chr(9)) AS digits FROM m),
    v AS (SELECT *, CASE WHEN digits = '' THEN 0::HUGEINT ELSE digits::HUGEINT END
            * CASE WHEN starts_with(tok, '-') THEN -1 ELSE 1 END AS n, substr(s, length(m) + 1) AS rest FROM d)"""
_SIGNED = f"""{_DECIMAL}, p AS (SELECT o_orderkey, rest,
    greatest(least(n, 9223372036854775807), -9223372036854775808)::BIGINT AS value,
    CASE WHEN digits = '' THEN 'no_number' WHEN n > 9223372036854775807 OR n < -9223372036854775808
         THEN 'out_of_range' ELSE 'ok' END AS status FROM v)"""


def _number_texts(t):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    text = (
        F.when(status == "F", F.concat(F.lit(" +"), key, F.lit("F")))
        .when(status == "O", F.concat(F.lit("\t-"), key, F.lit("7777777777777777")))
        .otherwise(F.concat(status, key))
    )
    return t.orders.select("o_orderkey", text.alias("s"))


@query("t1_parse_int", f"{_SIGNED} SELECT o_orderkey, value, status, rest FROM p")
def t1(t):
    return numbers.parse_int_prefix(_number_texts(t), "s").drop("s")


@query(
    "t1_parse_unsigned",
    f"""{_DECIMAL} SELECT o_orderkey, rest, least(abs(n), 18446744073709551615)::DECIMAL(20, 0) AS value,
          CASE WHEN digits = '' THEN 'no_number' WHEN abs(n) > 18446744073709551615 THEN 'out_of_range'
          ELSE 'ok' END AS status FROM v""",
)
def t1_unsigned(t):
    return numbers.parse_int_prefix(_number_texts(t), "s", signed=False).drop("s")


_HEX = "list_reduce(list_transform(string_split(lower({0}), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, b: a * {1} + b)"


@query(
    "t1_parse_base16",
    f"""WITH t AS (SELECT o_orderkey, '0x' || o_orderkey || o_orderstatus AS s FROM orders),
        d AS (SELECT *, regexp_extract(s, '^0x([0-9a-fA-F]*)', 1) AS h FROM t)
        SELECT o_orderkey, {_HEX.format('h', 16)}::BIGINT AS value, 'ok' AS status,
               substr(s, length(h) + 3) AS rest FROM d""",
)
def t1_hex(t):
    text = F.concat(F.lit("0x"), "o_orderkey", "o_orderstatus")
    return numbers.parse_int_prefix(t.orders.select("o_orderkey", text.alias("s")), "s", 16).drop("s")


_AUTO = """CASE o_orderstatus WHEN 'F' THEN '0x' || o_orderkey WHEN 'O' THEN '0' || o_orderkey
    ELSE o_orderkey || 'P' END"""


@query(
    "t1_parse_auto_base",
    f"""WITH t AS (SELECT o_orderkey, o_orderstatus AS b, {_AUTO} AS s FROM orders),
        d AS (SELECT *, CASE b WHEN 'F' THEN regexp_extract(s, '^0x([0-9]*)', 1)
              WHEN 'O' THEN regexp_extract(s, '^0[0-7]*') ELSE regexp_extract(s, '^(0[0-7]*|[0-9]*)') END AS h FROM t)
        SELECT o_orderkey, CASE b WHEN 'F' THEN {_HEX.format('h', 16)} WHEN 'O' THEN {_HEX.format('h', 8)}
               ELSE h::BIGINT END::BIGINT AS value, 'ok' AS status,
               substr(s, length(h) + CASE WHEN b = 'F' THEN 3 ELSE 1 END) AS rest FROM d""",
)
def t1_auto(t):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    text = (
        F.when(status == "F", F.concat(F.lit("0x"), key))
        .when(status == "O", F.concat(F.lit("0"), key))
        .otherwise(F.concat(key, F.lit("P")))
    )
    return numbers.parse_int_prefix(t.orders.select("o_orderkey", text.alias("s")), "s", 0).drop("s")


@query(
    "t1_quality",
    f"""{_SIGNED} SELECT count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok,
          count(*) FILTER (status = 'no_number') AS n_no_number,
          count(*) FILTER (status = 'out_of_range') AS n_out_of_range,
          count(*) FILTER (status <> 'no_number' AND rest <> '') AS n_trailing FROM p""",
)
def t1_quality(t):
    return numbers.parse_quality(numbers.parse_int_prefix(_number_texts(t), "s"))


_FLOATS = r"""WITH t AS (SELECT event_id, ' -' || event_id || '.' || user_id || event_type || '3' AS s FROM events),
    d AS (SELECT *, regexp_extract(s, '^ -([0-9]*\.?[0-9]*)', 1) AS num,
          regexp_extract(s, '^ -[0-9]*\.?[0-9]*([eE][+-]?[0-9]*)?', 1) AS ex FROM t),
    p AS (SELECT event_id, -(num::DOUBLE) AS value, 'ok' AS status,
          substr(s, 3 + length(num) + length(ex)) AS rest FROM d)"""


def _float_texts(t):
    text = F.concat(F.lit(" -"), "event_id", F.lit("."), "user_id", "event_type", F.lit("3"))
    return t.events.select("event_id", text.alias("s"))


@query("t2_parse_float", f"{_FLOATS} SELECT event_id, value, status, rest FROM p")
def t2(t):
    return numbers.parse_float_prefix(_float_texts(t), "s").drop("s")


@query(
    "t2_exponents",
    """SELECT o_orderkey, x AS value, CASE WHEN isinf(x) THEN 'out_of_range' ELSE 'ok' END AS status, o_orderstatus AS rest
       FROM (SELECT *, CASE WHEN o_custkey = 0 THEN 0 ELSE coalesce(try_cast(o_custkey || 'e' || o_orderkey % 400 AS DOUBLE),
             'infinity'::DOUBLE) END AS x FROM orders)""",
)
def t2_exponents(t):
    # between 10^304 and 10^310 the key decides whether a double can hold the number
    power = F.concat("o_custkey", F.lit("e"), F.col("o_orderkey") % 400, "o_orderstatus")
    return numbers.parse_float_prefix(t.orders.select("o_orderkey", power.alias("s")), "s").drop("s")


@query(
    "t3_clean_cstrings",
    """SELECT doc_id, strlen(text) AS c_len, substr(hex(encode(text)), 1, 40) AS head,
         strlen(regexp_extract(text, '^[^.,]*')) AS free_len,
         md5(repeat('2A', least(20, strlen(text))::BIGINT) || substr(hex(encode(text)), 41)) AS masked FROM documents""",
)
def t3(t):
    found = strings.clean_cstrings(t.documents.select("doc_id", "text"), "text", 20, ".,")
    return found.select(
        "doc_id", "c_len", F.hex("head").alias("head"), "free_len", F.md5(F.hex("masked").cast("binary")).alias("masked")
    )


_ESCAPED = r"""WITH e AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text,
        '\', '\\'), '{', '{{'), '}', '}}'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '"', '\"') AS x FROM documents)
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(x, '(?s).'), lambda c:
        CASE WHEN c BETWEEN ' ' AND '~' THEN c ELSE '\u{' || lower(to_hex(unicode(c))) || '}' END), '') AS text FROM e"""


@query("t4_escape_text", _ESCAPED)
def t4(t):
    return strings.escape_column(t.documents.select("doc_id", "text"), "text")


_WITH_NUL = "(SELECT doc_id, replace(text, '. ', chr(0)) AS text, split_part(text, '. ', 1) AS c FROM documents)"


def _with_nul(t):
    return t.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit("\0")).alias("text"))


@query(
    "t3_nul",
    f"""SELECT doc_id, strlen(c) AS c_len, substr(hex(encode(text)), 1, 40) AS head, strlen(regexp_extract(c, '^[^,]*')) AS free_len,
         md5(repeat('2A', least(20, strlen(text))::BIGINT) || substr(hex(encode(text)), 41)) AS masked FROM {_WITH_NUL}""",
)
def t3_nul(t):
    found = strings.clean_cstrings(_with_nul(t), "text", 20, ",")
    return found.select(
        "doc_id", "c_len", F.hex("head").alias("head"), "free_len", F.md5(F.hex("masked").cast("binary")).alias("masked")
    )


@query("t4_nul", _ESCAPED.replace("FROM documents", "FROM (SELECT doc_id, replace(text, '. ', '') AS text FROM documents)"))
def t4_nul(t):
    return strings.escape_column(_with_nul(t), "text")


@query("t4_unescape_text", "SELECT doc_id, text FROM documents")
def t4_back(t):
    escaped = strings.escape_column(t.documents.select("doc_id", "text"), "text")
    return escaped.withColumn("text", strings.unescape_text(F.col("text")))


# Fixed values, written out apart from the operator's own: value type by conversion and length, other spellings, grammar.
_ALL_LENGTHS = "(SELECT unnest(['', 'hh', 'h', 'l', 'll', 'j', 'z', 't', 'L']) AS l)"
_SIGNED_SQL = "(VALUES ('', 'i32'), ('hh', 'i8'), ('h', 'i16'), ('l', 'i64'), ('ll', 'i64'), ('j', 'i64'), ('z', 'i64'), ('t', 'u64')) v(l, t)"
_UNSIGNED_SQL = "(VALUES ('', 'u32'), ('hh', 'u8'), ('h', 'u16'), ('l', 'u64'), ('ll', 'u64'), ('j', 'u64'), ('z', 'u64'), ('t', 'u64')) v(l, t)"
_PRINTF_SQL = f"""types(k, value_type) AS (
    SELECT 'd' || l, t FROM {_SIGNED_SQL}
    UNION ALL SELECT c || l, t FROM (SELECT unnest(['o', 'u', 'x', 'X']) AS c), {_UNSIGNED_SQL}
    UNION ALL SELECT c || l, t FROM (SELECT unnest(['f', 'e']) AS c), (VALUES ('', 'f64'), ('l', 'f64'), ('L', 'f128')) v(l, t)
    UNION ALL SELECT c || l, 'f64' FROM (SELECT unnest(['g', 'a']) AS c), (SELECT unnest(['', 'l']) AS l)
    UNION ALL SELECT 'c' || l, 'char' FROM {_ALL_LENGTHS}
    UNION ALL SELECT 's' || l, 'str' FROM (SELECT unnest(['', 'l']) AS l)
    UNION ALL SELECT 'p' || l, 'usize' FROM {_ALL_LENGTHS})"""
_SCANF_SQL = f"""types(k, value_type) AS (
    SELECT c || l, t FROM (SELECT unnest(['d', 'i']) AS c), {_SIGNED_SQL}
    UNION ALL SELECT c || l, t FROM (SELECT unnest(['o', 'u', 'x']) AS c), {_UNSIGNED_SQL}
    UNION ALL SELECT 'g' || l, t FROM (VALUES ('', 'f32'), ('l', 'f64'), ('L', 'f128')) v(l, t)
    UNION ALL SELECT c || l, 'str' FROM (SELECT unnest(['s', '[']) AS c), {_ALL_LENGTHS}
    UNION ALL SELECT 'c', 'i8')"""
_PRINTF_CASE = "CASE raw WHEN 'i' THEN 'd' WHEN 'F' THEN 'f' WHEN 'E' THEN 'e' WHEN 'G' THEN 'g' WHEN 'A' THEN 'a' ELSE raw END"
_SCANF_CASE = "CASE WHEN raw IN ('a', 'e', 'f') THEN 'g' ELSE raw END"


def _specs_sql(source: str, style: str) -> str:
    """Spec rows of ``source(id, text)``."""
    if style == "printf":
        pattern = r"%([-+ #0']*)(\*|[1-9]\d*)?(\.(\*|\d*))?(hh|ll|[hljztL])?([%CEFGASXacdefginopsux])"
        types, conversion = _PRINTF_SQL, _PRINTF_CASE
        parts = "g(1) AS flags, g(2) AS width, g(4) AS precision, g(5) AS length, g(6) AS raw"
        free = "left(conversion, 1) IN ('n', '%')"
    else:
        pattern = r"%(?:(\*)|(\d+))?(hh|ll|[hljztL])?([%CSacdefginopsux]|\[\^[^\]^]*\]|\[[^\]^][^\]^]*\])"
        types, conversion = _SCANF_SQL, _SCANF_CASE
        parts = "g(1) AS flags, g(2) AS width, '' AS precision, g(3) AS length, g(4) AS raw"
        free = "false"
    quoted = pattern.replace("'", "''")
    for i in range(1, 7):
        parts = parts.replace(f"g({i})", f"regexp_extract(spec, '^{quoted}$', {i})")
    return rf"""WITH {types}, src AS ({source}),
        lists AS (SELECT id, regexp_extract_all(text, '{quoted}|%') AS l FROM src),
        m AS (SELECT id, unnest(l) AS spec, generate_subscripts(l, 1) - 1 AS pos FROM lists),
        parts AS (SELECT *, {parts} FROM m),
        clean AS (SELECT * REPLACE (regexp_replace(width, '^0+([0-9])', '\1') AS width,
                  regexp_replace(precision, '^0+([0-9])', '\1') AS precision), {conversion} AS conversion
                  FROM parts),
        specs AS (SELECT id, pos::BIGINT AS pos, spec, flags, width, precision, length, conversion,
            CASE WHEN raw <> '' THEN '%' || flags || width || CASE WHEN precision <> '' THEN '.' || precision
              ELSE '' END || length || conversion END AS canonical, value_type,
            CASE WHEN raw = '' THEN 'bad' WHEN value_type IS NOT NULL OR {free} THEN 'ok' ELSE 'untyped' END AS status
            FROM clean LEFT JOIN types ON k = left(conversion, 1) || length)"""


_PATTERNS = """SELECT o_orderkey AS id, 'id=%-' || (o_orderkey % 20) || '.' || (o_custkey % 7) ||
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'l' WHEN '2' THEN 'hh' WHEN '3' THEN '' WHEN '4' THEN 'z' ELSE 'L' END
    || lower(o_orderstatus) || ' %+5s%% 100% sure %08lli %' AS text FROM orders"""


def _patterns(t):
    first = F.left("o_orderpriority", F.lit(1))
    length = F.lit("L")
    for digit, mod in {"1": "l", "2": "hh", "3": "", "4": "z"}.items():
        length = F.when(first == digit, mod).otherwise(length)
    text = F.concat(
        F.lit("id=%-"),
        F.col("o_orderkey") % 20,
        F.lit("."),
        F.col("o_custkey") % 7,
        length,
        F.lower("o_orderstatus"),
        F.lit(" %+5s%% 100% sure %08lli %"),
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query(
    "t5_placeholder_specs",
    f"""{_specs_sql(_PATTERNS, 'printf')}
        SELECT id, pos, spec, canonical, value_type, status, CASE WHEN status <> 'bad' THEN flags END AS flags,
          CASE WHEN status <> 'bad' THEN width END AS width, CASE WHEN status <> 'bad' THEN precision END AS precision,
          CASE WHEN status <> 'bad' THEN length END AS length,
          CASE WHEN status <> 'bad' THEN conversion END AS conversion FROM specs""",
)
def t5(t):
    return formats.placeholder_specs(_patterns(t), "text")


_TEXTS = "SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id, html FROM pages"
_INVENTORY = "SELECT canonical, value_type, status, count(*) AS n FROM specs GROUP BY ALL"


def _texts(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return docs.unionByName(t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text")))


@query("t5_printf_inventory", f"{_specs_sql(_TEXTS, 'printf')} {_INVENTORY}")
def t5_printf(t):
    return formats.placeholder_inventory(_texts(t), "text", "printf")


_SCANS = """SELECT o_orderkey AS id, '%' || CASE WHEN o_orderstatus = 'F' THEN '*' ELSE '' || o_custkey % 30 END ||
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'ld' WHEN '2' THEN 'hhu' WHEN '3' THEN '[^' || o_orderstatus || ',]'
    WHEN '4' THEN 'lf' ELSE 's' END || '%[abc]%*d%%%E%[]x]%p' AS text FROM orders"""


@query("t5_scanf_inventory", f"{_specs_sql(_SCANS, 'scanf')} {_INVENTORY}")
def t5_scanf(t):
    first = F.left("o_orderpriority", F.lit(1))
    conv = (
        F.when(first == "1", F.lit("ld"))
        .when(first == "2", F.lit("hhu"))
        .when(first == "3", F.concat(F.lit("[^"), "o_orderstatus", F.lit(",]")))
        .when(first == "4", F.lit("lf"))
        .otherwise("s")
    )
    width = F.when(F.col("o_orderstatus") == "F", F.lit("*")).otherwise((F.col("o_custkey") % 30).cast("string"))
    text = F.concat(F.lit("%"), width, conv, F.lit("%[abc]%*d%%%E%[]x]%p"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text"))
    return formats.placeholder_inventory(rows, "text", "scanf")


def _log(t):
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    line = F.when(
        F.col("event_type") == "error", F.concat(F.lit("failed user="), "user_id")
    ).otherwise(
        F.concat(F.lit("user="), "user_id", F.lit(" type="), "event_type", F.lit("  val="), amount, F.lit("!"))
    )
    return t.events.select("event_id", line.alias("line"))


_LOG_PATTERN = "user=%d type=%s val=%lf"


@query(
    "t6_extract_by_pattern",
    """SELECT event_id, user_id::INTEGER AS user, event_type AS type,
         value::DECIMAL(18, 2)::VARCHAR::DOUBLE AS val FROM events WHERE event_type <> 'error'""",
)
def t6(t):
    matched, _ = formats.extract_by_pattern(_log(t), "line", _LOG_PATTERN, ["user", "type", "val"])
    return matched.drop("line")


@query(
    "t6_quarantine",
    "SELECT event_id, 'failed user=' || user_id AS line FROM events WHERE event_type = 'error'",
)
def t6_quarantine(t):
    return formats.extract_by_pattern(_log(t), "line", _LOG_PATTERN, ["user", "type", "val"])[1]


@query(
    "t7_render_by_pattern",
    """SELECT o_orderkey, printf('%08d|%-10s|%12.2f|%+d|%x|%5.1s.', o_orderkey, o_orderpriority,
         o_totalprice, o_custkey, o_orderkey, o_orderstatus) AS line FROM orders""",
)
def t7(t):
    cols = ["o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey", "o_orderkey", "o_orderstatus"]
    rows = formats.render_by_pattern(t.orders, "%08ld|%-10s|%12.2f|%+ld|%lx|%5.1s.", cols)
    return rows.select("o_orderkey", "line")


@query(
    "t7_render_general",
    "SELECT o_orderkey, printf('%g %.3g', o_totalprice, o_orderkey / 1e6) AS line FROM orders",
)
def t7_general(t):
    rows = t.orders.withColumn("small", F.col("o_orderkey") / F.lit(1e6))
    return formats.render_by_pattern(rows, "%g %.3g", ["o_totalprice", "small"]).select("o_orderkey", "line")
