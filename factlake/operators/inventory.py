"""Projections, filters and inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# C input/output names and what each does, one line per category.  The third part is
# the permission an operation needs or the origin an open call gives.
IO_NAMES = """
open file byte: fopen fdopen tmpfile
open pipe byte: popen
open buffer byte: fmemopen open_memstream
operation close byte: fclose pclose
operation buf_read byte: fscanf vfscanf fgets getline getdelim
operation read byte: getc fgetc fread
operation write byte: fprintf vfprintf putc fputc fputs fwrite fflush
operation seek byte: fseek fseeko ftell ftello rewind fgetpos fsetpos
operation lock byte: flockfile ftrylockfile funlockfile
operation as_raw_fd byte: fileno
operation none byte: clearerr feof ferror
stdio_operation none byte: scanf vscanf getchar gets printf vprintf putchar puts perror
string_operation none byte: sscanf vsscanf sprintf vsprintf snprintf vsnprintf
file_descr_operation none byte: dprintf vdprintf renameat
file_sys_operation none byte: rename remove tmpnam tempnam ctermid
unsupported none byte: ungetc setvbuf setbuf freopen
non_posix none byte: __fpending __freading __fwriting fpurge getmntent addmntent endmntent
non_posix none byte: setlinebuf setbuffer __gmpz_out_str newterm pg_fprintf ERR_print_errors_fp
non_posix_open none byte: setmntent fopencookie
open buffer wide: open_wmemstream
operation buf_read wide: fwscanf fgetws
operation read wide: getwc fgetwc
operation write wide: fwprintf vfwprintf putwc fputwc fputws
stdio_operation none wide: wscanf vwscanf getwchar wprintf vwprintf putwchar
string_operation none wide: swscanf vswscanf swprintf vswprintf
unsupported none wide: vfwscanf ungetwc fwide
"""


def io_rows() -> list[tuple[str, str, str | None, bool]]:
    """The fixed names as ``(name, kind, detail, is_byte)``."""
    rows = []
    for line in IO_NAMES.strip().splitlines():
        head, names = line.split(":")
        kind, detail, width = head.split()
        detail = None if detail == "none" else detail
        rows += [(name, kind, detail, width == "byte") for name in names.split()]
    return rows


def io_dimension(spark: SparkSession) -> DataFrame:
    """The 102 input/output names as a dimension table."""
    return spark.createDataFrame(
        io_rows(), "name string, kind string, detail string, is_byte boolean"
    )


def group_by_child_count(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str
) -> DataFrame:
    """``(n_children, id)`` — parents grouped by how many children they have, 0 included.

    Long form: a group may hold most parents, so it is never gathered into one row.
    """
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return parents.join(counts, parent_key, "left").select(
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_children"), F.col(parent_key).alias("id")
    )


def child_count_groups(grouped: DataFrame) -> DataFrame:
    """P1 in short: ``(n_children, n_ids)``."""
    return grouped.groupBy("n_children").agg(F.count(F.lit(1)).alias("n_ids"))


def occurrences(defs: DataFrame, uses: DataFrame, def_key: str, use_key: str) -> DataFrame:
    """Every definition with its number of uses, 0 when unseen; uses of other keys are ignored."""
    counts = uses.groupBy(F.col(use_key).alias(def_key)).agg(F.count(F.lit(1)).alias("_n"))
    return defs.join(counts, def_key, "left").select(
        *[F.col(c) for c in defs.columns],
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_uses"),
    )


def call_counts(uses: DataFrame, use_key: str, local: DataFrame, local_key: str) -> DataFrame:
    """Uses per local key; a key without use is absent.  Counted before the join."""
    counts = uses.groupBy(use_key).agg(F.count(F.lit(1)).alias("n_uses"))
    known = local.select(F.col(local_key).alias(use_key))
    return counts.join(known, use_key, "left_semi")


def conditional_counts(
    owners: DataFrame, rows: DataFrame, owner_key: str, row_key: str, cond: Column
) -> DataFrame:
    """Rows that satisfy ``cond`` for every owner, zero included."""
    counts = rows.groupBy(F.col(row_key).alias(owner_key)).agg(F.count_if(cond).alias("_n"))
    return owners.join(counts, owner_key, "left").select(
        *[F.col(c) for c in owners.columns],
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_rows"),
    )


def tokens(df: DataFrame, col: str, pattern: str, out: str = "token") -> DataFrame:
    """Every match of ``pattern`` in ``col``, one row each, duplicates kept."""
    found = F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(0))
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.explode(found).alias(out))


def path_pattern(part: str, separator: str = "::", *, blanks: bool = False) -> str:
    """Pattern of a path of any length: ``part``, then separators and further parts.

    Java runs a repeated group by recursion, so a path of some thousand parts would overflow its stack; the
    possessive form is a loop and matches the same, as nothing comes after it.
    """
    between = rf"\s*{separator}\s*" if blanks else separator
    return f"{part}(?:{between}{part})*+"


def distinct_tokens(df: DataFrame, col: str, pattern: str, separator: str = "::") -> DataFrame:
    """P5: the set of matches of ``pattern``; blanks around path separators are removed.

    For paths take ``path_pattern``, whatever their length.
    """
    token = F.regexp_replace("token", rf"\s*{separator}\s*", separator)
    return tokens(df, col, pattern).select(token.alias("token")).distinct()


def flag_listing(
    rows: DataFrame,
    locals_: DataFrame,
    *,
    kind: str = "kind",
    target: str = "target",
    call_kind: str = "call",
    position: str | None = None,
) -> DataFrame:
    """One line per row: the target's name for calls with a target, else the kind.

    Calls to a local target are dropped; duplicates stay; the position column is optional.
    """
    known = locals_.select(F.col(target)).distinct().withColumn("_local", F.lit(True))
    is_call = F.col(kind).eqNullSafe(F.lit(call_kind)) & F.col(target).isNotNull()
    # rows that cannot match carry a null key, so one join serves every kind
    keyed = rows.withColumn("_target", F.when(is_call, F.col(target)))
    marked = keyed.join(known.withColumnRenamed(target, "_target"), ["_target"], "left")
    line = F.coalesce("_target", kind).alias("line")
    extra = [F.col(position)] if position else []
    return marked.filter(F.col("_local").isNull()).select(line, *extra)


def normalise_name(name: Column) -> Column:
    """Alias spelling first, then the suffix, then the prefix, one time each."""
    stripped = F.regexp_replace(F.regexp_replace(name, "_unlocked$", ""), "^rpl_", "")
    return F.when(name == "__printf__", F.lit("printf")).otherwise(stripped)


def categorise(rows: DataFrame, col: str, dim: DataFrame) -> DataFrame:
    """Rows with the attributes of their normalised name; null when it is in no category."""
    keyed = rows.withColumn("_name", normalise_name(F.col(col)))
    right = dim.withColumnRenamed("name", "_name")
    return keyed.join(right, "_name", "left").withColumnRenamed("_name", "name")


def category_inventory(rows: DataFrame, col: str, dim: DataFrame) -> DataFrame:
    """Tokens per kind with three derived flags; unknown names have a null kind.

    Names are counted first, so the join sees one row for each distinct name.
    """
    counted = rows.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    joined = categorise(counted, col, dim)
    kind = F.col("kind")
    high_level = ["open", "operation", "stdio_operation", "file_sys_operation", "unsupported"]
    return (
        joined.groupBy("kind")
        .agg(F.sum("_n").alias("n_tokens"), F.countDistinct("name").alias("n_names"))
        .select(
            "kind",
            "n_tokens",
            "n_names",
            F.coalesce(kind == "operation", F.lit(False)).alias("is_operation"),
            F.coalesce(kind == "unsupported", F.lit(False)).alias("is_unsupported"),
            F.coalesce(kind.isin(high_level), F.lit(False)).alias("is_high_level"),
        )
    )


def exclude_prefixes(df: DataFrame, col: str, prefixes: list[str]) -> DataFrame:
    """Drop rows whose ``col`` starts with any of the prefixes; null does not."""
    starts = [F.coalesce(F.col(col).startswith(p), F.lit(False)) for p in prefixes]
    return df.filter(~reduce(lambda a, b: a | b, starts)) if starts else df


def mangle(path: Column) -> Column:
    """A path as a file name."""
    return F.replace(F.replace(path, F.lit("::"), F.lit("_")), F.lit("r#"), F.lit(""))


def binary_names(
    df: DataFrame, col: str, prefixes: list[str] | None = None, name: str | None = None
) -> DataFrame:
    """Kept rows with a mangled ``name``; a single kept row takes the configured name."""
    kept = exclude_prefixes(df, col, prefixes or []).withColumn("name", mangle(F.col(col)))
    if name is not None and len(kept.limit(2).collect()) == 1:
        kept = kept.withColumn("name", F.lit(name))
    return kept


def path_key(df: DataFrame, col: str, roots: list[str], out: str = "module") -> DataFrame:
    """Path without extension, from the first component in ``roots`` on, under ``src``.

    No component in ``roots`` leaves ``src`` alone.
    """
    bare = F.regexp_replace(F.rtrim(F.col(col), F.lit("/")), r"(?<=[^/])\.[^./]*$", "")
    parts = F.filter(F.split(bare, "/"), lambda part: part != "")
    wanted = F.array(*[F.lit(r) for r in roots]).cast("array<string>")
    started = F.transform(parts, lambda part: F.array_contains(wanted, part))
    first = F.array_position(started, True).cast("int")
    tail = F.when(first > 0, F.slice(parts, F.greatest(first, F.lit(1)), F.size(parts)))
    return df.withColumn(
        out, F.array_join(F.concat(F.array(F.lit("src")), F.coalesce(tail, F.array())), "::")
    )


def classify_targets(df: DataFrame, col: str, dims: list[tuple[str, DataFrame]]) -> DataFrame:
    """P10: ``target_class`` of each row: the first dimension that knows the target.

    ``dims`` lists ``(class, table of names)`` in order of precedence; a null target is
    ``indirect`` and an unknown one ``dynamic``.
    """
    known = reduce(
        DataFrame.unionByName,
        [
            names.select(F.col(names.columns[0]).cast("string").alias(col)).select(
                col, F.lit(rank).alias("_rank")
            )
            for rank, (_, names) in enumerate(dims)
        ],
    )
    best = known.groupBy(col).agg(F.min("_rank").alias("_rank"))
    joined = df.join(best, col, "left")
    label = F.element_at(F.array(*[F.lit(c) for c, _ in dims]), F.col("_rank") + 1)
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.when(F.col(col).isNull(), "indirect")
        .when(F.col("_rank").isNull(), "dynamic")
        .otherwise(label)
        .alias("target_class"),
    )


def funnel_counts(df: DataFrame, conds: list[tuple[str, Column]]) -> DataFrame:
    """One row with ``n_all`` and, for each named condition, the rows that pass all so far."""
    counts, so_far = [F.count(F.lit(1)).alias("n_all")], F.lit(True)
    for name, cond in conds:
        so_far = so_far & cond
        counts.append(F.count_if(so_far).alias(name))
    return df.agg(*counts)
