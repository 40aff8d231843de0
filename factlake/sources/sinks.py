"""Writers (K1, K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_tree(df: DataFrame, keys: list[str], path: str, mode: str = "errorifexists") -> None:
    """K1: one folder for each key, nested keys nest folders.

    The rebalance hint sends rows of one key to one task while they fit, so small keys get one file,
    and lets AQE split a key that is too large for a task.
    """
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_mode(df: DataFrame | None, path: str, mode: str, spark: SparkSession | None = None):
    """K2: the C open modes over a table folder.

    ``w`` replaces, ``a`` appends, and ``r`` reads a folder that must exist.  The first character
    decides; a ``+`` adds the other direction: ``w+`` and ``a+`` return what is there afterwards,
    and ``r+`` with rows appends them to a folder that must exist.
    """
    kind, both = mode[:1], "+" in mode[1:]
    if kind not in ("r", "w", "a"):
        raise ValueError(f"unknown mode {mode!r}")
    if df is None and kind != "r":
        raise ValueError(f"mode {mode!r} needs rows to write")
    session = spark or (df.sparkSession if df is not None else SparkSession.getActiveSession())
    if kind == "r":
        session.read.parquet(path)  # fails when the folder is not there
        if df is not None:
            if not both:
                raise ValueError("mode 'r' only reads")
            df.write.mode("append").parquet(path)
        return session.read.parquet(path)
    df.write.mode("overwrite" if kind == "w" else "append").parquet(path)
    return session.read.schema(df.schema).parquet(path) if both else None
