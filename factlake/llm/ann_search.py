"""Operator 10: approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.vectors import balanced_centroids, beam_search, matrix, robust_prune, sample, squared, usable
from factlake.plans.scratch import Scratch

_BLOCK = 4096


@dataclass(frozen=True)
class Lists:
    """Centroids of the posting lists and a pruned graph over them.

    The largest inner product becomes the smallest distance when a further component brings every
    vector to the length ``radius``, the largest there is, and queries are scaled to it.
    """

    centroids: np.ndarray
    graph: np.ndarray
    entry: int
    radius: float

    @property
    def near(self) -> float:
        """Distances are compared with this much added, so that a point on a centroid is no exception."""
        return 0.05 * self.radius

    @cached_property
    def squares(self) -> np.ndarray:
        return (self.centroids**2).sum(axis=1)

    @classmethod
    def fit(cls, vectors: np.ndarray, radius: float, lists: int) -> Lists:
        centroids = balanced_centroids(cls.lifted(vectors, radius), lists)
        dist = squared(centroids, centroids)
        return cls(centroids, robust_prune(dist, 24, 1.2, 128), int(dist.sum(axis=1).argmin()), radius)

    @staticmethod
    def lifted(x: np.ndarray, radius: float) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(radius**2 - (x**2).sum(axis=1), 0))])

    def scaled(self, queries: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        return np.column_stack([queries * (self.radius / length), np.zeros(len(queries))])

    def nearest(self, points: np.ndarray, ratio: float, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each point its number, the lists within ``ratio`` times the distance of the nearest, nearest first, and
        their distances; the graph is searched with wider beams until one reaches beyond the ratio."""
        todo = np.arange(len(points))
        while len(todo):
            here = points[todo]

            def reach(q: np.ndarray, v: np.ndarray, here: np.ndarray = here) -> np.ndarray:
                cross = np.einsum("qd,qvd->qv", here[q], self.centroids[v])
                return np.maximum((here[q] ** 2).sum(axis=1)[:, None] + self.squares[v] - 2 * cross, 0)

            found, dist = beam_search(reach, len(todo), self.graph, self.entry, beam)
            dist = np.sqrt(dist)
            limit = ratio * (dist[:, :1] + self.near) - self.near
            wide = (found[:, -1] >= 0) & (dist[:, -1] <= limit[:, 0]) if beam < len(self.graph) else np.zeros(len(todo), bool)
            for i in np.flatnonzero(~wide):
                keep = (found[i] >= 0) & (dist[i] <= limit[i])
                yield int(todo[i]), found[i][keep], dist[i][keep]
            todo, beam = todo[wide], 2 * beam

    def homes(self, vectors: np.ndarray, ratio: float, replicas: int) -> Iterator[tuple[int, list[int]]]:
        """The lists of each vector: the nearest, and those hardly farther up to ``replicas`` in all."""
        for i, lists, _ in self.nearest(self.lifted(vectors, self.radius), ratio, 4 * replicas):
            yield i, lists[:replicas].tolist()


def best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ids of ``v`` for each row of ``q``, other ids only: query ids, vector ids, inner products.

    An id that several rows of ``v`` have counts once, by its best row.  With ``least`` only scores of at least
    that of their query.

    A product of matrices picks all that could be among them, ties included; their scores are then summed
    component by component, alike for equal vectors wherever they stand.
    """
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    ids_begin = np.flatnonzero(np.diff(vid, prepend=vid[:1] - 1))
    out = []
    for begin in range(0, len(q), 256):
        part, ids = q[begin : begin + 256], qid[begin : begin + 256]
        rough = part @ v.T
        rough[ids[:, None] == vid[None]] = -np.inf
        if len(ids_begin) > k:
            each = np.maximum.reduceat(rough, ids_begin, axis=1) if len(ids_begin) < len(vid) else rough
            floor = np.partition(each, len(ids_begin) - k, axis=1)[:, len(ids_begin) - k]
        else:
            floor = np.full(len(part), -np.inf)
        slack = 1e-9 * np.linalg.norm(part, axis=1) * np.sqrt((v**2).sum(axis=1).max())
        rows, cols = np.nonzero((rough >= (floor - slack)[:, None]) & np.isfinite(rough))
        score = np.concatenate([(part[rows[i : i + 65536]] * v[cols[i : i + 65536]]).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        found = vid[cols]
        order = np.lexsort((-score, found, rows))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(rows[order]) != 0) | (np.diff(found[order]) != 0)
        order = order[first]
        order = order[np.lexsort((found[order], -score[order], rows[order]))]
        rows, found, score = rows[order], found[order], score[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        if least is not None:
            top &= score >= least[begin + rows]
        out.append((ids[rows[top]], found[top], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(
    table: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    k: int = 20,
    list_rows: int = 1024,
    max_lists: int = 4096,
    replicas: int = 2,
    boundary: float = 1.02,
    recall: float = 0.97,
    audited: int = 64,
    first_lists: int = 3,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found for each row of ``queries``.

    Both tables have ``id_col`` and ``vec_col``.  Candidates are all rows of ``table`` but those with the
    query's own id.  Null, zero and non-finite vectors, those of an uncommon length and rows without id take
    no part.  Rows that repeat id and vector count once; of an id with several vectors the best score counts, as a
    query its least vector.  Ties go to
    the smaller id; with fewer candidates all are returned; empty tables give no rows.

    The centroids are fitted on a sample of at most 64 vectors a list; every vector is then filed under its
    nearest list and, at the boundary, under up to ``replicas`` in all.  A query visits the lists within a
    ratio of its nearest one's distance.  The ratio is measured: ``audited`` queries are compared with all
    vectors by brute force, and it is the least that finds the share ``recall`` of their neighbours.  The
    nearest ``first_lists`` are visited first; the others pass on only what is no worse than the ``k``-th
    found there, which loses nothing.  Lists
    and the queries that visit them are cut in blocks of 4096, so a list of very many equal vectors
    is spread over tasks; each pair of blocks passes on the best ``k`` of each query only.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if usable_is_empty(table, vec_col):
        return spark.createDataFrame([], schema)
    different = usable(table, id_col, vec_col).select(F.col("id").cast("bigint").alias("id"), "vec").distinct()
    rows = scratch.save(different, "v")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    info = rows.df.agg(F.max(length).alias("r"), F.max(F.size("vec")).alias("d")).first()
    if not rows.rows:
        return spark.createDataFrame([], schema)
    n_lists = max(1, min(max_lists, rows.rows // list_rows))
    lists = Lists.fit(sample(rows.df, rows.rows, 64 * n_lists), info["r"], n_lists)
    shared = spark.sparkContext.broadcast(lists)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                pairs = [(i, c) for i, homes in shared.value.homes(x, boundary, replicas) for c in homes]
                at = pa.array([i for i, _ in pairs], pa.int64())
                filed = pa.array([c for _, c in pairs], pa.int32())
                yield pa.RecordBatch.from_arrays([filed, batch.column(0).take(at), batch.column(1).take(at)], ["list", "id", "vec"])

    postings = scratch.save(rows.df.select("id", "vec").mapInArrow(file, "list int, id bigint, vec array<double>"), "p").df
    asked = usable(queries, id_col, vec_col).filter(F.size("vec") == info["d"])
    asked = scratch.save(asked.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min("vec").alias("vec")), "q").df
    ratio = _ratio(asked, postings, lists, k, audited, recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                found = shared.value.nearest(shared.value.scaled(x), ratio, 32)
                pairs = [(i, c, n) for i, lists, _ in found for n, c in enumerate(lists.tolist())]
                at = pa.array([i for i, *_ in pairs], pa.int64())
                visited, turn = (pa.array([p[n] for p in pairs], pa.int32()) for n in (1, 2))
                cols = [visited, turn, batch.column(0).take(at), batch.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(cols, ["list", "turn", "id", "vec"])

    visits = asked.select("id", "vec").mapInArrow(visit, "list int, turn int, id bigint, vec array<double>")
    visits = scratch.save(visits, "a").df
    nothing = F.lit(float("-inf"))
    head = _visited(visits.filter(F.col("turn") < first_lists).withColumn("least", nothing), postings, k)
    head = scratch.save(_top(head, k), "h").df
    # a query that has k neighbours needs no worse one from the lists that are farther
    floor = head.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    tail = visits.filter(F.col("turn") >= first_lists).join(floor, "id", "left").withColumn("least", F.coalesce("least", nothing))
    return _top(head.drop("rank").unionByName(_visited(tail, postings, k)), k)


def _visited(visits: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best ``k`` of each list for each of its ``visits(list, id, vec, least)``."""
    # one row for each list: at most max_lists
    sizes = [side.groupBy("list").agg(F.ceil(F.count("*") / _BLOCK).alias(n)) for side, n in ((postings, "vn"), (visits, "qn"))]
    blocks = F.broadcast(Scratch(visits.sparkSession, "ann").save(sizes[0].join(sizes[1], "list"), "b").df)
    key = ["list", "vb", "qb"]

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        # by the vector too: the rows of one id are spread as well, and each block folds its own
        cut = side.join(blocks, "list").withColumn(own, F.pmod(F.xxhash64("id", "vec"), F.col(own_n)))
        cut = cut.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_n) - 1)))
        return cut.select(*key, *[c for c in side.columns if c not in ("list", "turn")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = (matrix(side["vec"].combine_chunks()) for side in (left, right))
        found = best(left["id"].to_numpy(), q, right["id"].to_numpy(), v, k, left["least"].to_numpy())
        return pa.table([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    left = dealt(visits, "qb", "qn", "vb", "vn").groupBy(*key)
    right = dealt(postings, "vb", "vn", "qb", "qn").groupBy(*key)
    return left.cogroup(right).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best different ids of each query."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def usable_is_empty(table: DataFrame, vec_col: str) -> bool:
    return table.filter(F.col(vec_col).isNotNull()).isEmpty()


def _ratio(asked: DataFrame, postings: DataFrame, lists: Lists, k: int, audited: int, recall: float) -> float:
    """The least ratio of distances at which the audited queries reach ``recall`` of their true neighbours."""
    some = asked.orderBy(F.xxhash64("id"), "id").limit(audited).toArrow()
    if not some.num_rows:
        return 1.0
    qid, q = some["id"].to_numpy(), matrix(some["vec"].combine_chunks())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vid = batch.column(0).to_numpy()
                found = best(qid, q, vid, matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    true = postings.select("id", "vec").mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
    true = true.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = true.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    filed = true.join(postings.select(F.col("id").alias("vec_id"), "list"), "vec_id").groupBy("query_id", "vec_id")
    where = filed.agg(F.collect_set("list").alias("lists")).toArrow()
    dist = np.sqrt(squared(lists.scaled(q), lists.centroids))
    at = {i: n for n, i in enumerate(qid.tolist())}
    pairs = [(dist[at[i]], found) for i, found in zip(where["query_id"].to_pylist(), where["lists"].to_pylist())]
    need = sorted((d[found].min() + lists.near) / (d.min() + lists.near) for d, found in pairs)
    return float(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) * (1 + 1e-9) if need else 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_ann_search``: the 20 nearest vectors of every row whose id is divisible by 20."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.filter(F.col("vec_id") % 20 == 0))
