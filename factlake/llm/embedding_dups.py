"""Operator 3: near-duplicate embeddings by a robust-pruned flat graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.vectors import balanced_centroids, beam_search, matrix, robust_prune, sample, squared, usable
from factlake.operators.graph import connected_components
from factlake.plans.scratch import Scratch

_NONE = -1
#: The least number of links of vectors with few, more and many links.
_STRATA = (1, 10, 100)
#: A group's matrix of distances has at most about so many rows.
_MOST_ROWS = 4096


def unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def range_search(dist: np.ndarray, graph: np.ndarray, entry: int, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, node)`` of all nodes within ``reach`` that a range-expanding greedy search finds; node i is query i.

    A greedy search from ``entry`` brings each query to its surroundings; from the nodes found within
    reach it goes on over their neighbours as long as these are within reach too.
    """
    n = len(dist)
    found, _ = beam_search(lambda q, v: dist[q[:, None], v], n, graph, entry, beam)
    q, v = np.nonzero(found >= 0)
    v = found[q, v]
    # the search is for what is near node i, so node i itself is a place to go on from
    q, v = np.r_[q, np.arange(n)], np.r_[v, np.arange(n)]
    near = np.zeros((n, n), bool)
    while len(q):
        new = (dist[q, v] <= reach) & ~near[q, v]
        q, v = q[new], v[new]
        near[q, v] = True
        flat = np.unique(q * n + v)
        q, v = flat // n, flat % n
        onward = graph[v]
        q, v = np.repeat(q, onward.shape[1]), onward.ravel()
        q, v = q[v >= 0], v[v >= 0]
    np.fill_diagonal(near, False)
    near |= near.T
    return np.nonzero(near)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that links ``a``-``b`` reach from each node."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    cosine: float = 0.9,
    shard_rows: int = 700,
    max_shards: int = 4096,
    overlap: int = 3,
    degree: int = 24,
    beam: int = 24,
    recall: float = 0.95,
    audited: int = 64,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``table``.

    Two vectors are linked if their cosine in doubles is ``cosine`` or more and the search finds them; pairs
    below are never linked.  Null, zero and non-finite vectors, those of an uncommon length and rows without
    id are linked with nothing: no links, their own component, kept.  Rows that repeat a vector are one node
    with a weight; rows that repeat an id count as vectors of their own, and their links, component
    and ``kept`` are those of their vector.

    Distinct vectors go to their ``overlap`` nearest shards, whose centroids are fitted on a sample of at most 64
    vectors a shard.  A shard builds a robust-pruned graph over its members; the neighbour lists of a vector
    in all its shards are united, and each shard searches its part of the united graph, from its medoid, for
    every member.  Found pairs are verified in doubles.  A pair counts in the first shard that both are in.
    Shards pass on one row for each member: how many links it owns and the smallest member it
    reaches, never the pairs, so a dense group does not blow up; a shard with more than twice its share
    (``2 * overlap * shard_rows``) or 4096 members, which very many near-copies, a wide overlap or a very large
    table bring about, is cut in blocks and each two blocks are worked on as a shard.

    Of the vectors with no, few (1 to 9), more (10 to 99) and many found links ``audited`` each are compared with
    all others by brute force; while the mean recall of a vector is under ``recall`` among those with few,
    more or many true links, the overlap is doubled, until every shard holds everything.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "vecdup")
    everyone = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    alone = everyone.select(
        F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    if table.filter(F.col(vec_col).isNotNull()).isEmpty():
        return alone
    good = scratch.save(usable(everyone, "id", "v"), "v")
    if not good.rows:
        return alone
    nodes = good.df.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    nodes = scratch.save(nodes.select("id", "weight", "vec"), "n")
    shards = max(1, min(max_shards, nodes.rows // shard_rows))
    centroids = balanced_centroids(unit(sample(nodes.df, nodes.rows, 64 * shards)), shards)
    while True:
        links = scratch.save(_links(nodes.df, shard_rows, centroids, overlap, cosine, degree, beam), "l").df
        share = _audit(nodes.df, links, cosine, audited)
        if share >= recall or overlap >= shards:
            break
        overlap *= 2

    totals = links.groupBy("id").agg(F.sum("n").alias("n"))
    edges = links.filter(F.col("id") != F.col("least")).select(F.col("id").alias("src"), F.col("least").alias("dst"))
    edges = scratch.save(edges.distinct(), "e").df
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    comp = connected_components(edges, ends).select(F.col("node").alias("id"), "comp")
    known = nodes.df.join(totals, "id").join(comp, "id", "left")
    known = known.select("vec", (F.col("n") + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    known = scratch.save(known, "k").df
    members = good.df.join(known, "vec").select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
    # what is left: the rows that take no part
    key = F.col("v").cast("array<double>")
    rest = everyone.select("id", key.alias("vec")).join(known.select("vec"), "vec", "left_anti")
    nameless = everyone.filter(F.col("id").isNull()).select("id", key.alias("vec")).join(known.select("vec"), "vec", "left_semi")
    rest = rest.unionByName(nameless).select(F.col("id").alias("vec_id"))
    return members.unionByName(rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


_MEMBER = "shard int, id bigint, weight bigint, shards array<int>, vec array<double>"


def _members(nodes: DataFrame, centroids: np.ndarray, overlap: int) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                dist = squared(unit(matrix(part.column(2))), shared.value)
                own = np.sort(np.argsort(dist, axis=1, kind="stable")[:, :overlap], axis=1).astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(own)), own.shape[1]))
                lists = pa.array(list(own), pa.list_(pa.int32())).take(at)
                cols = [pa.array(own.ravel()), part.column(0).take(at), part.column(1).take(at), lists, part.column(2).take(at)]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "id", "weight", "shards", "vec"])

    return nodes.select("id", "weight", "vec").mapInArrow(run, _MEMBER)


def _block_rows(overlap: int, shard_rows: int) -> int:
    """How many members are worked on together: set by rows, whatever the size of the table."""
    return min(_MOST_ROWS, max(256, 2 * overlap * shard_rows))


def _cut(members: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """``members`` once for each pair ``(i, j)`` of blocks of about ``limit / 2`` that its shard has and it is in."""
    # one row for each shard, at most as many as there are centroids
    sizes = scratch.save(members.groupBy("shard").agg(F.ceil(2 * F.count("*") / limit).alias("blocks")), "s").df
    cut = members.join(F.broadcast(sizes), "shard")
    whole = F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks"))
    cut = cut.withColumn("blocks", whole).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # block b meets every block: task (i, j), i <= j, has blocks i and j
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    cut = cut.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return cut.select("shard", "i", "j", "block", "id", "weight", "shards", "vec")


def _links(nodes: DataFrame, shard_rows: int, centroids: np.ndarray, overlap: int, cosine: float, degree: int, beam: int) -> DataFrame:
    """``(id, n, least)``: for each vector and block pair of its shards the weight of the links owned there, and the
    smallest id reached there."""
    scratch = Scratch(nodes.sparkSession, "vecdup")
    members = scratch.save(_members(nodes, centroids, overlap), "m").df
    cut = _cut(members, _block_rows(overlap, shard_rows), scratch)
    key = ["shard", "i", "j"]

    def build(group: pa.Table) -> pa.Table:
        ids, x = group["id"].to_numpy(), unit(matrix(group["vec"].combine_chunks()))
        graph = robust_prune(squared(x, x), degree, 1.2, 4 * degree)
        near = [ids[row[row >= 0]] for row in graph]
        return pa.table([group["id"], pa.array(near, pa.list_(pa.int64()))], ["id", "near"])

    built = cut.groupBy(*key).applyInArrow(build, "id bigint, near array<bigint>")
    # united: a vector is in few shards, each of which gives it at most ``degree`` neighbours
    united = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = scratch.save(united, "g").df

    def search(group: pa.Table) -> pa.Table:
        ids, order = np.unique(group["id"].to_numpy(), return_index=True)
        group = group.take(pa.array(order))
        x, weight, block = unit(matrix(group["vec"].combine_chunks())), group["weight"].to_numpy(), group["block"].to_numpy()
        shards = matrix(group["shards"].combine_chunks()).astype(np.int64)
        dist = squared(x, x)
        near = [np.asarray(n, np.int64) for n in group["near"].to_pylist()]
        lists = [np.searchsorted(ids, n[np.isin(n, ids, assume_unique=True)]) for n in near]
        graph = np.full((len(ids), max(1, max(map(len, lists)))), _NONE)
        for i, n in enumerate(lists):
            graph[i, : len(n)] = n
        # a little wider than asked: the verdict is by the cosine itself
        a, b = range_search(dist, graph, int(dist.sum(axis=1).argmin()), 2 - 2 * cosine + 1e-9, beam)
        here, i, j = group["shard"][0].as_py(), group["i"][0].as_py(), group["j"][0].as_py()
        n, links = np.zeros(len(ids), np.int64), []
        for begin in range(0, len(a), 65536):
            p, q = a[begin : begin + 65536], b[begin : begin + 65536]
            linked = (x[p] * x[q]).sum(axis=1) >= cosine
            p, q = p[linked], q[linked]
            links.append((p, q))
            same = (shards[p][:, :, None] == shards[q][:, None, :]).any(axis=2)
            first = np.where(same, shards[p], np.iinfo(np.int64).max).min(axis=1)
            # the pair's own place: its first common shard, and there its own two blocks
            own = (first == here) & (np.minimum(block[p], block[q]) == i) & (np.maximum(block[p], block[q]) == j)
            np.add.at(n, p[own], weight[q[own]])
        least = np.arange(len(ids))
        if links:
            least = _labels(len(ids), *(np.concatenate(c) for c in zip(*links)))
        return pa.table([pa.array(ids), pa.array(n), pa.array(ids[least])], ["id", "n", "least"])

    ready = cut.join(united, "id")
    return ready.groupBy(*key).applyInArrow(search, "id bigint, n bigint, least bigint")


def _audit(nodes: DataFrame, links: DataFrame, cosine: float, audited: int) -> float:
    """The mean recall of a vector's links in the worst stratum of true links, by comparison with all vectors.

    ``audited`` vectors are taken, by hashed id, of each stratum of found links.  A vector stands for as many as
    its stratum has for each one taken, and counts in the stratum of its true links whatever their number, so
    neither a large group nor the many vectors without links hide what the small groups lost.
    """
    found = links.groupBy("id").agg(F.sum("n").alias("n"))
    stratum = F.when(F.col("n") == 0, 0).otherwise(sum((F.col("n") >= limit).cast("int") for limit in _STRATA))
    some = nodes.join(found.withColumn("stratum", stratum), "id")
    sizes = {r["stratum"]: r["count"] for r in found.groupBy(stratum.alias("stratum")).count().collect()}
    if not sizes:
        return 1.0
    place = F.xxhash64("id")
    taken = pa.concat_tables([some.filter(F.col("stratum") == k).orderBy(place, "id").limit(audited).toArrow() for k in sorted(sizes)])
    ids, y = taken["id"].to_numpy(), unit(matrix(taken["vec"].combine_chunks()))
    order = np.argsort(ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                hit = unit(matrix(part.column(2))) @ y.T >= cosine
                own = part.column(0).to_numpy()
                at = order[np.minimum(np.searchsorted(ids, own, sorter=order), len(ids) - 1)]
                self_ = ids[at] == own
                hit[self_, at[self_]] = False
                total += part.column(1).to_numpy() @ hit
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

    true = nodes.select("id", "weight", "vec").mapInArrow(scan, "id bigint, n bigint")
    true = {r["id"]: r["n"] for r in true.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    want, got = np.array([true[i] for i in ids.tolist()]), taken["n"].to_numpy()
    picked = taken["stratum"].to_numpy()
    stands = np.array([sizes[k] / (picked == k).sum() for k in picked.tolist()])
    kind = np.searchsorted(_STRATA, want, side="right")
    recall = np.minimum(1.0, got / np.maximum(want, 1))
    return min((float(np.average(recall[kind == k], weights=stands[kind == k])) for k in set(kind[want > 0].tolist())), default=1.0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_embedding_dups``: links and components of all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
