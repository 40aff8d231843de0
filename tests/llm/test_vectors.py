import numpy as np
import pytest

from factlake.llm import ann_search, embedding_dups
from factlake.llm.vectors import balanced_centroids, beam_search, robust_prune, squared
from factlake.plans.scratch import Scratch

FIELDS = "vec_id bigint, embedding array<float>, label int, id string, vec string, shard string, list string"
ODD = [
    (900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [float("inf")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, []),
    (906, [1.0] * 7), (None, [1.0] * 8),
]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], 0, "a", "b", "c", "d") for i, v in rows], FIELDS)


def clustered(seed, groups=30, each=12, d=8, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = (centres[:, None] + noise * rng.normal(size=(groups, each, d))).reshape(-1, d).astype(np.float32)
    return [(int(i), x[n].tolist()) for n, i in enumerate(rng.permutation(len(x)))]


def brute_links(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    x = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    comp = list(ids)
    for _ in range(len(ids)):
        new = [min([comp[j] for j in np.flatnonzero(hit[k])] + [comp[k]]) for k in range(len(ids))]
        if new == comp:
            break
        comp = new
    return {i: (int(hit[k].sum()), comp[k], comp[k] == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("shard_rows", [1000, 60, 25])
def test_near_duplicates(spark, shard_rows):
    rows = clustered(1) + [(700 + i, v) for i, (_, v) in enumerate(clustered(1)[:5])] + [(800, [2 * x for x in clustered(1)[0][1]])]
    got = embedding_dups.near_duplicates(table(spark, rows + ODD), shard_rows=shard_rows).collect()
    assert len(got) == len(rows) + len(ODD)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    want = brute_links(rows)
    # none too many, and of all links nearly all
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i][0] for i in want) >= 0.98 * sum(n for n, *_ in want.values())
    assert sum(found[i] == want[i] for i in want) >= 0.95 * len(want)
    assert all(found[i] == (0, i, True) for i, _ in ODD)


def test_dense_group_is_cut_in_blocks(spark):
    """One group of near-copies far larger than a shard: every link is counted once."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    dense = [(i, (centre + 0.01 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    rows = dense + [(5000 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    got = {r.vec_id: r for r in embedding_dups.near_duplicates(table(spark, rows), shard_rows=100).collect()}
    want = brute_links(rows)
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, *_ in want.values())
    assert {got[i].component_id for i, _ in dense} == {0}


def test_audit_sees_small_groups(spark):
    """All links of a large group found and none of the pairs': the group does not hide them."""
    rng = np.random.default_rng(4)
    dense = [rng.normal(size=8)] * 300 + 0.001 * rng.normal(size=(300, 8))
    pairs = np.repeat(rng.normal(size=(100, 64)), 2, axis=0) + 0.01 * rng.normal(size=(200, 64))
    x = np.zeros((500, 72))
    x[:300, :8], x[300:, 8:] = dense, pairs
    nodes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id bigint, weight bigint, vec array<double>")
    links = lambda n: spark.createDataFrame([(i, 299 if i < 300 else n, 0) for i in range(500)], "id bigint, n bigint, least bigint")
    assert embedding_dups._audit(nodes, links(1), 0.9, 64) == 1
    assert embedding_dups._audit(nodes, links(0), 0.9, 64) == 0


def test_groups_do_not_grow_with_table_or_overlap(spark):
    """A shard that holds a whole table is worked on in groups of the block size, and every two members meet."""
    limit = embedding_dups._block_rows(64, 700)
    assert limit == embedding_dups._block_rows(8, 700) == 4096
    members = spark.range(9000).selectExpr("0 AS shard", "id", "1L AS weight", "array(0) AS shards", "array(1.0D) AS vec")
    cut = embedding_dups._cut(members, limit, Scratch(spark, "test"))
    groups = cut.groupBy("i", "j").count().collect()
    assert len(groups) == 15 and max(r["count"] for r in groups) <= 1.1 * limit
    assert len({r["block"] for r in cut.select("block").distinct().collect()}) == 5


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(500, [1.0, 2.0, 3.1]), (501, [-1.0, 0.0, 0.0]), (7, [1.0, 2.0, 3.0])]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dups.near_duplicates(table(spark, rows)).collect()]
    assert sorted(got) == sorted([(i, 401, 0, i == 0) for i in [*range(400), 7]] + [(500, 401, 0, False), (501, 0, 501, True)])


@pytest.mark.parametrize("rows", [[], ODD[:4], [(3, [1.0, 0.0])]])
def test_small_tables(spark, rows):
    got = embedding_dups.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, 0, i, True) for i, _ in rows]
    t = table(spark, rows)
    assert ann_search.search(t, t).count() == 0


def test_range_search_finds_all_of_a_connected_group():
    rows = clustered(5, groups=6, each=40, noise=0.05)
    x = embedding_dups.unit(np.array([v for _, v in rows]))
    dist = squared(x, x)
    a, b = embedding_dups.range_search(dist, robust_prune(dist, 16, 1.2, 64), 0, 0.2, 16)
    want = dist <= 0.2
    np.fill_diagonal(want, False)
    assert len(a) >= 0.98 * want.sum() and want[a, b].all()


def ann(spark, rows, queries, **options):
    got = ann_search.search(table(spark, rows), table(spark, queries), **options)
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def brute_nearest(rows, queries, k):
    out = {}
    for i, q in queries:
        scored = {}
        for j, v in rows:
            if j != i:
                s = float((np.array(q, np.float32).astype(float) * np.array(v, np.float32).astype(float)).sum())
                scored[j] = max(s, scored.get(j, -np.inf))
        out[i] = sorted(((-s, j) for j, s in scored.items()))[:k]
    return out


@pytest.mark.parametrize("list_rows", [1000, 40])
def test_search_recall_and_scores(spark, list_rows):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(600)]
    queries = rows[::20]
    got, want = ann(spark, rows + ODD, queries + ODD, list_rows=list_rows), brute_nearest(rows, queries, 20)
    assert got.keys() == want.keys()
    hits = 0
    for i in want:
        assert [r for r, *_ in got[i]] == list(range(1, 21))
        assert [(-s, j) for _, j, s in got[i]] == sorted((-s, j) for _, j, s in got[i])
        exact = dict((j, -s) for s, j in brute_nearest(rows, [(i, dict(queries)[i])], 600)[i])
        assert all(s == pytest.approx(exact[j], rel=1e-12) for _, j, s in got[i])
        hits += len({j for _, j, _ in got[i]} & {j for _, j in want[i]})
    assert hits >= 0.9 * 20 * len(want)


def test_search_ties_copies_and_few_candidates(spark):
    same = [(i, [1.0, 1.0]) for i in range(300)]
    got = ann(spark, same, [(5, [1.0, 1.0])])
    assert [j for _, j, _ in got[5]] == [i for i in range(21) if i != 5]
    few = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])]
    assert ann(spark, few, few[:1]) == {1: [(1, 3, 2.0), (2, 2, 0.0)]}


@pytest.mark.parametrize("list_rows", [1000, 40])
def test_search_finds_k_ids_though_rows_repeat(spark, list_rows):
    rng = np.random.default_rng(9)
    different = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    other = [(i, (np.array(v) * 0.5).tolist()) for i, v in different]
    for rows in (different * 25, [*different * 4, *other * 3]):
        queries = different[::10]
        got, want = ann(spark, rows, queries, list_rows=list_rows), brute_nearest(rows, queries, 20)
        assert all([r for r, *_ in got[i]] == list(range(1, 21)) for i in want)
        assert all(len({j for _, j, _ in got[i]}) == 20 for i in want)
        hits = sum(len({j for _, j, _ in got[i]} & {j for _, j in want[i]}) for i in want)
        assert hits >= 0.9 * 20 * len(want)


def test_best_counts_an_id_once_and_by_its_best_row():
    vid = np.array([4, 2, 4, 2, 9, 4])
    v = np.array([[1.0], [5.0], [3.0], [4.0], [2.0], [3.0]])
    ids, found, score = ann_search.best(np.array([1, 9]), np.array([[1.0], [1.0]]), vid, v, 2)
    assert ids.tolist() == [1, 1, 9, 9] and found.tolist() == [2, 4, 2, 4] and score.tolist() == [5, 3, 5, 3]


def test_balanced_centroids_and_beam_search():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(640, 8))
    centroids = balanced_centroids(x, 10)
    assert len(centroids) == 10
    assert len(balanced_centroids(np.ones((50, 3)), 4)) == 4
    graph, q = robust_prune(squared(x, x), 24, 1.2, 128), rng.normal(size=(40, 8))
    dist = squared(q, x)
    found, reach = beam_search(lambda i, v: dist[i[:, None], v], 40, graph, 0, 32)
    assert (np.diff(reach, axis=1) >= 0).all() and np.allclose(reach, np.take_along_axis(dist, found, axis=1))
    best = dist.argsort(axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(found, best)]) >= 9
