"""Exact top-k against all inner products."""

import numpy as np
import pytest
from panelwright.llm.balltree import BallTree, top_k, vectors


def plain(ids, x, queries, k):
    score = x.astype(np.int64) @ x.astype(np.int64).T
    return {(int(ids[q]), r + 1, int(c), int(s)) for q in queries for r, (s, c) in enumerate(sorted(((int(score[q, j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q]), key=lambda t: (-t[0], t[1]))[:k])}


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) / 256 for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def whole_numbers(ids, x, queries, k):
    """As plain, in Python's whole numbers."""
    out = set()
    for q in queries:
        found = sorted((-sum(int(a) * int(b) for a, b in zip(x[j], x[q])), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])
        out |= {(int(ids[q]), r + 1, d, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, d) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("size", [16384.0, 2.0**22, 1e5, 1e9, 2.0**33, 1e18, 1e200])
def test_components_of_any_size_are_scored_exactly(spark, size):
    rng = np.random.default_rng(int(np.log2(size)))
    x = np.floor(rng.uniform(-1, 1, (320, 5)) * size * 256)
    x[::3] = rng.integers(-300, 300, (len(x[::3]), 5))  # of mixed sizes
    x[100:110] = x[50]
    x[7] = x[8] = -x[50]
    found = vectors(table(spark, range(320), x))
    assert {r.vec_id: list(r.v) for r in found.collect()} == {i: list(v) for i, v in enumerate(x)}
    got = [tuple(r) for r in top_k(found, found.where("vec_id % 50 = 0"), shard_rows=64, block_rows=3, sample_rows=20).collect()]
    assert len(got) == 35 and set(got) == whole_numbers(range(320), x, range(0, 320, 50), 5)


def test_one_large_vector_hides_no_other(spark):
    found = vectors(spark.createDataFrame([(0, [20000.0, 1.0]), (1, [1.0, 1.0]), (50, [16384.0, 0.0]), (2, [3.0, 4.0]), (3, [1e308, -1e308])], "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.rank): r.vec_id for r in top_k(found, found.where("vec_id % 50 = 0")).collect()}
    assert got == {(0, 1): 3, (0, 2): 50, (0, 3): 2, (0, 4): 1, (50, 1): 3, (50, 2): 0, (50, 3): 2, (50, 4): 1}


def test_a_shard_has_one_tree():
    """Trees go to the search as they were packed."""
    x = np.random.default_rng(3).integers(-40, 40, (500, 4)).astype(float)
    tree = BallTree(np.arange(500), x)
    again = BallTree.unpacked(*tree.packed())
    assert all(np.array_equal(getattr(tree, part), getattr(again, part)) for part in BallTree.PARTS)


def test_queries_of_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 7.0])]
    found = vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1)
    got = [(r["rank"], r.vec_id, r.score) for r in top_k(found, found.where("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(1, 2, 7), (2, 1, 5), (3, 1, 0), (4, 2, 0)]
    assert top_k(*[vectors(spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<double>"))] * 2).count() == 2


def test_equals_all_products_with_ties_and_shards(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (900, 6))
    x[300:420] = x[0]
    x[500:] = x[500:] // 20
    found = vectors(table(spark, range(900), x))
    got = {tuple(r) for r in top_k(found, found.where("vec_id % 50 = 0"), shard_rows=128, block_rows=7, sample_rows=50).collect()}
    assert got == plain(np.arange(900), x, range(0, 900, 50), 5)


def test_tree_opens_few_leaves_when_vectors_cluster():
    rng = np.random.default_rng(2)
    x = np.floor(np.concatenate([rng.normal(0, 1, (256, 8)) + c for c in rng.normal(0, 300, (40, 8))]))
    tree, floor = BallTree(np.arange(len(x)), x), [float("-inf")] * 10
    found = tree.search(x[:10], np.arange(10), 5, floor)
    for i, best in enumerate(found):
        score = x.astype(np.int64) @ x[i].astype(np.int64)
        score[i] = np.iinfo(np.int64).min
        assert [-s for s, _ in best] == sorted(score.tolist(), reverse=True)[:5] and floor[i] == -best[-1][0]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (50, [1.0, 2.0], "a"), (1, None, "a"), (2, [None, 1.0], "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (None, [1.0, 1.0], "a"), (5, [], None), (6, [0.5, -0.001], None)]
    found = vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string"))
    assert {r.vec_id: list(r.v) for r in found.collect()} == {0: [256, 512], 50: [256, 512], 5: [0, 0], 6: [128, -1]}
    got = sorted(tuple(r) for r in top_k(found, found.where("vec_id % 50 = 0")).collect())
    both = 256 * 256 + 512 * 512
    assert got == [(0, 1, 50, both), (0, 2, 6, 256 * 128 - 512), (0, 3, 5, 0), (50, 1, 0, both), (50, 2, 6, 256 * 128 - 512), (50, 3, 5, 0)]
    assert top_k(found.limit(0), found.limit(0)).collect() == [] and top_k(found, found.limit(0)).collect() == []


def test_floors_of_a_first_round_are_shared_and_hide_nothing(spark):
    """Clustered shards: each block's floors come from its own cluster, whatever groups meet, and one shard that all
    blocks want is sent from several places."""
    from panelwright.llm.balltree import _blocks, _floored, _floors, _nearest, _numbered, _shards

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4000, (6, 5))
    x = np.floor(np.concatenate([rng.normal(0, 20, (64, 5)) + c for c in centres]))
    found = vectors(table(spark, range(len(x)), x)).coalesce(1)
    shards, _, n_shards = _numbered(_shards(found, 64), "shards", 1)
    blocks, _, n_blocks = _numbered(_blocks(found, 64, spark.sparkContext.broadcast(None), 5), "blocks", 1)
    assert (n_shards, n_blocks) == (6, 6)
    assert sorted(r.n for r in shards.collect()) == list(range(6))
    roots = centres @ (centres / np.linalg.norm(centres, axis=1)[:, None]).T
    near = {(r.block, r.shard) for r in _nearest(shards, blocks, 1).collect()}
    assert {b for b, _ in near} == set(range(6)) and all(roots[s, b] >= roots[:, b].max() - 200 for b, s in near)
    for copies in (1, 64):
        got = _floored(shards, blocks, 5, 2, copies).collect()
        assert sorted(r.n for r in got) == list(range(6))
        score = x.astype(np.int64) @ x.astype(np.int64).T
        np.fill_diagonal(score, np.iinfo(np.int64).min)
        fifth = np.sort(score, axis=1)[:, -5]
        for r in got:
            for i, floor in zip(np.frombuffer(r.ids, np.int64), _floors(r.floor)):
                assert floor <= fifth[i] and floor > float("-inf")
    got = {tuple(r) for r in top_k(found, found.where("vec_id % 50 = 0"), shard_rows=32, block_rows=2, sample_rows=5, group=2, first=3).collect()}
    assert got == plain(np.arange(len(x)), x, range(0, len(x), 50), 5)
