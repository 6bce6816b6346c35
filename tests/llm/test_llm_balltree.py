import numpy as np
import pytest
from llm_cases import rows

from pagetree.llm.balltree import BallTree, TopKSettings, top_k, usable, whole_numbers


def brute(data, asked, k):
    out = []
    for q in sorted(asked):
        scored = sorted((-int(np.dot(data[q], v)), i) for i, v in data.items() if i != q and len(v) == len(data[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("how", [TopKSettings(k=5, shard_rows=60, query_rows=9, leaf=8, block=4), TopKSettings(k=300)])
def test_matches_brute_force(spark, how):
    rng = np.random.default_rng(1)
    data = {i: rng.integers(-3, 4, 6) for i in range(200)}  # small numbers, so many ties
    table = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, v array<long>")
    asked = [i for i in data if i % 20 == 0]
    found = top_k(table, table.where("vec_id % 20 = 0"), how)
    assert rows(found, "query_id", "rank", "vec_id", "score") == brute(data, asked, how.k)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    data = rng.integers(-60, 61, (500, 8))
    tree = BallTree(np.arange(500), data, 16)
    asked = rng.integers(-60, 61, (20, 8))
    norms = np.sqrt((asked.astype(float) ** 2).sum(axis=1))
    for node, (_, _, begin, end, *_) in enumerate(tree.nodes):
        assert (tree.bound(node, asked.astype(float), norms) >= (asked @ tree.whole[begin:end].T).max(axis=1)).all()
    large = data * 2**29  # products beyond exact doubles
    scores, ids = BallTree(np.arange(500), large, 16).search(np.full(20, -1), asked * 2**24, np.full(20, -(1 << 63)), 3)
    exact = (asked * 2**24) @ large.T
    assert (scores[:, 0] == exact.max(axis=1)).all() and (ids[:, 0] == exact.argmax(axis=1)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0]), (8, [-0.01, 0.5])]
    raw = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string")
    table = raw.where(usable("embedding")).select("vec_id", whole_numbers("embedding").alias("v"))
    found = rows(top_k(table, table), "query_id", "rank", "vec_id", "score")
    assert found == [(1, 1, 6, 64 * 64 * 5), (1, 2, 8, -64 + 128 * 32), (6, 1, 1, 64 * 64 * 5), (6, 2, 8, -64 + 128 * 32), (8, 1, 1, -64 + 128 * 32), (8, 2, 6, -64 + 128 * 32)]
    assert top_k(table.limit(0), table.limit(0)).count() == 0
